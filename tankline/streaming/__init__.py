"""Streaming. The reference has no streaming operator (no watermark, window, state
or late-data rule); its rules need whole groups (month means, previous
transaction of a vehicle), so they stay batch rules. What is provided is
incremental ingestion with Structured Streaming: new transaction files are
appended to the stage table per micro-batch and the flagged table is rebuilt
from the whole table, so results always equal the batch job's.
"""

from tankline.streaming.incremental import incremental_flags

__all__ = ["incremental_flags"]
