"""tankline: fleet fuel-transaction analytics as Spark DataFrame jobs.

Subpackages
-----------
sources    readers, sinks and the canonical fixture views over the shared tables
functions  column-expression helpers (pure ``Column -> Column``)
operators  DataFrame -> DataFrame operators and ``pyspark.ml`` stages
plans      named queries (Spark side + DuckDB oracle text) and the bench set
streaming  micro-batch application of the batch flag rules
"""

from tankline.schema import TxnCols

__all__ = ["TxnCols"]
