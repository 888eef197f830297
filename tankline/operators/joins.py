"""Join building blocks: size-checked broadcast, backward as-of join, interval join.

Broadcasting is only used behind a row-count check of the small side; above
the limit the join falls back to a shuffle join, where AQE splits skewed
partitions of the large side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Row limit for sides we broadcast after counting them. A few hundred thousand
# narrow rows stay well under the default 8 GB broadcast ceiling.
BROADCAST_MAX_ROWS = 200_000


def checked_broadcast(small: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Return ``broadcast(small)`` if it has at most ``max_rows`` rows, else ``small``.

    The side is persisted first so the count and the join read the same
    materialisation; lost cached blocks are recomputed from lineage.
    """
    small = small.persist(StorageLevel.MEMORY_AND_DISK)
    n = small.limit(max_rows + 1).count()
    return F.broadcast(small) if n <= max_rows else small


def attach(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "left",
           max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join a derived (usually aggregated) table back onto the facts with a size check."""
    return big.join(checked_broadcast(small, max_rows), on=on, how=how)


def asof_backward(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str,
                  by: Sequence[str] = (), tiebreak: Sequence[str] = (),
                  bucket: str = "month", max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Left backward as-of join: each left row gets the last right row with
    ``right_ts <= left_ts`` (within equal ``by`` keys); null when there is none.

    The right side becomes validity intervals ``[from, to)`` via ``lead``; each
    interval is exploded into the time buckets it covers, so the join is an
    equi-join on ``(by, bucket)`` with the range as a residual condition. Left
    rows after the last right row map to the last bucket, where the open
    interval lives. Works for a broadcastable price sheet and for a large
    right side alike (then as a sort-merge join). Without ``by`` keys the right
    side is one sequence (a price sheet: one row per effective date), so its
    ``lead`` runs over that sheet only.
    """
    by = list(by)
    r = right.withColumnRenamed(right_ts, "_rt")
    order = [F.col("_rt")] + [F.col(c) for c in tiebreak]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    r = r.withColumn("_rt_next", F.lead("_rt").over(w))
    if by:
        last = r.groupBy(*by).agg(F.max("_rt").alias("_rt_max"))
    else:  # a single scalar: the last right timestamp
        rt_max = r.agg(F.max("_rt")).first()[0]
    first_b = F.date_trunc(bucket, F.col("_rt").cast("timestamp"))
    # last covered bucket: the one holding (to - 1 microsecond), or the last right
    # timestamp's bucket for the open interval
    end_b = F.date_trunc(bucket, F.coalesce(
        F.col("_rt_next").cast("timestamp") - F.expr("INTERVAL 1 MICROSECOND"),
        F.col("_rt_max").cast("timestamp")))
    step = F.expr(f"INTERVAL 1 {bucket.upper()}")
    r = r.join(checked_broadcast(last, max_rows), by, "inner") if by else r.withColumn("_rt_max", F.lit(rt_max))
    r = (r.where(F.col("_rt_next").isNull() | (F.col("_rt_next") > F.col("_rt")))
         .withColumn("_bk", F.explode(F.sequence(first_b.cast("timestamp"), end_b.cast("timestamp"), step)))
         .withColumn("_last_bk", F.date_trunc(bucket, F.col("_rt_max").cast("timestamp")).cast("timestamp")))
    # the last bucket per right key, used to clamp left rows beyond it
    lk = F.date_trunc(bucket, F.col(left_ts).cast("timestamp")).cast("timestamp")
    if by:
        clamp = r.select(*by, "_last_bk").distinct()
        lt = left.join(checked_broadcast(clamp, max_rows), by, "left")
    else:
        lt = left.withColumn("_last_bk", F.date_trunc(bucket, F.lit(rt_max).cast("timestamp")).cast("timestamp"))
    lt = lt.withColumn("_bk", F.least(lk, F.col("_last_bk"))).drop("_last_bk")
    r = r.drop("_rt_max", "_last_bk")
    rcols = [c for c in r.columns if c not in set(by) | {"_bk", "_rt_next"}]
    L = lt.alias("_L")
    R = checked_broadcast(r, max_rows).alias("_R")
    cond = [F.col("_L._bk") == F.col("_R._bk")] + [F.col(f"_L.{c}") == F.col(f"_R.{c}") for c in by]
    cond += [F.col(f"_L.{left_ts}") >= F.col("_R._rt"),
             F.col("_R._rt_next").isNull() | (F.col(f"_L.{left_ts}") < F.col("_R._rt_next"))]
    out = L.join(R, cond, "left")
    keep = [F.col(f"_L.{c}") for c in left.columns] + [F.col(f"_R.{c}") for c in rcols]
    return out.select(*keep).withColumnRenamed("_rt", right_ts)


def interval_join(facts: DataFrame, windows: DataFrame, key: str, ts: str,
                  start: str, end: str, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Facts whose ``ts`` lies in ``[start, end]`` of their key's window (inner).
    Equality on ``key`` keeps this a hash / sort-merge join with the range as a
    residual filter, never a nested loop."""
    w = checked_broadcast(windows, max_rows)
    cond = [facts[key] == w[key], facts[ts] >= w[start], facts[ts] <= w[end]]
    return facts.join(w, cond, "inner").drop(w[key])
