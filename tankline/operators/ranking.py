"""Distributed ranking of distinct keys without a single-partition window.

``Window.orderBy`` with no partition moves every row to one task; for
unbounded key sets the keys are instead range-partitioned and sorted, the
per-partition counts (one row per partition) give each partition's offset, and
the rank is offset + position inside the partition.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_rank_keys(df: DataFrame, col: str, out: str = "rank") -> DataFrame:
    """Distinct non-null values of ``col`` with their 1-based rank in sorted order.

    The sorted keys are checkpointed (reliable checkpoint directory) so the
    partition counts and the positions are taken from the same materialisation,
    whatever AQE decides about partition sizes.
    """
    keys = (df.select(col).where(F.col(col).isNotNull()).distinct()
            .repartitionByRange(col).sortWithinPartitions(col))
    keys = keys.withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id())
    keys = keys.checkpoint(eager=True)
    counts = keys.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition: bounded
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    pos = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (keys.join(F.broadcast(offsets), "_pid")
            .select(col, (F.col("_off") + pos + F.lit(1)).alias(out)))


def cumulative_by_key(df: DataFrame, key: str, cols: list[str], descending: bool = False,
                      inclusive: bool = True) -> DataFrame:
    """Running sums of ``cols`` over the distinct, sorted ``key`` values.

    ``df`` must hold one row per key (aggregate first). Keys are range-partitioned
    and checkpointed; each partition's running sums come from a window over that
    partition only, and the totals of the earlier partitions (one row per
    partition) are added as offsets. ``inclusive=False`` gives the sums strictly
    before each key. Output: key, cols, ``cum_<c>``.
    """
    order = F.desc(key) if descending else F.asc(key)
    d = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_pid", F.spark_partition_id())
    d = d.checkpoint(eager=True)
    tot = d.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{c}") for c in cols])
    wp = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition: bounded
    offs = tot.select("_pid", *[F.coalesce(F.sum(f"_t_{c}").over(wp), F.lit(0)).alias(f"_o_{c}") for c in cols])
    frame = (Window.unboundedPreceding, 0) if inclusive else (Window.unboundedPreceding, -1)
    w = Window.partitionBy("_pid").orderBy(order).rowsBetween(*frame)
    d = d.select(key, *cols, "_pid", *[F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_w_{c}") for c in cols])
    d = d.join(F.broadcast(offs), "_pid")  # one row per partition
    return d.select(key, *cols, *[(F.col(f"_o_{c}") + F.col(f"_w_{c}")).alias(f"cum_{c}") for c in cols])


def rank_within_group(df: DataFrame, group: str, order: str, out: str = "rank") -> DataFrame:
    """1-based row number of each row inside its group, in ``order`` (unique per
    row), without sending a group to one task.

    Rows are range-partitioned on (group, order) -- a large group spans many
    partitions -- sorted, and checkpointed so positions are stable. A row's rank
    is the number of group rows in earlier partitions (from per (partition,
    group) counts: one row per pair) plus its position after the group's first
    row in its partition (``monotonically_increasing_id`` holds the position in
    its low 33 bits).
    """
    d = (df.repartitionByRange(group, order).sortWithinPartitions(group, order)
         .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))
    d = d.checkpoint(eager=True)
    pg = d.groupBy("_pid", group).agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    pg = pg.select("_pid", group, "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    from tankline.operators.joins import attach
    j = attach(d, pg, ["_pid", group], "inner")  # one row per (partition, group): size-checked
    return j.withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_first")) + F.lit(1)).drop(
        "_pid", "_mid", "_first", "_off")


def exact_quantiles(df: DataFrame, col: str, qs: list[float]) -> list[float] | None:
    """Interpolated quantiles (V15) of the non-null, non-NaN values: counts per value, running
    counts over range partitions, then the two order statistics around each position. No
    task holds more than its range of values. None for no values."""
    x = F.col(col).cast("double")
    counts = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative_by_key(counts, "_x", ["_n"])
    n = cum.agg(F.max("cum__n").alias("n")).first()["n"]
    if not n:
        return None
    at = [q * (n - 1) for q in qs]
    want = sorted({i for p in at for i in (math.floor(p), math.ceil(p))})
    got = cum.agg(*[F.min(F.when(F.col("cum__n") > i, F.col("_x"))).alias(str(i)) for i in want]).first()
    return [got[str(math.floor(p))] + (got[str(math.ceil(p))] - got[str(math.floor(p))]) * (p - math.floor(p)) for p in at]


def exact_quantiles_by(df: DataFrame, group: str, col: str, qs: list[float]) -> DataFrame:
    """(group, n, q: array of quantiles): ``exact_quantiles`` for every group at once. Values
    are ranked over (group, value) ranges, so a hot group spans many tasks; a group's own
    ranks are the running counts less those of the groups before it."""
    x = F.col(col).cast("double")
    d = df.where(F.col(group).isNotNull() & x.isNotNull() & ~F.isnan(x))
    counts = d.groupBy(F.struct(F.col(group).alias("g"), x.alias("x")).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative_by_key(counts, "_k", ["_n"])
    size = cum.groupBy(F.col("_k.g").alias("g")).agg(F.sum("_n").alias("n"), F.max("cum__n").alias("top"))
    size = size.select("g", "n", (F.col("top") - F.col("n")).alias("before"))
    from tankline.operators.joins import attach
    c = attach(cum.select(F.col("_k.g").alias("g"), F.col("_k.x").alias("x"), "cum__n"), size, "g", "inner")
    rank = F.col("cum__n") - F.col("before")

    def stat(i):  # the value with the 0-based rank i in its group
        return F.min(F.when(rank > i, F.col("x")))

    aggs = []
    for j, q in enumerate(qs):
        p = F.lit(q) * (F.col("n") - 1)
        aggs += [stat(F.floor(p)).alias(f"l{j}"), stat(F.ceil(p)).alias(f"h{j}")]
    out = c.groupBy("g", "n").agg(*aggs)
    qv = []
    for j, q in enumerate(qs):
        p = F.lit(q) * (F.col("n") - 1)
        qv.append(F.col(f"l{j}") + (F.col(f"h{j}") - F.col(f"l{j}")) * (p - F.floor(p)))
    return out.select(F.col("g").alias(group), "n", F.array(*qv).alias("q"))
