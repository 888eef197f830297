"""Table profiles, value counts and group statistics (AG-*, SR-*, JN-14).

Every profile is one aggregation pass (partial aggregation on the map side)
followed by work on the small result.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, col: str, dropna: bool = True, normalize: bool = False) -> DataFrame:
    """AG-1 / AG-2 / AG-3: rows per value (nulls dropped unless ``dropna=False``),
    optional share of the counted rows."""
    d = df.where(F.col(col).isNotNull()) if dropna else df
    out = d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    if normalize:
        total = d.count()  # one scalar
        out = out.withColumn("share", F.col("n") / F.lit(float(total)))
    return out


def null_profile(df: DataFrame) -> DataFrame:
    """AG-10: null count per column in one pass, unpivoted to (column, nulls)."""
    aggs = [F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    return wide.unpivot([], df.columns, "column", "nulls")


def table_profile(df: DataFrame) -> DataFrame:
    """AG-11: row count, column position and type per column."""
    spark = df.sparkSession
    meta = spark.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
                                 "position int, column string, type string")
    n = df.agg(F.count(F.lit(1)).alias("n_rows")).first()["n_rows"]  # one scalar
    return meta.withColumn("n_rows", F.lit(n).cast("bigint"))


def distinct_profile(df: DataFrame, cols: Sequence[str], approx: bool = False) -> DataFrame:
    """AG-9: distinct count per column (exact, or HyperLogLog++ with ``approx``). Exact counts
    are one aggregate per column: several in one would expand every row once per column."""
    if approx:
        return df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).unpivot([], list(cols), "column", "n_distinct")
    parts = [df.select(c).where(F.col(c).isNotNull()).distinct().agg(F.count(F.lit(1)).alias("n_distinct"))
             .select(F.lit(c).alias("column"), "n_distinct") for c in cols]
    return reduce(DataFrame.unionByName, parts)


def distinct_per_group(df: DataFrame, key: str, col: str) -> DataFrame:
    """AG-8: distinct values per group, long form (key, value), sorted; no array
    is built, so a group with many values never becomes one row."""
    return df.select(key, col).where(F.col(col).isNotNull()).distinct().orderBy(key, col)


def group_mean(df: DataFrame, keys: Sequence[str], x: str, out: str = "mean") -> DataFrame:
    """AG-4: mean per group, nulls skipped, null keys dropped (pandas groupby)."""
    d = df
    for k in keys:
        d = d.where(F.col(k).isNotNull())
    return d.groupBy(*keys).agg((F.sum(x).cast("double") / F.count(x)).alias(out))


def entity_summary(df: DataFrame, entity: str, ts: str, order: str, attrs: Sequence[str],
                   measures: Sequence[str]) -> DataFrame:
    """AG-5: per entity min/max date, first non-null value of each attribute in
    (ts, order) order (V12), sum and mean of each measure."""
    okey = F.struct(F.col(ts), F.col(order))
    aggs = [F.min(ts).alias("min_date"), F.max(ts).alias("max_date")]
    for a in attrs:
        aggs.append(F.min_by(F.col(a), F.when(F.col(a).isNotNull(), okey)).alias(a))
    for m in measures:
        aggs += [F.sum(m).alias(f"total_{m}"), (F.sum(m).cast("double") / F.count(m)).alias(f"mean_{m}")]
    return df.groupBy(entity).agg(*aggs)


def having_count(df: DataFrame, key: str, op: str, threshold: int) -> DataFrame:
    """AG-16: groups whose row count is above / below a threshold."""
    c = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    cond = F.col("n") > threshold if op == ">" else F.col("n") < threshold
    return c.where(cond)


def top_k(df: DataFrame, measure: str, k: int, keys: Sequence[str]) -> DataFrame:
    """SR-3: the k rows with the largest measure, ties broken by key (deterministic)."""
    return df.orderBy(F.desc(measure), *keys).limit(k)


def first_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """SR-2: first n rows in a declared order."""
    return df.orderBy(*order).limit(n)


def repeatable_sample(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """SR-5 / SR-7: n rows picked by a seeded hash order -- the same rows on every
    run and every engine (md5 of key and seed)."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


def semi_anti(df: DataFrame, other: DataFrame, key: str, anti: bool = False) -> DataFrame:
    """JN-14: rows whose key is (not) in the other table's keys."""
    return df.join(other.select(key).distinct(), key, "left_anti" if anti else "left_semi")


def run_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """AG-17: mean and population std of metrics over runs."""
    aggs = []
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def conditional_stats(df: DataFrame, cond, amount: str) -> DataFrame:
    """AG-12: count, sum and mean of the rows meeting a condition."""
    return df.agg(F.count_if(cond).alias("n"), F.sum(F.when(cond, F.col(amount))).alias("total"),
                  (F.sum(F.when(cond, F.col(amount))).cast("double") / F.count_if(cond)).alias("mean"))
