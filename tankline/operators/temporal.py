"""Per-entity time operators: gaps between transactions, two-row rolling mean and
difference, the distance-per-litre overlap job, price enrichment, month triples.

Skew: one vehicle may hold a large share of all rows. Per-entity sequence
windows are therefore salted by a time bucket -- rows are windowed per
(entity, bucket) and only the bucket's first row is stitched to the previous
non-empty bucket through a per-(entity, bucket) summary, whose per-entity size is
bounded by the time span, not by the data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.joins import asof_backward, attach, interval_join
from tankline.schema import DEFAULT, TxnCols


def with_previous(df: DataFrame, entity: str, ts: str, tiebreak: str, values: Sequence[str] = (),
                  scope: Sequence[str] = (), bucket: str = "day", prefix: str = "prev_") -> DataFrame:
    """Add ``prev_<ts>`` and ``prev_<v>``: the previous row of the same entity in
    (ts, tiebreak) order, restarting at changes of ``scope`` columns.

    The facts are hash-partitioned once on (entity, scope, time bucket) for the
    in-bucket ``lag`` window. The per-bucket summary (last row of the bucket, ``max_by``
    on (ts, tiebreak)) is a partial aggregate over a pruned scan, so it shuffles at
    most a narrow row per entity and bucket. The summary gets
    the previous non-empty bucket's last row via a window per entity and is
    joined back on the partitioning keys, so only the summary moves.
    """
    keys = [entity, *scope]
    cols = [ts, *values]
    d = df.withColumn("_bk", F.date_trunc(bucket, F.col(ts).cast("timestamp")))
    last = d  # the summary aggregates map-side, straight from what the rows are read from
    d = d.repartition(*[F.col(k) for k in keys], F.col("_bk"))
    w_in = Window.partitionBy(*keys, "_bk").orderBy(F.col(ts), F.col(tiebreak))
    ordkey = F.struct(F.col(ts), F.col(tiebreak))
    last = last.groupBy(*keys, "_bk").agg(*[F.max_by(c, ordkey).alias(f"_last_{c}") for c in cols])
    w_b = Window.partitionBy(*keys).orderBy("_bk")
    last = last.select(*keys, "_bk", *[F.lag(f"_last_{c}").over(w_b).alias(f"_pb_{c}") for c in cols])
    for c in cols:
        d = d.withColumn(f"_in_{c}", F.lag(c).over(w_in))
    d = d.withColumn("_first", F.row_number().over(w_in) == 1)
    d = d.join(last, [*keys, "_bk"], "left")
    for c in cols:
        d = d.withColumn(f"{prefix}{c}", F.when(F.col("_first"), F.col(f"_pb_{c}")).otherwise(F.col(f"_in_{c}")))
    return d.drop("_bk", "_first", *[f"_in_{c}" for c in cols], *[f"_pb_{c}" for c in cols])


def with_gap_days(df: DataFrame, c: TxnCols = DEFAULT, out: str = "gap_days",
                  scope: Sequence[str] = (), bucket: str = "day") -> DataFrame:
    """WN-1: whole days since the entity's previous transaction (V3, V4, V19)."""
    d = with_previous(df, c.entity, c.ts, c.id, scope=scope, bucket=bucket, prefix="_prev_")
    return d.withColumn(out, X.whole_days_between(F.col(f"_prev_{c.ts}"), F.col(c.ts))).drop(f"_prev_{c.ts}")


def with_rolling_and_diff(df: DataFrame, value: str, c: TxnCols = DEFAULT, bucket: str = "day",
                          mean_out: str = "rolling2_mean", diff_out: str = "diff") -> DataFrame:
    """WN-3 + WN-4: two-row rolling mean (null on an entity's first row, V8) and
    difference to the previous row, in (ts, id) order."""
    d = with_previous(df, c.entity, c.ts, c.id, values=[value], bucket=bucket, prefix="_p_")
    cur, prev = F.col(value), F.col(f"_p_{value}")
    has_prev = F.col(f"_p_{c.ts}").isNotNull()
    return (d.withColumn(mean_out, F.when(has_prev & cur.isNotNull() & prev.isNotNull(), (cur + prev) / F.lit(2.0)))
            .withColumn(diff_out, F.when(has_prev, cur - prev))
            .drop(f"_p_{value}", f"_p_{c.ts}"))


def avg_gap_per_entity(df: DataFrame, c: TxnCols = DEFAULT) -> DataFrame:
    """PP-7: mean gap (days) per entity; entities with one transaction get null."""
    g = with_gap_days(df, c)
    return g.groupBy(c.entity).agg((F.sum("gap_days").cast("double") / F.count("gap_days")).alias("avg_gap_days"))


# Fixed values (must equal the reference's band edges and labels).
GAP_BANDS = ([0, 2, 5, 10, 20, 30, float("inf")],
             ["< 2 days", "2-5 days", "5-10 days", "10-20 days", "20-30 days", "> 30 days"])


def with_gap_band(df: DataFrame, gap: str = "gap_days", out: str = "gap_band",
                  edges=GAP_BANDS[0], labels=GAP_BANDS[1]) -> DataFrame:
    """FN-16: right-closed gap bands (gap 0 or null -> null band, V7)."""
    return df.withColumn(out, X.right_closed_band(gap, edges, labels))


# --------------------------------------------------------------- prices (PP-5)

PRICE_COLS = ("coastal_petrol_cents", "coastal_diesel_cents", "inland_petrol_cents", "inland_diesel_cents")


def enrich_prices(txn: DataFrame, price: DataFrame, c: TxnCols = DEFAULT,
                  price_date: str = "effective_date") -> DataFrame:
    """PP-5: the four reference prices in force on the transaction date (JN-8, backward
    as-of, null before the first sheet date) plus the unit price (PRJ-6, V2)."""
    p = price.select(price_date, *PRICE_COLS)
    out = asof_backward(txn, p, c.ts, price_date, bucket="month").drop(price_date)
    return out.withColumn(c.unit_price, X.unit_price(c.amount, c.litres))


# ------------------------------------------------------- efficiency (PP-6, HF-7)

def entity_efficiency(txn: DataFrame, meter: DataFrame, c: TxnCols = DEFAULT,
                      meter_entity: str = "entity_id", meter_ts: str = "ts", odo: str = "odo",
                      low_kmpl: float = 5.0) -> DataFrame:
    """PP-6: distance per litre over the overlap of the transaction and odometer
    logs of each entity; HF-7 adds ``low_efficiency`` (KMPL below ``low_kmpl``).

    All per-entity work is partial aggregation (map-side combine), so a hot
    entity never lands whole in one task; the window tables are one row per
    entity and joined with a size check.
    """
    t = txn.select(F.col(c.entity).alias("_e"), F.col(c.ts).alias("_t"), F.col(c.litres).alias("_l"))
    m = meter.select(F.col(meter_entity).alias("_e"), F.col(meter_ts).alias("_t"), F.col(odo).alias("_o"))
    tr = t.groupBy("_e").agg(F.min("_t").alias("min_litres"), F.max("_t").alias("max_litres"))
    mr = m.groupBy("_e").agg(F.min("_t").alias("min_odo"), F.max("_t").alias("max_odo"))
    ov = (mr.join(tr, "_e")
          .select("_e", F.greatest("min_odo", "min_litres").alias("overlap_start"),
                  F.least("max_odo", "max_litres").alias("overlap_end"))
          .where(F.col("overlap_start") <= F.col("overlap_end")))
    km = (interval_join(m, ov, "_e", "_t", "overlap_start", "overlap_end")
          .groupBy("_e").agg((F.max_by("_o", "_t") - F.min_by("_o", "_t")).alias("_km")))
    li = (interval_join(t, ov, "_e", "_t", "overlap_start", "overlap_end")
          .groupBy("_e").agg(F.coalesce(F.sum("_l"), F.lit(0)).alias("_lit")))
    both = km.join(li, "_e")  # both sides non-empty, else totals stay 0
    res = attach(ov, both, "_e", "left")
    total_km = F.coalesce(F.col("_km"), F.lit(0)).cast("double")
    total_l = F.coalesce(F.col("_lit"), F.lit(0)).cast("double")
    res = (res.select(F.col("_e").alias(c.entity), "overlap_start", "overlap_end",
                      total_km.alias("total_km"), total_l.alias("total_litres"))
           .withColumn("kmpl", X.unit_price("total_km", "total_litres"))
           .where(~F.isnan("kmpl")))
    return res.withColumn("low_efficiency", X.flag(F.col("kmpl") < F.lit(low_kmpl)))


# ------------------------------------------------------------ months (WN-8)

def month_triples(df: DataFrame, ts: str = "ts") -> DataFrame:
    """WN-8: consecutive (train, validation, test) months over the distinct months
    present. Distinct months are a bounded table (one row per month)."""
    months = df.select(X.month_start(ts).alias("m")).distinct()
    w = Window.orderBy("m")
    return (months.select(F.col("m").alias("train_month"), F.lead("m", 1).over(w).alias("val_month"),
                          F.lead("m", 2).over(w).alias("test_month"))
            .where(F.col("test_month").isNotNull()))
