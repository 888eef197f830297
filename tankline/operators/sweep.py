"""Threshold sweep and temporal validation of the flag rules (HF-8..HF-13).

Compress, then sweep: every row is reduced once to three bitmasks -- bit i of
``amask`` says the amount flag fires under multiplier i, bit j of ``dmask`` the
frequency flag under day threshold j, bit k of ``pmask`` the price flag under
price threshold k. Bitmasks (rather than pass counts) stay exact for any grid
order and for negative amounts. One ``groupBy`` over the masks and the report
keys (department, district) gives a cells table of a few hundred rows per key
pair with row count and amount sum; the settings grid is then applied to the
cells only. One pass over the data, no per-setting recomputation, no
row-level expansion by the grid.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.flags import DIESEL_UPLIFT
from tankline.operators.joins import attach
from tankline.operators.temporal import with_gap_days
from tankline.schema import DEFAULT, TxnCols

# Fixed values (the reference's sweep ranges and named settings).
MULTIPLIERS = [1.3, 1.4, 1.5, 1.6, 1.7]
DAYS = [1, 2, 3, 4]
PRICE_DIFFS = [0.8, 0.9, 1.0, 1.1, 1.2]
CURRENT = (1.5, 2, 1.0)
KEY_SETTINGS = [
    (1.3, 2, 1.0, "More sensitive amount threshold (1.3×)"),
    (1.5, 2, 1.0, "Current settings (1.5×, 2 days, R1)"),
    (1.7, 2, 1.0, "Less sensitive amount threshold (1.7×)"),
    (1.5, 1, 1.0, "More sensitive frequency threshold (1 day)"),
    (1.5, 3, 1.0, "Less sensitive frequency threshold (3 days)"),
    (1.5, 2, 0.8, "More sensitive price threshold (R0.8)"),
    (1.5, 2, 1.2, "Less sensitive price threshold (R1.2)"),
]
VALIDATION_MULTIPLIERS = [1.3, 1.5, 1.7]
VALIDATION_DAYS = [1, 2, 3]
VALIDATION_PRICE_DIFFS = [0.8, 1.0, 1.2]
TRAIN_WEIGHT, VAL_WEIGHT = 0.7, 0.3


def scaled(p: float, money_scale: float) -> float:
    """Price threshold in stored units (cents), free of binary noise (0.9*100 -> 90.0)."""
    return round(p * money_scale, 9)


def _mask(conds: Sequence[Column]) -> Column:
    return sum((F.when(X.flag(cnd), F.lit(1 << i)).otherwise(F.lit(0)) for i, cnd in enumerate(conds)), F.lit(0))


def _bit(mask: Column, idx: Column) -> Column:
    return F.call_function("shiftright", mask, idx).bitwiseAND(F.lit(1))


def settings_array(mults, days, prices, money_scale: float) -> Column:
    """The grid as a literal array of structs (bounded: len(m) x len(d) x len(p))."""
    return F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k"),
                 F.lit(float(m)).alias("multiplier"), F.lit(int(d)).alias("days_threshold"),
                 F.lit(float(p)).alias("price_diff"))
        for i, m in enumerate(mults) for j, d in enumerate(days) for k, p in enumerate(prices)])


def with_masks(df: DataFrame, c: TxnCols, avg: str, gap: str, diff: str,
               mults, days, prices, money_scale: float) -> DataFrame:
    amount, a = F.col(c.amount), F.col(avg)
    return (df.withColumn("amask", _mask([amount > a * F.lit(float(m)) for m in mults]))
              .withColumn("dmask", _mask([(F.col(gap) < F.lit(int(d))) & (amount > a) for d in days]))
              .withColumn("pmask", _mask([F.col(diff) > F.lit(scaled(p, money_scale)) for p in prices])))


def sweep_cells(flag_inputs: DataFrame, c: TxnCols = DEFAULT, mults=MULTIPLIERS, days=DAYS, prices=PRICE_DIFFS,
                money_scale: float = 100.0, keys: Sequence[str] | None = None) -> DataFrame:
    """The compressed table: (masks, report keys) -> n, amount sum. Partial
    aggregation keeps hot keys from reaching one task."""
    keys = list(keys or [c.department, c.district])
    m = with_masks(flag_inputs, c, "avg_category_amount", "gap_days", "price_difference",
                   mults, days, prices, money_scale)
    return m.groupBy("amask", "dmask", "pmask", *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(c.amount).alias("amt"))


def _top_key(per_key: DataFrame, key: str, setting: Sequence[str], prefix: str) -> DataFrame:
    """Key with the highest mean flag count per setting; ties -> smallest key (V18).
    Null keys form no group (pandas ``groupby``)."""
    rate = F.col("fsum").cast("double") / F.col("cnt")
    g = (per_key.where(F.col(key).isNotNull()).groupBy(*setting, key)
         .agg(F.sum("fn").alias("fsum"), F.sum("n").alias("cnt")).withColumn("rate", rate))
    return g.groupBy(*setting).agg(
        F.min_by(key, F.struct(-F.col("rate"), F.col(key))).alias(f"highest_{prefix}_flags"),
        F.max("rate").alias(f"highest_{prefix}_flag_rate"))


def threshold_sweep(flag_inputs: DataFrame, c: TxnCols = DEFAULT, mults=MULTIPLIERS, days=DAYS,
                    prices=PRICE_DIFFS, money_scale: float = 100.0) -> DataFrame:
    """HF-8: ten metrics for every (multiplier, days, price) setting."""
    cells = sweep_cells(flag_inputs, c, mults, days, prices, money_scale).persist()  # small; three consumers
    s = (cells.withColumn("s", F.explode(settings_array(mults, days, prices, money_scale)))
         .select("*", "s.*").drop("s"))
    nf = _bit(F.col("amask"), F.col("i")) + _bit(F.col("dmask"), F.col("j")) + _bit(F.col("pmask"), F.col("k"))
    s = s.withColumn("nf", nf.cast("int")).withColumn("fn", F.col("nf") * F.col("n"))
    setting = ["multiplier", "days_threshold", "price_diff"]
    multi = F.col("nf") >= 2
    tot = s.groupBy(*setting).agg(
        F.sum("n").alias("_n"),
        F.sum(F.when(F.col("nf") == 0, F.col("n")).otherwise(0)).alias("_n0"),
        F.sum(F.when(F.col("nf") == 1, F.col("n")).otherwise(0)).alias("_n1"),
        F.sum(F.when(multi, F.col("n")).otherwise(0)).alias("num_multi_flags"),
        F.sum(F.when(multi, F.col("amt"))).alias("_amt"))
    pct = lambda x: F.col(x).cast("double") * F.lit(100.0) / F.col("_n")
    tot = tot.select(
        *setting, pct("_n0").alias("pct_no_flags"), pct("_n1").alias("pct_one_flag"),
        pct("num_multi_flags").alias("pct_multi_flags"), "num_multi_flags",
        (F.col("_amt").cast("double") / F.col("num_multi_flags")).alias("avg_flagged_amount"),
        F.coalesce(F.col("_amt"), F.lit(0)).alias("total_flagged_amount"))
    dept = _top_key(s, c.department, setting, "dept")
    dist = _top_key(s, c.district, setting, "district")
    return tot.join(dept, setting, "left").join(dist, setting, "left")


def sweep_effects(sweep: DataFrame, current=CURRENT) -> DataFrame:
    """HF-9: one-at-a-time effect curves, the other two parameters at their current values."""
    m0, d0, p0 = current
    m, d, p = F.col("multiplier"), F.col("days_threshold"), F.col("price_diff")
    parts = [
        sweep.where((d == d0) & (p == p0)).select(F.lit("multiplier").alias("parameter"), m.alias("value"), "pct_multi_flags"),
        sweep.where((m == m0) & (p == p0)).select(F.lit("days_threshold").alias("parameter"), d.cast("double").alias("value"), "pct_multi_flags"),
        sweep.where((m == m0) & (d == d0)).select(F.lit("price_diff").alias("parameter"), p.alias("value"), "pct_multi_flags"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def key_settings(sweep: DataFrame, money_scale: float = 100.0, settings=KEY_SETTINGS, current=CURRENT) -> DataFrame:
    """HF-10: named settings with change against the current one (WN-10), joined on the
    setting itself (D2, D3); rounded half-even (V16) and labelled (FN-8)."""
    spark = sweep.sparkSession
    names = spark.createDataFrame([(float(m), int(d), float(p), t) for m, d, p, t in settings],
                                  "multiplier double, days_threshold int, price_diff double, description string")
    setting = ["multiplier", "days_threshold", "price_diff"]
    m0, d0, p0 = current
    is_cur = (F.col("multiplier") == m0) & (F.col("days_threshold") == d0) & (F.col("price_diff") == p0)
    k = sweep.join(F.broadcast(names), setting, "inner")
    w = Window.partitionBy()  # over the named settings only (a handful of rows)
    k = (k.withColumn("_b_multi", F.max(F.when(is_cur, F.col("pct_multi_flags"))).over(w))
          .withColumn("_b_amt", F.max(F.when(is_cur, F.col("total_flagged_amount").cast("double"))).over(w)))
    chg_multi = (F.col("pct_multi_flags") - F.col("_b_multi")) / F.col("_b_multi") * F.lit(100.0)
    chg_amt = (F.col("total_flagged_amount") - F.col("_b_amt")) / F.col("_b_amt") * F.lit(100.0)
    rand = F.col("total_flagged_amount").cast("double") / F.lit(money_scale)
    return k.select(
        *setting, "description",
        F.bround("pct_no_flags", 2).alias("pct_no_flags"), F.bround("pct_one_flag", 2).alias("pct_one_flag"),
        F.bround("pct_multi_flags", 2).alias("pct_multi_flags"), "num_multi_flags",
        X.money(rand).alias("total_flagged_amount"),
        X.signed_pct(chg_multi).alias("pct_change_multi_flags"),
        X.signed_pct(chg_amt).alias("pct_change_total_amount"))


def top_impact(sweep: DataFrame, n: int = 5) -> DataFrame:
    """HF-11 / SR-4: the n settings with the largest flagged amount and their label."""
    label = F.concat(F.lit("M:"), F.col("multiplier").cast("string"), F.lit(", D:"),
                     F.col("days_threshold").cast("string"), F.lit(", P:R"), F.col("price_diff").cast("string"))
    return (sweep.orderBy(F.desc("total_flagged_amount"), "multiplier", "days_threshold", "price_diff").limit(n)
            .select("multiplier", "days_threshold", "price_diff", "total_flagged_amount", label.alias("param_combo")))


def sweep_heatmap(sweep: DataFrame, days=DAYS) -> DataFrame:
    """RS-5 / AG-18: mean multi-flag share over price thresholds, multiplier x days."""
    return (sweep.groupBy("multiplier").pivot("days_threshold", list(days))
            .agg(F.avg("pct_multi_flags"))
            .select("multiplier", *[F.col(str(d)).alias(f"days_{d}") for d in days]))


# ------------------------------------------------------- temporal validation

def _monthly_inputs(df: DataFrame, c: TxnCols, money_scale: float, bucket: str) -> DataFrame:
    """Per row: month, gap within that month (HF-12 computes gaps on the month's
    rows only) and price difference."""
    from tankline.operators.flags import price_difference
    d = df.withColumn("month", X.month_start(c.ts))
    d = with_gap_days(d, c, out="gap_days", scope=["month"], bucket=bucket)
    return d.withColumn("price_difference", price_difference(c, money_scale))


def setting_mask(mults, days, prices) -> Column:
    """Per row: bit s set when the row has two or more flags under setting s
    (s = i*|d|*|p| + j*|p| + k). The three masks index a lookup table of
    2^(|m|+|d|+|p|) precomputed results, kept as one array literal, so the row
    expression stays small."""
    nm, nd, npr = len(mults), len(days), len(prices)
    table = []
    for code in range(1 << (nm + nd + npr)):
        am, dm, pm = code & ((1 << nm) - 1), (code >> nm) & ((1 << nd) - 1), code >> (nm + nd)
        out = 0
        for i in range(nm):
            for j in range(nd):
                for k in range(npr):
                    if ((am >> i) & 1) + ((dm >> j) & 1) + ((pm >> k) & 1) >= 2:
                        out |= 1 << ((i * nd + j) * npr + k)
        table.append(out)
    code = F.col("amask") + F.col("dmask") * F.lit(1 << nm) + F.col("pmask") * F.lit(1 << (nm + nd))
    return F.element_at(F.lit(table).cast("array<bigint>"), code + 1)


def temporal_validation(priced: DataFrame, c: TxnCols = DEFAULT, mults=VALIDATION_MULTIPLIERS,
                        days=VALIDATION_DAYS, prices=VALIDATION_PRICE_DIFFS, money_scale: float = 100.0,
                        bucket: str = "day") -> DataFrame:
    """HF-12: for consecutive month triples (train, validation, test) and every
    setting: multi-flag share in validation and test, consistency and vehicle overlap.

    Validation rows use the training month's (category, district) mean (D1);
    test rows use 0.7 x train mean + 0.3 x validation mean where both exist, null
    where only one does (V20), and the row's own amount where neither does (JN-12).
    Every month plays the validation role once and the test role once: rows are
    doubled into the two roles, reduced to one 64-bit "multi-flagged under
    setting s" mask, and aggregated once to (role, month, entity, mask) counts.
    Shares and flagged-vehicle sets both come from that table; the grid is only
    applied to compressed rows.
    """
    if len(mults) * len(days) * len(prices) > 63:
        raise ValueError("validation grid is limited to 63 settings (one bit each)")
    keys = [c.category, c.district]
    d = _monthly_inputs(priced, c, money_scale, bucket)
    months = d.select("month").distinct()
    w = Window.orderBy("month")  # one row per distinct month: bounded
    trip = months.select(F.col("month").alias("train_month"), F.lead("month", 1).over(w).alias("val_month"),
                         F.lead("month", 2).over(w).alias("test_month")).where(F.col("test_month").isNotNull())
    # month means need no gap window: aggregate the input directly (one scan, partial aggregation)
    mavg = (priced.withColumn("month", X.month_start(c.ts))
            .groupBy("month", *keys).agg((F.sum(c.amount).cast("double") / F.count(c.amount)).alias("mavg"))
            .where(F.col(keys[0]).isNotNull() & F.col(keys[1]).isNotNull())).persist()
    tr = mavg.withColumnRenamed("mavg", "train_avg").withColumnRenamed("month", "train_month")
    va = mavg.withColumnRenamed("mavg", "val_avg").withColumnRenamed("month", "val_month")
    tkeys = ["train_month", "val_month", "test_month"]
    # validation-role average: the training month's mean, keyed by the validation month
    val_key = trip.join(tr, "train_month").select(F.col("val_month").alias("month"), *keys,
                                                  F.col("train_avg").alias("avg_val_role"))
    # test-role average: full outer blend of training and validation means (V20)
    tv = (trip.join(tr, "train_month").select(*tkeys, *keys, "train_avg")
          .join(trip.join(va, "val_month").select(*tkeys, *keys, "val_avg"), [*tkeys, *keys], "full"))
    test_key = tv.select(F.col("test_month").alias("month"), *keys,
                         (F.col("train_avg") * F.lit(TRAIN_WEIGHT) + F.col("val_avg") * F.lit(VAL_WEIGHT))
                         .alias("avg_test_role"), F.lit(True).alias("_test_key"))
    r = attach(d, val_key, ["month", *keys], "left")
    r = attach(r, test_key, ["month", *keys], "left")
    r = r.withColumn("avg_test_role", F.when(F.col("_test_key"), F.col("avg_test_role"))
                     .otherwise(F.col(c.amount).cast("double")))
    roles = F.array(F.struct(F.lit("val").alias("role"), F.col("avg_val_role").alias("avg_used")),
                    F.struct(F.lit("test").alias("role"), F.col("avg_test_role").alias("avg_used")))
    r = r.withColumn("_r", F.explode(roles)).select("*", "_r.role", "_r.avg_used").drop("_r")
    m = with_masks(r, c, "avg_used", "gap_days", "price_difference", mults, days, prices, money_scale)
    m = m.withColumn("fmask", setting_mask(mults, days, prices))
    # the compressed table feeds both the shares and the vehicle sets: written once
    # (reliable checkpoint), so the upstream pass is not repeated per consumer
    a = m.groupBy("role", "month", c.entity, "fmask").agg(F.count(F.lit(1)).alias("n")).checkpoint(eager=True)
    grid = settings_array(mults, days, prices, money_scale)
    setting = ["multiplier", "days_threshold", "price_diff"]
    sidx = (F.col("i") * len(days) + F.col("j")) * len(prices) + F.col("k")

    def on(mask):
        return _bit(F.col(mask), sidx) == 1

    share = (a.groupBy("role", "month", "fmask").agg(F.sum("n").alias("n"))
             .withColumn("s", F.explode(grid)).select("*", "s.*").drop("s")
             .groupBy("role", "month", *setting)
             .agg((F.sum(F.when(on("fmask"), F.col("n")).otherwise(0)).cast("double") / F.sum("n")).alias("share")))
    ent = a.where(F.col("fmask") != 0).groupBy("role", "month", c.entity).agg(F.bit_or("fmask").alias("fm"))
    vm = ent.where(F.col("role") == "val").select(F.col("month").alias("val_month"), c.entity, F.col("fm").alias("vmask"))
    tm = ent.where(F.col("role") == "test").select(F.col("month").alias("test_month"), c.entity, F.col("fm").alias("tmask"))
    vt = (trip.join(vm, "val_month").select(*tkeys, c.entity, "vmask")
          .join(trip.join(tm, "test_month").select(*tkeys, c.entity, "tmask"), [*tkeys, c.entity], "full")
          .fillna(0, ["vmask", "tmask"]))
    # entities compress to distinct (vmask, tmask) pairs before the grid
    ov = (vt.groupBy(*tkeys, "vmask", "tmask").agg(F.count(F.lit(1)).alias("ne"))
          .withColumn("s", F.explode(grid)).select("*", "s.*").drop("s")
          .groupBy(*tkeys, *setting).agg(
              F.sum(F.when(on("vmask") & on("tmask"), F.col("ne")).otherwise(0)).alias("n_inter"),
              F.sum(F.when(on("vmask") | on("tmask"), F.col("ne")).otherwise(0)).alias("n_union"),
              F.sum(F.when(on("vmask"), F.col("ne")).otherwise(0)).alias("n_val"),
              F.sum(F.when(on("tmask"), F.col("ne")).otherwise(0)).alias("n_test")))
    base = (trip.withColumn("s", F.explode(grid))
            .select(*tkeys, "s.multiplier", "s.days_threshold", "s.price_diff"))
    vs = share.where(F.col("role") == "val").select(F.col("month").alias("val_month"), *setting, F.col("share").alias("_vs"))
    ts_ = share.where(F.col("role") == "test").select(F.col("month").alias("test_month"), *setting, F.col("share").alias("_ts"))
    out = (base.join(vs, ["val_month", *setting], "left").join(ts_, ["test_month", *setting], "left")
           .join(ov, [*tkeys, *setting], "left"))
    overlap = F.when((F.coalesce(F.col("n_val"), F.lit(0)) > 0) & (F.coalesce(F.col("n_test"), F.lit(0)) > 0),
                     F.col("n_inter").cast("double") / F.col("n_union")).otherwise(F.lit(0.0))
    vs_, ts2 = F.col("_vs"), F.col("_ts")
    return out.select(
        *tkeys, *setting, (vs_ * F.lit(100.0)).alias("val_pct_multi_flags"),
        (ts2 * F.lit(100.0)).alias("test_pct_multi_flags"),
        ((F.lit(1.0) - F.abs(vs_ - ts2)) * F.lit(100.0)).alias("consistency_score"),
        (overlap * F.lit(100.0)).alias("vehicle_overlap"))


def validation_summary(validation: DataFrame) -> DataFrame:
    """HF-13: mean consistency and overlap per setting, best first."""
    setting = ["multiplier", "days_threshold", "price_diff"]
    label = F.concat(F.lit("M:"), F.col("multiplier").cast("string"), F.lit(", D:"),
                     F.col("days_threshold").cast("string"), F.lit(", P:R"), F.col("price_diff").cast("string"))
    return (validation.groupBy(*setting)
            .agg(F.avg("consistency_score").alias("consistency_score"), F.avg("vehicle_overlap").alias("vehicle_overlap"))
            .withColumn("param_combo", label))
