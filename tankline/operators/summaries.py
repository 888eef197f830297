"""Chart-ready summary tables (SM-1..SM-10): the data behind each plot, never the plot.

Ties in every top-n are broken by the key in ascending order (pandas
``nlargest`` keeps the first of equal values in sorted-key order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.joins import attach
from tankline.operators.ranking import exact_quantiles_by

OTHERS = "Others"
OTHER = "Other"


def counts_with_others(df: DataFrame, col: str, threshold: int, always_others: bool = False,
                       max_length: int = 50) -> DataFrame:
    """SM-1: value counts (nulls dropped); values below ``threshold`` summed into
    'Others', which appears only when positive unless ``always_others``; names cut
    with the EDA ellipsis rule."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    big = F.col("n") >= threshold
    lab = F.when(big, F.col(col).cast("string")).otherwise(F.lit(OTHERS))
    out = vc.groupBy(lab.alias("label")).agg(F.sum("n").alias("n"))
    if not always_others:
        out = out.where((F.col("label") != OTHERS) | (F.col("n") > 0))
    return out.select(X.truncate("label", max_length, keep_room=True).alias("label"), "n")


def top_means_other(df: DataFrame, cat: str, x: str, n: int = 9) -> DataFrame:
    """SM-2: the n categories with the largest mean of x plus 'Other' = the mean of
    the remaining categories' means (V21); rows per category as ``n_obs``."""
    g = (df.where(F.col(cat).isNotNull()).groupBy(cat)
         .agg((F.sum(x).cast("double") / F.count(x)).alias("mean"), F.count(F.lit(1)).alias("n_obs")))
    rk = F.row_number().over(Window.orderBy(F.desc_nulls_last("mean"), F.col(cat)))  # one row per category
    g = g.withColumn("_rk", rk)
    top = g.where(F.col("_rk") <= n).select(F.col(cat).cast("string").alias("label"), "mean", "n_obs")
    rest = g.where(F.col("_rk") > n).agg(F.lit(OTHER).alias("label"), F.avg("mean").alias("mean"),
                                          F.sum("n_obs").alias("n_obs"))
    return top.unionByName(rest.where(F.col("n_obs").isNotNull()))


def histogram(df: DataFrame, x: str, bins: int = 20) -> DataFrame:
    """SM-3: equal-width histogram over [min, max], last bin closed, empty bins kept."""
    clean = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")))
    mm = clean.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    spark = df.sparkSession
    edges = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    if lo is None:
        return edges.select("bin", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
                            F.lit(0).cast("bigint").alias("n"))
    w = (hi - lo) / bins
    b = X.equal_width_bin(F.col(x).cast("double"), F.lit(lo), F.lit(hi), bins)
    counts = clean.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return (edges.join(counts, "bin", "left")
            .select("bin", (F.lit(lo) + F.col("bin") * F.lit(w)).alias("lo"),
                    F.when(F.col("bin") == bins - 1, F.lit(hi)).otherwise(F.lit(lo) + (F.col("bin") + 1) * F.lit(w)).alias("hi"),
                    F.coalesce("n", F.lit(0)).cast("bigint").alias("n")))


def box_stats(df: DataFrame, cat: str, x: str) -> DataFrame:
    """SM-4: per category quartiles (linear interpolation, V15), IQR, whiskers at the
    most extreme values within 1.5 IQR of the box, outlier count. The quartiles come from
    ranks over (category, value) ranges, so no reducer holds a category's values."""
    d = df.where(F.col(cat).isNotNull() & F.col(x).isNotNull())
    qs = exact_quantiles_by(d, cat, x, [0.25, 0.5, 0.75])
    qs = qs.select(cat, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    qs = qs.withColumn("iqr", F.col("q3") - F.col("q1"))
    j = attach(d, qs, cat, "inner")
    lo_f = F.col("q1") - F.lit(1.5) * F.col("iqr")
    hi_f = F.col("q3") + F.lit(1.5) * F.col("iqr")
    xv = F.col(x).cast("double")
    return j.groupBy(cat, "n", "q1", "median", "q3", "iqr").agg(
        F.min(F.when(xv >= lo_f, xv)).alias("whisker_low"),
        F.max(F.when(xv <= hi_f, xv)).alias("whisker_high"),
        F.count_if((xv < lo_f) | (xv > hi_f)).alias("n_outliers"))


def top_n_values(df: DataFrame, col: str, n: int = 5) -> DataFrame:
    """The n most frequent non-null values (ties by value)."""
    vc = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return vc.orderBy(F.desc("_n"), col).limit(n).select(col)


def lump_top(df: DataFrame, col: str, n: int = 5, out: str | None = None) -> DataFrame:
    """SM-5: keep the top-n values, everything else (and null) becomes 'Other'."""
    top = top_n_values(df, col, n).withColumn("_top", F.lit(True))
    j = df.join(F.broadcast(top), col, "left")  # n rows: bounded
    return j.withColumn(out or f"{col}_top", F.when(F.col("_top"), F.col(col).cast("string"))
                        .otherwise(F.lit(OTHER))).drop("_top")


def group_labels(df: DataFrame, group: str) -> DataFrame:
    """Cluster label rule of the proportion tables: 0-based labels shift to 1-based
    text, -1 becomes 'None', other labels are kept as text."""
    mn = df.agg(F.min(group)).first()[0]
    g = F.col(group)
    if mn is not None and not isinstance(mn, str) and mn in (0, -1):
        lab = F.when(g == -1, F.lit("None")).otherwise((g + 1).cast("string"))
    else:
        lab = g.cast("string")
    return df.withColumn("group_label", lab)


def proportions(df: DataFrame, group: str, cat: str, max_categories: int = 8, max_length: int = 20) -> DataFrame:
    """SM-6: share of each category inside each group; the max_categories with the
    largest summed share are kept, the rest summed into 'Others'; every group gets
    every kept category (zero-filled, like ``unstack``); names cut (FN-7); shares
    rounded half-even to 2 places (V16, D17). Long form: (group_label, category,
    proportion)."""
    d = df.where(F.col(group).isNotNull() & F.col(cat).isNotNull())
    c = d.groupBy(group, cat).agg(F.count(F.lit(1)).alias("n"))
    tot = d.groupBy(group).agg(F.count(F.lit(1)).alias("_t"))
    share = c.join(tot, group).withColumn("p", F.col("n") / F.col("_t"))
    rank = (share.groupBy(cat).agg(F.sum("p").alias("_s"))
            .withColumn("_r", F.row_number().over(Window.orderBy(F.desc("_s"), F.col(cat)))))  # one row per category
    kept = [r[0] for r in rank.where(F.col("_r") <= max_categories).select(F.col(cat).cast("string")).collect()]
    lab = F.when(F.col(cat).cast("string").isin(kept), F.col(cat).cast("string")).otherwise(F.lit(OTHERS))
    p = share.groupBy(group, lab.alias("category")).agg(F.sum("p").alias("p"))
    grid = group_labels(tot, group).select(group, "group_label", F.explode(
        F.array(*[F.lit(k) for k in kept + [OTHERS]])).alias("category"))
    out = grid.join(p, [group, "category"], "left")
    return out.select("group_label", X.truncate("category", max_length).alias("category"),
                      F.bround(F.coalesce(F.col("p"), F.lit(0.0)), 2).alias("proportion"))


def counts_in_top(df: DataFrame, main: str, cat: str, n: int = 5) -> DataFrame:
    """SM-7: counts of ``cat`` inside each of the top-n values of ``main``."""
    top = top_n_values(df, main, n)
    d = df.join(F.broadcast(top), main, "left_semi")
    return d.groupBy(main, cat).agg(F.count(F.lit(1)).alias("n"))


def top_per_group(df: DataFrame, group: str, cat: str, n: int = 3) -> DataFrame:
    """SM-10 / WN-5: the n most frequent categories per group (ties by category).
    The window runs on the (group, category) counts, not on rows."""
    c = df.where(F.col(cat).isNotNull()).groupBy(group, cat).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), F.col(cat))
    return c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def cluster_sizes(df: DataFrame, group: str) -> DataFrame:
    """SM-9: size and share of each cluster."""
    c = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    total = df.count()
    return c.withColumn("share", F.col("size") / F.lit(float(total)))


def cluster_profile(df: DataFrame, group: str, numeric: Sequence[str], categorical: Sequence[str],
                    top: int = 3) -> DataFrame:
    """SM-8: per cluster size, share, means of numeric columns and the top categories
    of each categorical column as 'value (count)' text, ordered by count."""
    total = df.count()
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"),
                                 *[(F.sum(c).cast("double") / F.count(c)).alias(f"mean_{c}") for c in numeric])
    base = base.withColumn("share", F.col("size") / F.lit(float(total)))
    for c in categorical:
        t = top_per_group(df, group, c, top)
        txt = (t.groupBy(group).agg(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("rank", F.concat(F.col(c).cast("string"), F.lit(" ("),
                                                                   F.col("n").cast("string"), F.lit(")")).alias("v")))),
            lambda s: s["v"]), ", ").alias(f"top_{c}")))
        base = base.join(txt, group, "left")
    return base
