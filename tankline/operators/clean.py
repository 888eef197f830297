"""Cleaning, reshaping and register operators (PRJ-*, FLT-*, RS-*, ST-*, PP-1, PP-2,
PP-4, WN-7). All are narrow expressions or single aggregations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.functions import expr as X

# The site prefix rules of the reference (text starting with the
# key becomes the value), applied in this order.
SITE_PREFIX_RULES = [("0", "UNKNOWN"), ("43501", "UNKNOWN")]


# ------------------------------------------------------------------ filters

def drop_null(df: DataFrame, subset: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """FLT-1 / FLT-2 / FLT-3: drop rows with nulls (any / all) in ``subset``; NaN
    counts as null as in pandas."""
    cols = list(subset or df.columns)
    numeric = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    is_null = [F.col(c).isNull() | (F.isnan(c) if c in numeric else F.lit(False)) for c in cols]
    if how == "any":
        keep = ~_or(is_null)
    else:
        keep = ~_and(is_null)
    return df.where(keep)


def _or(cs):
    out = cs[0]
    for c in cs[1:]:
        out = out | c
    return out


def _and(cs):
    out = cs[0]
    for c in cs[1:]:
        out = out & c
    return out


def drop_non_finite(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """FLT-9: +-inf -> null, then drop the rows."""
    for c in cols:
        df = df.withColumn(c, X.finite_or_null(c))
    return drop_null(df, cols)


def cleaning_chain(df: DataFrame, required: Sequence[str], keep_values: tuple[str, Sequence[str]] | None = None,
                   drop_values: tuple[str, Sequence[str]] | None = None,
                   drop_pattern: tuple[str, str] | None = None, equals: tuple[str, str] | None = None,
                   range_: tuple[str, float, float] | None = None) -> DataFrame:
    """PP-2: one filter chain -- nulls in required columns (FLT-1), IN list (FLT-5),
    NOT IN list (FLT-4), NOT regex (FLT-6), equality (FLT-7), range lo < x <= hi (FLT-8).
    Catalyst merges the chain into one Filter pushed to the scan where possible."""
    out = drop_null(df, required)
    if keep_values:
        out = out.where(F.col(keep_values[0]).isin(list(keep_values[1])))
    if drop_values:
        out = out.where(~F.col(drop_values[0]).isin(list(drop_values[1])))
    if drop_pattern:
        out = out.where(~F.coalesce(F.col(drop_pattern[0]).rlike(drop_pattern[1]), F.lit(False)))
    if equals:
        out = out.where(F.col(equals[0]) == F.lit(equals[1]))
    if range_:
        c, lo, hi = range_
        out = out.where((F.col(c) > F.lit(lo)) & (F.col(c) <= F.lit(hi)))
    return out


# ------------------------------------------------------------------ columns

def fuel_type_from_list(df: DataFrame, model_col: str, petrol_models: DataFrame, out: str = "fuel_type",
                        default: str = "Diesel") -> DataFrame:
    """PRJ-4: class by membership in a list, default otherwise. The list is a
    dimension (one column ``model``) joined by equality (semi-join flag)."""
    from tankline.operators.joins import checked_broadcast
    flagged = checked_broadcast(petrol_models.select(F.col("model").alias("_m")).distinct().withColumn("_petrol", F.lit(True)))
    j = df.join(flagged, df[model_col] == flagged["_m"], "left")
    return j.withColumn(out, F.when(F.col("_petrol"), F.lit("Petrol")).otherwise(F.lit(default))).drop("_m", "_petrol")


def cluster_label(df: DataFrame, col: str, out: str | None = None, prefix: str = "Cluster ") -> DataFrame:
    """PRJ-10: 1-based friendly label when the labels start at 0 (noise -1 -> 'None'),
    'Cluster ' prefix, trailing '.0' stripped."""
    out = out or col
    mn = df.agg(F.min(col)).first()[0]  # one scalar to the driver
    shift = mn is not None and mn <= 0
    shifted = F.col(col) + 1 if shift else F.col(col)
    txt = F.regexp_replace(shifted.cast("string"), r"\.0$", "")
    return df.withColumn(out, F.when(F.col(col) == -1, F.lit("None")).otherwise(F.concat(F.lit(prefix), txt)))


def with_ordinal(df: DataFrame, col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """PRJ-11: ordered categorical as an ordinal column from an explicit order."""
    expr = F.lit(None).cast("int")
    for i, v in enumerate(order):
        expr = F.when(F.col(col) == v, F.lit(i)).otherwise(expr)
    return df.withColumn(out or f"{col}_ord", expr)


def site_cleanup(df: DataFrame, col: str = "site", rules=SITE_PREFIX_RULES, names_map: DataFrame | None = None) -> DataFrame:
    """PP-4: null -> UNKNOWN (PRJ-7), upper (FN-1), optional fuzzy map (PP-3), title
    case (FN-2), then the prefix rules (FN-6) and the single label 'Unknown' (D19)."""
    c = F.upper(F.coalesce(F.col(col), F.lit("UNKNOWN")))
    out = df.withColumn(col, c)
    if names_map is not None:
        from tankline.operators.joins import checked_broadcast
        m = checked_broadcast(names_map.select(F.col("name").alias("_n"), F.col("representative").alias("_r")))
        out = out.join(m, out[col] == m["_n"], "left").withColumn(
            col, F.coalesce("_r", col)).drop("_n", "_r")
    out = out.withColumn(col, X.title_case(col))
    out = out.withColumn(col, X.prefix_rules(col, rules))
    return out.withColumn(col, F.when(F.upper(F.col(col)) == "UNKNOWN", F.lit("Unknown")).otherwise(F.col(col)))


# --------------------------------------------------------------- identifiers

def anonymise(df: DataFrame, col: str, prefix: str, out: str | None = None) -> DataFrame:
    """WN-7: replace ids by prefix + 1-based rank of the sorted distinct id.
    Ranks come from a distributed sort of the distinct ids, joined back."""
    from tankline.operators.joins import attach
    from tankline.operators.ranking import dense_rank_keys
    ranked = dense_rank_keys(df, col, "_rk")
    j = attach(df, ranked, col, "left")
    return j.withColumn(out or col, F.concat(F.lit(prefix), F.col("_rk").cast("string"))).drop("_rk")


# ----------------------------------------------------------------- reshape

def register_consolidated(white: DataFrame, ems: DataFrame, new_col: str = "reg_no", old_col: str = "old_reg",
                          keep: Sequence[str] = ("site", "district")) -> DataFrame:
    """PP-1: union of the registers (ST-1), plates unpivoted to one column (RS-1),
    rows without a plate dropped, sorted (ST-2)."""
    u = white.unionByName(ems)
    long = u.unpivot([*keep], [new_col, old_col], "plate_kind", "plate").where(F.col("plate").isNotNull())
    return long.select("plate", "plate_kind", *keep).orderBy("plate", "plate_kind")


def monthly_matrix(df: DataFrame, entity: str, ts: str, measures: Sequence[str], months: Sequence[str]) -> DataFrame:
    """AG-7 + RS-3 (CL-4): per entity and month the sum of each measure, pivoted to
    ``<measure>_<yyyy-MM>`` columns with 0 for missing months. ``months`` is the
    explicit pivot list (bounded by the calendar)."""
    m = df.withColumn("_m", F.date_format(F.col(ts), "yyyy-MM"))
    agg = m.groupBy(entity, "_m").agg(*[F.sum(x).alias(x) for x in measures])
    wide = agg.groupBy(entity).pivot("_m", list(months)).agg(*[F.first(x).alias(x) for x in measures])
    cols = [entity]
    for mo in months:
        for x in measures:
            src = f"{mo}_{x}" if len(measures) > 1 else mo
            cols.append(F.coalesce(F.col(f"`{src}`"), F.lit(0)).alias(f"{x}_{mo}"))
    return wide.select(*cols)


def contingency(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """RS-4 / AG-14: two-key counts as a matrix, missing = 0, explicit column list."""
    p = df.groupBy(row).pivot(col, list(values)).count()
    return p.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values])


def one_hot(df: DataFrame, col: str, values: Sequence[str], prefix: str | None = None) -> DataFrame:
    """RS-7: one 0/1 column per known value (``get_dummies``)."""
    p = prefix or col
    return df.select("*", *[(F.col(col) == F.lit(v)).cast("int").alias(f"{p}_{v}") for v in values])


def record_to_long(df: DataFrame, id_cols: Sequence[str] = ()) -> DataFrame:
    """RS-6: one-row record to (variable, value) pairs."""
    vals = [c for c in df.columns if c not in set(id_cols)]
    casted = df.select(*id_cols, *[F.col(c).cast("double").alias(c) for c in vals])
    return casted.unpivot(list(id_cols), vals, "variable", "value")


def attach_coordinates(df: DataFrame, place: str, coords: DataFrame, suffix: str | None = None,
                       region: str | None = None, prefix: str = "") -> DataFrame:
    """JN-11: coordinates of a place looked up by its text plus a region suffix
    ('<place>, <region>'), once per distinct place, then joined back; unknown
    places get null. ``coords`` has (address, lat, lon)."""
    addr = F.concat_ws(", ", F.col(place), F.col(region) if region else F.lit(suffix))
    places = df.select(place, *([region] if region else [])).distinct().withColumn("_addr", addr)
    found = places.join(coords.select(F.col("address").alias("_addr"), "lat", "lon"), "_addr", "left")
    keys = [place, *([region] if region else [])]
    from tankline.operators.joins import attach
    out = attach(df, found.drop("_addr"), keys, "left")
    return out.withColumnRenamed("lat", f"{prefix}lat").withColumnRenamed("lon", f"{prefix}lon")
