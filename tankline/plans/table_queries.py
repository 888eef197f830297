"""Queries of the table operators: cleaning, reshaping, registers, names, profiles,
summaries and gap features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators import clean as CL
from tankline.operators import fuzzy as FZ
from tankline.operators import profile as PF
from tankline.operators import summaries as SM
from tankline.operators import temporal as T
from tankline.plans.registry import query
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG


def title_sql(col: str) -> str:
    """DuckDB text of Python's ``str.title`` on ASCII (letter after a non-letter is upper)."""
    lx = f"lower({col})"
    return (f"array_to_string(list_transform(range(1, length({lx}) + 1), lambda i: CASE WHEN i = 1 OR NOT "
            f"regexp_matches(substr({lx}, i - 1, 1), '^[a-z]$') THEN upper(substr({lx}, i, 1)) "
            f"ELSE substr({lx}, i, 1) END), '')")


def norm_sql(col: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(lower({col}), '[^a-z0-9]+', ' ', 'g'), '\\s+', ' ', 'g'))")


def trunc_sql(col: str, n: int, keep_room: bool = False) -> str:
    cut = n - 3 if keep_room else n
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {cut}) || '...' ELSE {col} END"


# ------------------------------------------------------------------ cleaning

@query("cleaning_chain", covers=("PP-2", "FLT-1", "FLT-4", "FLT-5", "FLT-6", "FLT-7", "FLT-8", "PRJ-1", "PRJ-3"),
       sql=FX.with_views("""
SELECT txn_id, entity_id, amount_cents FROM txn
WHERE litres IS NOT NULL
  AND category IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY', 'HOUSEHOLD')
  AND department NOT IN ('5-LOW')
  AND NOT COALESCE(regexp_matches(site, 'NATION_1[0-4]'), FALSE)
  AND fuel_type = 'Diesel'
  AND amount_cents > 0 AND amount_cents <= 20000000""", "txn"))
def cleaning_chain(spark, sf):
    t = SG.stage(spark, sf, "txn")
    out = CL.cleaning_chain(t, ["litres"], keep_values=("category", ["AUTOMOBILE", "BUILDING", "MACHINERY", "HOUSEHOLD"]),
                            drop_values=("department", ["5-LOW"]), drop_pattern=("site", "NATION_1[0-4]"),
                            equals=("fuel_type", "Diesel"), range_=("amount_cents", 0, 20000000))
    return out.select("txn_id", "entity_id", "amount_cents")


@query("site_cleanup", covers=("PP-4", "FN-1", "FN-2", "FN-6", "PRJ-7", "D19", "V9"), sql=FX.with_views(f"""
SELECT reg_no, CASE WHEN upper(s3) = 'UNKNOWN' THEN 'Unknown' ELSE s3 END AS site
FROM (SELECT reg_no, CASE WHEN starts_with(s2, '43501') THEN 'UNKNOWN' ELSE s2 END AS s3
      FROM (SELECT reg_no, CASE WHEN starts_with(s1, '0') THEN 'UNKNOWN' ELSE s1 END AS s2
            FROM (SELECT reg_no, {title_sql("upper(COALESCE(site, 'UNKNOWN'))")} AS s1 FROM register) a) b) c""",
                                                                                                "register"))
def site_cleanup(spark, sf):
    return CL.site_cleanup(SG.stage(spark, sf, "register"), "site").select("reg_no", "site")


@query("fn_text", covers=("FN-1", "FN-2", "FN-3", "FN-4", "FN-5", "FN-7", "FN-9", "V9"), sql=FX.with_views(f"""
SELECT name_id, upper(name) AS upper_name, {title_sql("name")} AS title_name, trim('  ' || name || ' ') AS trimmed,
       replace(name, ' ', '_') AS replaced, regexp_replace(name, '[aeiou]+', '', 'g') AS no_vowels,
       {trunc_sql("name", 8, True)} AS short_eda, {trunc_sql("name", 8)} AS short_plot,
       {norm_sql("name")} AS norm,
       CASE WHEN greatest(length(name), length(upper(name))) = 0 THEN CAST(100 AS DOUBLE)
            ELSE CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - levenshtein(name, upper(name)) / greatest(length(name), length(upper(name)))) END AS sim_upper
FROM names""", "names"))
def fn_text(spark, sf):
    n = SG.stage(spark, sf, "names")
    return n.select(
        "name_id", F.upper("name").alias("upper_name"), X.title_case("name").alias("title_name"),
        F.trim(F.concat(F.lit("  "), F.col("name"), F.lit(" "))).alias("trimmed"),
        F.replace(F.col("name"), F.lit(" "), F.lit("_")).alias("replaced"),
        F.regexp_replace("name", "[aeiou]+", "").alias("no_vowels"),
        X.truncate("name", 8, keep_room=True).alias("short_eda"), X.truncate("name", 8).alias("short_plot"),
        X.normalise_text("name").alias("norm"), X.similarity_ratio(F.col("name"), F.upper("name")).alias("sim_upper"))


@query("name_consolidation", covers=("PP-3", "JN-13", "JN-10", "FN-9", "D18"), sql=FX.with_views(f"""
SELECT n.name, arg_max(b.best, b.best_fs) AS representative, MIN(n.first_seen) AS first_seen
FROM nm n
JOIN (SELECT norm AS src, norm AS other FROM nm UNION SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) s ON s.src = n.norm
JOIN best b ON b.norm = s.other
GROUP BY n.name""", "names", ctes=[f"""
nm AS (SELECT name, MIN(name_id) AS first_seen, {norm_sql("name")} AS norm FROM names WHERE name IS NOT NULL GROUP BY name)""", """
best AS (SELECT norm, arg_max(name, first_seen) AS best, MAX(first_seen) AS best_fs FROM nm GROUP BY norm)""", """
dn AS (SELECT DISTINCT norm FROM nm WHERE length(norm) > 0)""", """
pairs AS (SELECT a.norm AS a, b.norm AS b FROM dn a JOIN dn b ON a.norm < b.norm
          WHERE 100 * levenshtein(a.norm, b.norm) <= 5 * greatest(length(a.norm), length(b.norm)))"""]))
def name_consolidation(spark, sf):
    return FZ.consolidate_names(SG.stage(spark, sf, "names"), "name", "name_id", threshold=95.0)


CONS_BODY = """
SELECT n.name, arg_max(b.best, b.best_fs) AS representative, MIN(n.first_seen) AS first_seen
FROM nm n
JOIN (SELECT norm AS src, norm AS other FROM nm UNION SELECT a, b FROM pairs UNION SELECT b, a FROM pairs) s ON s.src = n.norm
JOIN best b ON b.norm = s.other
GROUP BY n.name"""


def _consolidation_ctes(threshold: int) -> list[str]:
    return [f"""
nm AS (SELECT name, MIN(name_id) AS first_seen, {norm_sql("name")} AS norm FROM names WHERE name IS NOT NULL GROUP BY name)""", """
best AS (SELECT norm, arg_max(name, first_seen) AS best, MAX(first_seen) AS best_fs FROM nm GROUP BY norm)""", """
dn AS (SELECT DISTINCT norm FROM nm WHERE length(norm) > 0)""", f"""
pairs AS (SELECT a.norm AS a, b.norm AS b FROM dn a JOIN dn b ON a.norm < b.norm
          WHERE 100 * levenshtein(a.norm, b.norm) <= {100 - threshold} * greatest(length(a.norm), length(b.norm)))"""]


def _consolidation_sql(threshold: int) -> str:
    return FX.with_views(CONS_BODY, "names", ctes=_consolidation_ctes(threshold))


@query("name_consolidation_85", covers=("PP-3", "JN-13", "JN-10"), sql=_consolidation_sql(85))
def name_consolidation_85(spark, sf):
    """Same rule at threshold 85, where plural variants of the short fixture names match."""
    return FZ.consolidate_names(SG.stage(spark, sf, "names"), "name", "name_id", threshold=85.0)


@query("name_groups", covers=("PP-3", "JN-13"), sql=FX.with_views("""
SELECT nm.name, r.representative, nm.first_seen, r.group_size
FROM nm JOIN comp USING (norm) JOIN (
  SELECT root, arg_max(name, first_seen) AS representative, COUNT(*) AS group_size
  FROM nm JOIN comp USING (norm) GROUP BY root) r USING (root)""", "names", ctes=[*_consolidation_ctes(70), """
reach AS (SELECT DISTINCT norm AS src, norm AS dst FROM nm
          UNION SELECT reach.src, p.dst FROM reach JOIN (SELECT a AS src, b AS dst FROM pairs UNION ALL SELECT b, a FROM pairs) p
          ON p.src = reach.dst)""", """
comp AS (SELECT src AS norm, MIN(dst) AS root FROM reach GROUP BY src)"""], recursive=True))
def name_groups(spark, sf):
    """Transitive groups at threshold 70, where chains of the short fixture names form."""
    return FZ.name_groups(SG.stage(spark, sf, "names"), "name", "name_id", threshold=70.0)


@query("names_replaced", covers=("JN-10",), sql=FX.with_views("""
SELECT t.name_id, COALESCE(m.representative, t.name) AS name FROM names t LEFT JOIN cons m ON m.name = t.name""",
                                                           "names", ctes=[*_consolidation_ctes(85),
                                                                          f"cons AS ({CONS_BODY})"]))
def names_replaced(spark, sf):
    n = SG.stage(spark, sf, "names")
    return FZ.replace_names(n, "name", FZ.consolidate_names(n, "name", "name_id", threshold=85.0)).select("name_id", "name")


@query("similar_names", covers=("JN-13", "FN-9"), sql=FX.with_views(f"""
SELECT a.norm AS a, b.norm AS b,
       CAST(100 AS DOUBLE) * (CAST(1 AS DOUBLE) - levenshtein(a.norm, b.norm) / greatest(length(a.norm), length(b.norm))) AS score
FROM dn a JOIN dn b ON a.norm < b.norm
WHERE 100 * levenshtein(a.norm, b.norm) <= 15 * greatest(length(a.norm), length(b.norm))""", "names", ctes=[f"""
dn AS (SELECT DISTINCT {norm_sql("name")} AS norm FROM names WHERE name IS NOT NULL AND length({norm_sql("name")}) > 0)"""]))
def similar_names(spark, sf):
    n = SG.stage(spark, sf, "names").where(F.col("name").isNotNull()).select(X.normalise_text("name").alias("norm"))
    return FZ.similar_pairs(n, "norm", 85.0)


# ------------------------------------------------------------------ registers

REG_LONG_SQL = """
reg_long AS (
  SELECT reg_no AS plate, 'reg_no' AS plate_kind, site, district, source FROM register
  UNION ALL
  SELECT old_reg AS plate, 'old_reg' AS plate_kind, site, district, source FROM register WHERE old_reg IS NOT NULL)"""


def _reg_long(spark, sf):
    r = SG.stage(spark, sf, "register")
    white = r.where(F.col("source") == "white")
    ems = r.where(F.col("source") == "ems")
    return CL.register_consolidated(white, ems, keep=("site", "district", "source"))


@query("register_consolidated", covers=("PP-1", "ST-1", "ST-2", "RS-1", "SRC-2"),
       sql=FX.with_views("SELECT plate, plate_kind, site, district, source FROM reg_long", "register", ctes=[REG_LONG_SQL]))
def register_consolidated(spark, sf):
    return _reg_long(spark, sf)


@query("register_join", covers=("JN-1", "JN-2", "V11"), sql=FX.with_views("""
SELECT t.txn_id, t.entity_id, r.plate_kind, r.site AS reg_site, r.source
FROM txn t LEFT JOIN reg_long r ON r.plate = t.entity_id""", "txn", "register", ctes=[REG_LONG_SQL]))
def register_join(spark, sf):
    t = SG.stage(spark, sf, "txn").select("txn_id", "entity_id")
    r = _reg_long(spark, sf).select("plate", "plate_kind", F.col("site").alias("reg_site"), "source")
    return t.join(r, t.entity_id == r.plate, "left").select("txn_id", "entity_id", "plate_kind", "reg_site", "source")


@query("anonymised", covers=("WN-7",), sql=FX.with_views("""
SELECT txn_id, 'ANON_' || CAST(DENSE_RANK() OVER (ORDER BY entity_id) AS VARCHAR) AS anon_entity FROM txn""", "txn"))
def anonymised(spark, sf):
    t = SG.stage(spark, sf, "txn").select("txn_id", "entity_id")
    return CL.anonymise(t, "entity_id", "ANON_", out="anon_entity").select("txn_id", "anon_entity")


# ------------------------------------------------------------------ gap features

@query("rolling_and_diff", covers=("WN-3", "WN-4", "V8"), sql=FX.with_views("""
SELECT txn_id,
       CASE WHEN prev_ts IS NOT NULL AND litres IS NOT NULL AND prev_l IS NOT NULL THEN (litres + prev_l) / CAST(2 AS DOUBLE) END AS rolling2_mean,
       CASE WHEN prev_ts IS NOT NULL THEN litres - prev_l END AS diff
FROM (SELECT txn_id, litres, LAG(litres) OVER w AS prev_l, LAG(ts) OVER w AS prev_ts FROM txn
      WINDOW w AS (PARTITION BY entity_id ORDER BY ts, txn_id)) x""", "txn"))
def rolling_and_diff(spark, sf):
    return T.with_rolling_and_diff(SG.stage(spark, sf, "txn"), "litres").select("txn_id", "rolling2_mean", "diff")


def _band_sql(x: str) -> str:
    edges, labels = T.GAP_BANDS
    parts = []
    for lo, hi, lab in zip(edges[:-1], edges[1:], labels):
        hi_c = f" AND {x} <= {hi}" if hi != float("inf") else ""
        parts.append(f"WHEN {x} > {lo}{hi_c} THEN '{lab}'")
    return "CASE " + " ".join(parts) + " END"


@query("gap_bands", covers=("FN-16", "WN-1", "V7", "FN-11"), sql=FX.with_views(f"""
SELECT txn_id, gap_days, {_band_sql("gap_days")} AS gap_band, monthname(ts) AS month_name, dayname(ts) AS weekday_name,
       strftime(ts, '%Y-%m') AS month_text
FROM (SELECT txn_id, ts, date_sub('day', LAG(ts) OVER (PARTITION BY entity_id ORDER BY ts, txn_id), ts) AS gap_days FROM txn) x""",
                                                                                       "txn"))
def gap_bands(spark, sf):
    g = T.with_gap_band(T.with_gap_days(SG.stage(spark, sf, "txn")))
    return g.select("txn_id", "gap_days", "gap_band", X.month_name("ts").alias("month_name"),
                    X.weekday_name("ts").alias("weekday_name"), F.date_format("ts", "yyyy-MM").alias("month_text"))


@query("avg_gap", covers=("PP-7", "JN-3", "AG-4"), sql=FX.with_views("""
SELECT r.reg_no, g.avg_gap_days FROM register r LEFT JOIN (
  SELECT entity_id, CAST(SUM(gap) AS DOUBLE) / COUNT(gap) AS avg_gap_days
  FROM (SELECT entity_id, date_sub('day', LAG(ts) OVER (PARTITION BY entity_id ORDER BY ts, txn_id), ts) AS gap FROM txn) x
  GROUP BY entity_id) g ON g.entity_id = r.reg_no""", "txn", "register"))
def avg_gap(spark, sf):
    g = T.avg_gap_per_entity(SG.stage(spark, sf, "txn"))
    r = SG.stage(spark, sf, "register").select("reg_no")
    return r.join(g, r.reg_no == g.entity_id, "left").select("reg_no", "avg_gap_days")


# ------------------------------------------------------------------ reshape

MONTHS = [f"{y}-{m:02d}" for y in range(1995, 2002) for m in range(1, 13) if (y, m) <= (2001, 8)]


@query("monthly_matrix", covers=("AG-7", "RS-3", "CL-4", "FN-12"), sql=FX.with_views(
    "SELECT entity_id, " + ", ".join(
        f"COALESCE(SUM(CASE WHEN mo = '{mo}' THEN {x} END), 0) AS \"{x}_{mo}\""
        for mo in MONTHS for x in ("amount_cents", "litres")) +
    " FROM (SELECT entity_id, strftime(ts, '%Y-%m') AS mo, amount_cents, litres FROM txn) x GROUP BY entity_id", "txn"))
def monthly_matrix(spark, sf):
    t = SG.stage(spark, sf, "txn")
    lo, hi = t.agg(F.min("ts"), F.max("ts")).first()  # two scalars: the calendar span
    months, y, m = [], lo.year, lo.month
    while (y, m) <= (hi.year, hi.month):
        months.append(f"{y}-{m:02d}")
        y, m = (y + 1, 1) if m == 12 else (y, m + 1)
    return CL.monthly_matrix(t, "entity_id", "ts", ["amount_cents", "litres"], months)


DEPTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("contingency", covers=("RS-4", "AG-14"), sql=FX.with_views(
    "SELECT category, " + ", ".join(f"SUM(CASE WHEN department = '{d}' THEN 1 ELSE 0 END) AS \"{d}\"" for d in DEPTS)
    + " FROM txn GROUP BY category", "txn"))
def contingency(spark, sf):
    return CL.contingency(SG.stage(spark, sf, "txn"), "category", "department", DEPTS)


@query("one_hot", covers=("RS-7",), sql=FX.with_views(
    "SELECT txn_id, " + ", ".join(f"CAST(category = '{s}' AS INTEGER) AS \"category_{s}\"" for s in SEGMENTS)
    + " FROM txn", "txn"))
def one_hot(spark, sf):
    t = SG.stage(spark, sf, "txn").select("txn_id", "category")
    return CL.one_hot(t, "category", SEGMENTS).drop("category")


@query("record_to_long", covers=("RS-6",), sql=FX.with_views("""
SELECT 'n_rows' AS variable, CAST(COUNT(*) AS DOUBLE) AS value FROM txn
UNION ALL SELECT 'total_amount', CAST(SUM(amount_cents) AS DOUBLE) FROM txn
UNION ALL SELECT 'max_litres', CAST(MAX(litres) AS DOUBLE) FROM txn""", "txn"))
def record_to_long(spark, sf):
    t = SG.stage(spark, sf, "txn")
    rec = t.agg(F.count(F.lit(1)).alias("n_rows"), F.sum("amount_cents").alias("total_amount"),
                F.max("litres").alias("max_litres"))
    return CL.record_to_long(rec)


@query("fuel_type_class", covers=("PRJ-4", "PRJ-9", "PRJ-2", "SR-1"), sql=FX.with_views("""
SELECT p.p_partkey AS model_id, p.p_name AS model, CASE WHEN pm.model IS NOT NULL THEN 'Petrol' ELSE 'Diesel' END AS fuel_type
FROM part p LEFT JOIN (SELECT DISTINCT p_name AS model FROM part WHERE p_size % 3 = 0) pm ON pm.model = p.p_name""", "names"))
def fuel_type_class(spark, sf):
    from tankline.sources.tables import table
    p = table(spark, sf, "part")
    petrol = p.where(F.col("p_size") % 3 == 0).select(F.col("p_name").alias("model"))
    d = p.select(F.col("p_partkey").alias("model_id"), F.col("p_name").alias("model"))
    return CL.fuel_type_from_list(d, "model", petrol)


@query("cluster_label", covers=("PRJ-10", "PRJ-11", "PRJ-8"), sql=FX.with_views("""
SELECT txn_id, 'Cluster ' || CAST(CAST(substr(department, 1, 1) AS INTEGER) - 1 + 1 AS VARCHAR) AS cluster_name,
       CASE department WHEN '1-URGENT' THEN 0 WHEN '2-HIGH' THEN 1 WHEN '3-MEDIUM' THEN 2
                       WHEN '4-NOT SPECIFIED' THEN 3 WHEN '5-LOW' THEN 4 END AS department_ord,
       CASE WHEN fuel_type = 'Petrol' THEN 'P' ELSE fuel_type END AS fuel_code
FROM txn""", "txn"))
def cluster_label(spark, sf):
    t = SG.stage(spark, sf, "txn").withColumn("cl", F.substring("department", 1, 1).cast("int") - 1)
    t = CL.cluster_label(t, "cl", out="cluster_name")
    t = CL.with_ordinal(t, "department", DEPTS, out="department_ord")
    t = t.withColumn("fuel_code", F.when(F.col("fuel_type") == "Petrol", F.lit("P")).otherwise(F.col("fuel_type")))
    return t.select("txn_id", "cluster_name", "department_ord", "fuel_code")


# ------------------------------------------------------------------ profiles

TXN_COLS = ["txn_id", "entity_id", "ts", "amount_cents", "litres", "category", "district", "site", "department", "fuel_type"]


@query("null_profile", covers=("AG-10",), sql=FX.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS nulls FROM txn"
    for c in TXN_COLS), "txn"))
def null_profile(spark, sf):
    return PF.null_profile(SG.stage(spark, sf, "txn"))


@query("distinct_profile", covers=("AG-9",), sql=FX.with_views(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", COUNT(DISTINCT {c}) AS n_distinct FROM txn" for c in TXN_COLS), "txn"))
def distinct_profile(spark, sf):
    return PF.distinct_profile(SG.stage(spark, sf, "txn"), TXN_COLS)


@query("run_statistics", covers=("AG-17",), sql=FX.with_views("""
SELECT category, ROUND(AVG(n), 6) AS n_mean, ROUND(STDDEV_POP(n), 6) AS n_std FROM (
  SELECT category, ts, CAST(COUNT(*) AS DOUBLE) AS n FROM txn GROUP BY category, ts) r GROUP BY category""", "txn"))
def run_statistics(spark, sf):
    runs = SG.stage(spark, sf, "txn").groupBy("category", "ts").agg(F.count(F.lit(1)).cast("double").alias("n"))
    r = PF.run_stats(runs, ["category"], ["n"])
    return r.select("category", F.round("n_mean", 6).alias("n_mean"), F.round("n_std", 6).alias("n_std"))


@query("table_profile", covers=("AG-11",), sql=FX.with_views("""
SELECT CAST(position AS INTEGER) AS position, "column", type, (SELECT COUNT(*) FROM txn) AS n_rows
FROM (VALUES (0, 'txn_id', 'bigint'), (1, 'entity_id', 'bigint'), (2, 'ts', 'timestamp_ntz'), (3, 'amount_cents', 'bigint'),
             (4, 'litres', 'bigint'), (5, 'category', 'string'), (6, 'district', 'string'), (7, 'site', 'string'),
             (8, 'department', 'string'), (9, 'fuel_type', 'string')) AS t(position, "column", type)""", "txn"))
def table_profile(spark, sf):
    return PF.table_profile(SG.stage(spark, sf, "txn"))


@query("value_counts", covers=("AG-1", "AG-2", "AG-3"), sql=FX.with_views("""
SELECT site, COUNT(*) AS n, COUNT(*) / CAST(SUM(COUNT(*)) OVER () AS DOUBLE) AS share FROM txn WHERE site IS NOT NULL GROUP BY site""",
                                                                          "txn"))
def value_counts(spark, sf):
    return PF.value_counts(SG.stage(spark, sf, "txn"), "site", normalize=True)


@query("distinct_values", covers=("AG-8",), sql=FX.with_views(
    "SELECT DISTINCT category, department FROM txn WHERE department IS NOT NULL", "txn"))
def distinct_values(spark, sf):
    return PF.distinct_per_group(SG.stage(spark, sf, "txn"), "category", "department")


@query("entity_summary", covers=("AG-5", "AG-6", "V12"), sql=FX.with_views("""
SELECT entity_id, MIN(ts) AS min_date, MAX(ts) AS max_date,
       arg_min(site, (ts, txn_id)) FILTER (WHERE site IS NOT NULL) AS site,
       arg_min(department, (ts, txn_id)) FILTER (WHERE department IS NOT NULL) AS department,
       arg_min(fuel_type, (ts, txn_id)) FILTER (WHERE fuel_type IS NOT NULL) AS fuel_type,
       SUM(amount_cents) AS total_amount_cents, CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS mean_amount_cents,
       SUM(litres) AS total_litres, CAST(SUM(litres) AS DOUBLE) / COUNT(litres) AS mean_litres
FROM txn GROUP BY entity_id""", "txn"))
def entity_summary(spark, sf):
    return PF.entity_summary(SG.stage(spark, sf, "txn"), "entity_id", "ts", "txn_id", ["site", "department", "fuel_type"],
                             ["amount_cents", "litres"])


@query("having_count", covers=("AG-16",), sql=FX.with_views(
    "SELECT entity_id, COUNT(*) AS n FROM txn GROUP BY entity_id HAVING COUNT(*) > 15", "txn"))
def having_count(spark, sf):
    return PF.having_count(SG.stage(spark, sf, "txn"), "entity_id", ">", 15)


@query("conditional_stats", covers=("AG-12",), sql=FX.with_views("""
SELECT COUNT(*) FILTER (WHERE litres > 100) AS n, SUM(amount_cents) FILTER (WHERE litres > 100) AS total,
       CAST(SUM(amount_cents) FILTER (WHERE litres > 100) AS DOUBLE) / COUNT(*) FILTER (WHERE litres > 100) AS mean FROM txn""",
                                                                                     "txn"))
def conditional_stats(spark, sf):
    return PF.conditional_stats(SG.stage(spark, sf, "txn"), F.col("litres") > 100, "amount_cents")


@query("top_k", covers=("SR-3", "SR-1"), sql=FX.with_views(
    "SELECT txn_id, amount_cents FROM txn ORDER BY amount_cents DESC, txn_id LIMIT 10", "txn"))
def top_k(spark, sf):
    return PF.top_k(SG.stage(spark, sf, "txn").select("txn_id", "amount_cents"), "amount_cents", 10, ["txn_id"])


@query("first_n", covers=("SR-2", "FLT-11"), sql=FX.with_views("""
SELECT txn_id, ts, amount_cents FROM txn WHERE entity_id = (SELECT MIN(entity_id) FROM txn)
ORDER BY ts, txn_id LIMIT 5""", "txn"))
def first_n(spark, sf):
    t = SG.stage(spark, sf, "txn")
    first_entity = t.agg(F.min("entity_id")).first()[0]
    return PF.first_n(t.where(F.col("entity_id") == first_entity).select("txn_id", "ts", "amount_cents"), 5, ["ts", "txn_id"])


@query("sample_repeatable", covers=("SR-5", "SR-7"), sql=FX.with_views("""
SELECT entity_id FROM (SELECT DISTINCT entity_id FROM txn) d
ORDER BY md5(CAST(entity_id AS VARCHAR) || '|42'), entity_id LIMIT 20""", "txn"))
def sample_repeatable(spark, sf):
    ents = SG.stage(spark, sf, "txn").select("entity_id").distinct()
    return PF.repeatable_sample(ents, 20, "entity_id", 42)


@query("semi_anti", covers=("JN-14",), sql=FX.with_views("""
SELECT t.txn_id, 'semi' AS kind FROM txn t WHERE t.entity_id IN (SELECT reg_no FROM register)
UNION ALL SELECT t.txn_id, 'anti' FROM txn t WHERE t.entity_id NOT IN (SELECT reg_no FROM register)""", "txn", "register"))
def semi_anti(spark, sf):
    t = SG.stage(spark, sf, "txn").select("txn_id", "entity_id")
    r = SG.stage(spark, sf, "register").select(F.col("reg_no").alias("entity_id"))
    return (PF.semi_anti(t, r, "entity_id").select("txn_id", F.lit("semi").alias("kind"))
            .unionByName(PF.semi_anti(t, r, "entity_id", anti=True).select("txn_id", F.lit("anti").alias("kind"))))


@query("linear_trend", covers=("FN-17",), sql=FX.with_views("""
SELECT department, regr_slope(amount_cents, litres) AS slope, regr_intercept(amount_cents, litres) AS intercept
FROM txn GROUP BY department""", "txn"))
def linear_trend(spark, sf):
    t = SG.stage(spark, sf, "txn")
    return t.groupBy("department").agg(F.regr_slope("amount_cents", "litres").alias("slope"),
                                       F.regr_intercept("amount_cents", "litres").alias("intercept"))


# ------------------------------------------------------------------ summaries

@query("counts_with_others", covers=("SM-1", "AG-1"), sql=FX.with_views(f"""
SELECT {trunc_sql("label", 50, True)} AS label, n FROM (
  SELECT CASE WHEN n >= 600 THEN site ELSE 'Others' END AS label, SUM(n) AS n
  FROM (SELECT site, COUNT(*) AS n FROM txn WHERE site IS NOT NULL GROUP BY site) v GROUP BY 1) x
WHERE label <> 'Others' OR n > 0""", "txn"))
def counts_with_others(spark, sf):
    return SM.counts_with_others(SG.stage(spark, sf, "txn"), "site", 600)


@query("top_means_other", covers=("SM-2", "AG-19", "AG-4", "V21"), sql=FX.with_views("""
SELECT label, mean, n_obs FROM (
  SELECT CAST(site AS VARCHAR) AS label, mean, n_obs FROM g WHERE rk <= 9
  UNION ALL
  SELECT 'Other', AVG(mean), SUM(n_obs) FROM g WHERE rk > 9) x WHERE n_obs IS NOT NULL""", "txn", ctes=["""
g AS (SELECT site, mean, n_obs, ROW_NUMBER() OVER (ORDER BY mean DESC NULLS LAST, site) AS rk
      FROM (SELECT site, CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS mean, COUNT(*) AS n_obs
            FROM txn WHERE site IS NOT NULL GROUP BY site) a)"""]))
def top_means_other(spark, sf):
    return SM.top_means_other(SG.stage(spark, sf, "txn"), "site", "amount_cents", 9)


@query("histogram20", covers=("SM-3",), sql=FX.with_views("""
SELECT b.bin, mm.lo + b.bin * ((mm.hi - mm.lo) / 20) AS lo,
       CASE WHEN b.bin = 19 THEN mm.hi ELSE mm.lo + (b.bin + 1) * ((mm.hi - mm.lo) / 20) END AS hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b
CROSS JOIN mm
LEFT JOIN (SELECT LEAST(CAST(floor((CAST(amount_cents AS DOUBLE) - mm.lo) / ((mm.hi - mm.lo) / 20)) AS INTEGER), 19) AS bin,
                  COUNT(*) AS n FROM txn CROSS JOIN mm GROUP BY 1) c ON c.bin = b.bin""", "txn", ctes=["""
mm AS (SELECT CAST(MIN(amount_cents) AS DOUBLE) AS lo, CAST(MAX(amount_cents) AS DOUBLE) AS hi FROM txn)"""]))
def histogram20(spark, sf):
    return SM.histogram(SG.stage(spark, sf, "txn"), "amount_cents", 20)


@query("box_stats", covers=("SM-4", "AG-15", "V15"), sql=FX.with_views("""
SELECT q.department, q.n, q.q1, q.median, q.q3, q.iqr,
       MIN(CASE WHEN t.x >= q.q1 - 1.5 * q.iqr THEN t.x END) AS whisker_low,
       MAX(CASE WHEN t.x <= q.q3 + 1.5 * q.iqr THEN t.x END) AS whisker_high,
       COUNT(*) FILTER (WHERE t.x < q.q1 - 1.5 * q.iqr OR t.x > q.q3 + 1.5 * q.iqr) AS n_outliers
FROM q JOIN (SELECT department, CAST(amount_cents AS DOUBLE) AS x FROM txn WHERE department IS NOT NULL AND amount_cents IS NOT NULL) t
  ON t.department = q.department
GROUP BY q.department, q.n, q.q1, q.median, q.q3, q.iqr""", "txn", ctes=["""
q AS (SELECT department, COUNT(*) AS n, quantile_cont(amount_cents, 0.25) AS q1, quantile_cont(amount_cents, 0.5) AS median,
             quantile_cont(amount_cents, 0.75) AS q3,
             quantile_cont(amount_cents, 0.75) - quantile_cont(amount_cents, 0.25) AS iqr
      FROM txn WHERE department IS NOT NULL AND amount_cents IS NOT NULL GROUP BY department)"""]))
def box_stats(spark, sf):
    return SM.box_stats(SG.stage(spark, sf, "txn"), "department", "amount_cents")


@query("top5_lumped", covers=("SM-5",), sql=FX.with_views("""
SELECT CASE WHEN t5.site IS NOT NULL THEN t.site ELSE 'Other' END AS site_top, COUNT(*) AS n
FROM txn t LEFT JOIN (SELECT site FROM txn WHERE site IS NOT NULL GROUP BY site ORDER BY COUNT(*) DESC, site LIMIT 5) t5
  ON t5.site = t.site GROUP BY 1""", "txn"))
def top5_lumped(spark, sf):
    return SM.lump_top(SG.stage(spark, sf, "txn"), "site", 5).groupBy("site_top").agg(F.count(F.lit(1)).alias("n"))


@query("proportions", covers=("SM-6", "FN-7", "FN-15", "V16", "D17"), sql=FX.with_views(f"""
SELECT g.department AS group_label, {trunc_sql("k.category", 20)} AS category, round_even(COALESCE(p.p, 0.0), 2) AS proportion
FROM (SELECT DISTINCT department FROM d) g
CROSS JOIN (SELECT CAST(site AS VARCHAR) AS category FROM kept UNION ALL SELECT 'Others') k
LEFT JOIN (SELECT department, CASE WHEN site IN (SELECT site FROM kept) THEN site ELSE 'Others' END AS category, SUM(p) AS p
           FROM share GROUP BY 1, 2) p ON p.department = g.department AND p.category = k.category""", "txn", ctes=["""
d AS (SELECT * FROM txn WHERE department IS NOT NULL AND site IS NOT NULL)""", """
share AS (SELECT c.department, c.site, c.n / CAST(t.t AS DOUBLE) AS p
          FROM (SELECT department, site, COUNT(*) AS n FROM d GROUP BY 1, 2) c
          JOIN (SELECT department, COUNT(*) AS t FROM d GROUP BY 1) t ON t.department = c.department)""", """
kept AS (SELECT site FROM share GROUP BY site ORDER BY SUM(p) DESC, site LIMIT 8)"""]))
def proportions(spark, sf):
    return SM.proportions(SG.stage(spark, sf, "txn"), "department", "site", 8, 20)


@query("counts_in_top", covers=("SM-7",), sql=FX.with_views("""
SELECT site, category, COUNT(*) AS n FROM txn
WHERE site IN (SELECT site FROM txn WHERE site IS NOT NULL GROUP BY site ORDER BY COUNT(*) DESC, site LIMIT 5)
GROUP BY site, category""", "txn"))
def counts_in_top(spark, sf):
    return SM.counts_in_top(SG.stage(spark, sf, "txn"), "site", "category", 5)


@query("top_per_group", covers=("SM-10", "WN-5"), sql=FX.with_views("""
SELECT * FROM (SELECT department, site, n, ROW_NUMBER() OVER (PARTITION BY department ORDER BY n DESC, site) AS rank
               FROM (SELECT department, site, COUNT(*) AS n FROM txn WHERE site IS NOT NULL GROUP BY 1, 2) c) x
WHERE rank <= 3""", "txn"))
def top_per_group(spark, sf):
    return SM.top_per_group(SG.stage(spark, sf, "txn"), "department", "site", 3)


@query("cluster_sizes", covers=("SM-9",), sql=FX.with_views("""
SELECT department, COUNT(*) AS size, COUNT(*) / CAST((SELECT COUNT(*) FROM txn) AS DOUBLE) AS share FROM txn GROUP BY department""",
                                                                                 "txn"))
def cluster_sizes(spark, sf):
    return SM.cluster_sizes(SG.stage(spark, sf, "txn"), "department")


@query("cluster_profile", covers=("SM-8",), sql=FX.with_views("""
SELECT b.*, ts.top_site, tc.top_category FROM
  (SELECT department, COUNT(*) AS size, CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS mean_amount_cents,
          CAST(SUM(litres) AS DOUBLE) / COUNT(litres) AS mean_litres,
          COUNT(*) / CAST((SELECT COUNT(*) FROM txn) AS DOUBLE) AS share
   FROM txn GROUP BY department) b
LEFT JOIN (SELECT department, string_agg(site || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_site
           FROM (SELECT department, site, n, ROW_NUMBER() OVER (PARTITION BY department ORDER BY n DESC, site) AS rank
                 FROM (SELECT department, site, COUNT(*) AS n FROM txn WHERE site IS NOT NULL GROUP BY 1, 2) c) x
           WHERE rank <= 3 GROUP BY department) ts ON ts.department = b.department
LEFT JOIN (SELECT department, string_agg(category || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY rank) AS top_category
           FROM (SELECT department, category, n, ROW_NUMBER() OVER (PARTITION BY department ORDER BY n DESC, category) AS rank
                 FROM (SELECT department, category, COUNT(*) AS n FROM txn WHERE category IS NOT NULL GROUP BY 1, 2) c) x
           WHERE rank <= 3 GROUP BY department) tc ON tc.department = b.department""", "txn"))
def cluster_profile(spark, sf):
    return SM.cluster_profile(SG.stage(spark, sf, "txn"), "department", ["amount_cents", "litres"], ["site", "category"], 3)


# ------------------------------------------------------------------ more filters and joins

@query("dropna_variants", covers=("FLT-3", "FLT-9", "FLT-1"), sql=FX.with_views("""
SELECT txn_id, up FROM (
  SELECT txn_id, CASE WHEN isnan(u) OR abs(u) = CAST('inf' AS DOUBLE) THEN NULL ELSE u END AS up, litres, amount_cents
  FROM (SELECT txn_id, litres, amount_cents,
               CASE WHEN litres IS NULL THEN NULL WHEN litres = 0 THEN CAST('nan' AS DOUBLE)
                    ELSE amount_cents / litres END AS u FROM txn) a) b
WHERE up IS NOT NULL AND NOT (litres IS NULL AND amount_cents IS NULL)""", "txn"))
def dropna_variants(spark, sf):
    t = SG.stage(spark, sf, "txn").withColumn("up", X.unit_price("amount_cents", "litres"))
    t = CL.drop_null(t, ["litres", "amount_cents"], how="all")
    return CL.drop_non_finite(t, ["up"]).select("txn_id", "up")


COORDS_SQL = """
coords AS (SELECT n_name || ', ' || r.r_name AS address, -30.0 - n_nationkey * 0.25 AS lat, 22.0 + n_nationkey * 0.5 AS lon
           FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE n_nationkey % 7 <> 3)"""


@query("coordinates", covers=("JN-11", "SNK-4"), sql=FX.with_views("""
SELECT t.txn_id, c.lat AS site_lat, c.lon AS site_lon
FROM txn t LEFT JOIN coords c ON c.address = t.site || ', ' || t.district""", "txn", ctes=[COORDS_SQL]))
def coordinates(spark, sf):
    out = CL.attach_coordinates(SG.stage(spark, sf, "txn"), "site", place_coordinates(spark, sf), region="district", prefix="site_")
    return out.select("txn_id", "site_lat", "site_lon")


def place_coordinates(spark, sf):
    """(address, lat, lon): the dimension of ``COORDS_SQL``."""
    from tankline.sources.tables import table
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey).where(F.col("n_nationkey") % 7 != 3)
            .select(F.concat(F.col("n_name"), F.lit(", "), F.col("r_name")).alias("address"),
                    (F.lit(-30.0) - F.col("n_nationkey") * F.lit(0.25)).alias("lat"),
                    (F.lit(22.0) + F.col("n_nationkey") * F.lit(0.5)).alias("lon")))
