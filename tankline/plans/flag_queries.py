"""Queries of the flag slice: price enrichment, flags, distribution, efficiency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankline.operators import flags as FL
from tankline.operators import temporal as T
from tankline.plans.registry import query
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG

UPLIFT_CENTS = repr(FL.DIESEL_UPLIFT * 100.0)

# Oracle fragments. ``priced`` is the as-of price enrichment (PP-5), written with
# DuckDB's native ASOF join so the oracle does not share our interval trick.
PRICED_SQL = """
priced AS (
  SELECT t.*, p.coastal_petrol_cents, p.coastal_diesel_cents, p.inland_petrol_cents, p.inland_diesel_cents,
         CASE WHEN t.litres IS NULL OR t.amount_cents IS NULL THEN NULL
              WHEN t.litres = 0 THEN CASE WHEN t.amount_cents > 0 THEN CAST('inf' AS DOUBLE)
                                          WHEN t.amount_cents < 0 THEN CAST('-inf' AS DOUBLE)
                                          ELSE CAST('nan' AS DOUBLE) END
              ELSE t.amount_cents / t.litres END AS unit_price
  FROM txn t ASOF LEFT JOIN price p ON t.ts >= p.effective_date)"""


def flagged_sql(m: str = "1.5", d: str = "2", p: str = "100.0") -> str:
    """Direct per-row flags in SQL (window for the gap, grouped mean joined back)."""
    return f"""
grp AS (
  SELECT category, district, monthname(ts) AS month_name,
         CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS avg_category_amount
  FROM priced WHERE category IS NOT NULL AND district IS NOT NULL GROUP BY ALL),
base AS (
  SELECT pr.*, g.avg_category_amount,
         date_sub('day', LAG(pr.ts) OVER (PARTITION BY pr.entity_id ORDER BY pr.ts, pr.txn_id), pr.ts) AS gap_days,
         pr.coastal_diesel_cents + CAST('{UPLIFT_CENTS}' AS DOUBLE) AS coastal_diesel_adjusted
  FROM priced pr LEFT JOIN grp g
    ON g.category = pr.category AND g.district = pr.district AND g.month_name = monthname(pr.ts)),
diffd AS (
  SELECT *, CASE WHEN isnan(raw_diff) THEN NULL ELSE raw_diff END AS price_difference
  FROM (SELECT *, abs(CASE WHEN fuel_type = 'Diesel' THEN coastal_diesel_adjusted ELSE coastal_petrol_cents END
                      - unit_price) AS raw_diff FROM base) x),
flagged AS (
  SELECT *,
         COALESCE(amount_cents > avg_category_amount * CAST({m} AS DOUBLE), FALSE) AS amount_flag,
         COALESCE(gap_days < {d} AND amount_cents > avg_category_amount, FALSE) AS frequency_flag,
         COALESCE(price_difference > CAST({p} AS DOUBLE), FALSE) AS price_flag
  FROM diffd),
counted AS (
  SELECT *, CAST(amount_flag AS INTEGER) + CAST(frequency_flag AS INTEGER) + CAST(price_flag AS INTEGER) AS number_of_flags
  FROM flagged)"""


def flagged_txn(spark, sf, **kw):
    """Flags computed from the priced stage (the operator work of HF-5)."""
    return FL.apply_flags(SG.stage(spark, sf, "priced"), **kw)


@query("asof_price", covers=("JN-8", "PP-5", "PRJ-6", "SRC-4"), sql=FX.with_views("""
SELECT txn_id, coastal_petrol_cents, coastal_diesel_cents, inland_petrol_cents, inland_diesel_cents, unit_price
FROM priced""", "txn", "price", ctes=[PRICED_SQL]))
def asof_price(spark, sf):
    priced = T.enrich_prices(SG.stage(spark, sf, "txn"), SG.stage(spark, sf, "price"))
    return priced.select("txn_id", *T.PRICE_COLS, "unit_price")


FLAG_COLS = ["txn_id", "entity_id", "avg_category_amount", "amount_flag", "gap_days", "frequency_flag",
             "price_difference", "price_flag", "number_of_flags"]


def _with(body: str, *ctes: str) -> str:
    return FX.with_views(body, "txn", "price", ctes=ctes)


@query("flags_all", covers=("HF-1", "HF-2", "HF-3", "HF-4", "HF-5", "HF-6", "WN-1", "WN-2", "ML-1", "V1", "V3", "V5",
                            "FN-14", "UD-1", "UD-2"),
       sql=_with("""
SELECT txn_id, entity_id, avg_category_amount, amount_flag, gap_days, frequency_flag, price_difference,
       price_flag, number_of_flags, LEAST(number_of_flags, 2) AS flag_class
FROM counted""", PRICED_SQL, flagged_sql()))
def flags_all(spark, sf):
    f = flagged_txn(spark, sf)
    return f.select(*FLAG_COLS, F.least("number_of_flags", F.lit(2)).alias("flag_class"))


@query("flag_distribution", covers=("HF-4", "AG-3"), sql=_with("""
SELECT number_of_flags, COUNT(*) AS n, COUNT(*) / SUM(COUNT(*)) OVER () AS share
FROM counted GROUP BY number_of_flags""", PRICED_SQL, flagged_sql()))
def flag_distribution(spark, sf):
    return FL.flag_distribution(flagged_txn(spark, sf))


@query("flags_by_district", covers=("HF-5", "AG-14"), sql=_with("""
SELECT district, number_of_flags, COUNT(*) AS n FROM counted GROUP BY district, number_of_flags""",
                                                                   PRICED_SQL, flagged_sql()))
def flags_by_district(spark, sf):
    return flagged_txn(spark, sf).groupBy("district", "number_of_flags").agg(F.count(F.lit(1)).alias("n"))


EFF_CTES = ["""
tr AS (SELECT entity_id, MIN(ts) AS min_litres, MAX(ts) AS max_litres FROM txn GROUP BY entity_id),
mr AS (SELECT entity_id, MIN(ts) AS min_odo, MAX(ts) AS max_odo FROM meter GROUP BY entity_id),
ov AS (SELECT mr.entity_id, GREATEST(min_odo, min_litres) AS overlap_start, LEAST(max_odo, max_litres) AS overlap_end
       FROM mr JOIN tr ON tr.entity_id = mr.entity_id WHERE GREATEST(min_odo, min_litres) <= LEAST(max_odo, max_litres)),
km AS (SELECT ov.entity_id, arg_max(m.odo, m.ts) - arg_min(m.odo, m.ts) AS km
       FROM ov JOIN meter m ON m.entity_id = ov.entity_id AND m.ts BETWEEN ov.overlap_start AND ov.overlap_end
       GROUP BY ov.entity_id),
li AS (SELECT ov.entity_id, COALESCE(SUM(t.litres), 0) AS lit
       FROM ov JOIN txn t ON t.entity_id = ov.entity_id AND t.ts BETWEEN ov.overlap_start AND ov.overlap_end
       GROUP BY ov.entity_id),
res AS (SELECT ov.entity_id, ov.overlap_start, ov.overlap_end,
               CAST(COALESCE(CASE WHEN li.entity_id IS NOT NULL THEN km.km END, 0) AS DOUBLE) AS total_km,
               CAST(COALESCE(CASE WHEN km.entity_id IS NOT NULL THEN li.lit END, 0) AS DOUBLE) AS total_litres
        FROM ov LEFT JOIN km ON km.entity_id = ov.entity_id LEFT JOIN li ON li.entity_id = ov.entity_id),
k AS (SELECT *, CASE WHEN total_litres = 0 THEN CASE WHEN total_km > 0 THEN CAST('inf' AS DOUBLE)
                                                     WHEN total_km < 0 THEN CAST('-inf' AS DOUBLE)
                                                     ELSE CAST('nan' AS DOUBLE) END
                     ELSE total_km / total_litres END AS kmpl FROM res)"""]


@query("entity_low_efficiency", covers=("HF-7", "PP-6", "JN-4", "JN-5", "JN-9", "FN-13", "WN-6", "AG-6"),
       sql=FX.with_views("""
SELECT entity_id, overlap_start, overlap_end, total_km, total_litres, kmpl, COALESCE(kmpl < 5.0, FALSE) AS low_efficiency
FROM k WHERE NOT isnan(kmpl)""", "txn", "meter", ctes=EFF_CTES))
def entity_low_efficiency(spark, sf):
    return T.entity_efficiency(SG.stage(spark, sf, "txn"), SG.stage(spark, sf, "meter"))
