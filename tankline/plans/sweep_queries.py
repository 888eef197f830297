"""Queries of the threshold sweep and the temporal validation (HF-8..HF-13).

The oracles compute every setting directly (rows x grid), without the
compression the Spark side uses, so they check the compression too.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from tankline.operators import sweep as SW
from tankline.operators import temporal as T
from tankline.plans.flag_queries import PRICED_SQL, UPLIFT_CENTS, flagged_sql, flagged_txn
from tankline.plans.registry import query
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG


def grid_sql(mults, days, prices) -> str:
    rows = ", ".join(
        f"(CAST({m!r} AS DOUBLE), {int(d)}, CAST({p!r} AS DOUBLE), CAST({SW.scaled(p, 100.0)!r} AS DOUBLE))"
        for m, d, p in product(mults, days, prices))
    return f"grid AS (SELECT * FROM (VALUES {rows}) g(multiplier, days_threshold, price_diff, price_cents))"


NF_SQL = """
  CAST(COALESCE(b.amount_cents > b.{avg} * g.multiplier, FALSE) AS INTEGER)
+ CAST(COALESCE(b.gap_days < g.days_threshold AND b.amount_cents > b.{avg}, FALSE) AS INTEGER)
+ CAST(COALESCE(b.price_difference > g.price_cents, FALSE) AS INTEGER)"""

SWEEP_CTES = [PRICED_SQL, flagged_sql(), grid_sql(SW.MULTIPLIERS, SW.DAYS, SW.PRICE_DIFFS), f"""
ev AS (SELECT g.multiplier, g.days_threshold, g.price_diff, b.department, b.district, b.amount_cents,
              {NF_SQL.format(avg="avg_category_amount")} AS nf
       FROM counted b CROSS JOIN grid g)""", """
tot AS (
  SELECT multiplier, days_threshold, price_diff,
         CAST(SUM(CASE WHEN nf = 0 THEN 1 ELSE 0 END) AS DOUBLE) * CAST(100 AS DOUBLE) / COUNT(*) AS pct_no_flags,
         CAST(SUM(CASE WHEN nf = 1 THEN 1 ELSE 0 END) AS DOUBLE) * CAST(100 AS DOUBLE) / COUNT(*) AS pct_one_flag,
         CAST(SUM(CASE WHEN nf >= 2 THEN 1 ELSE 0 END) AS DOUBLE) * CAST(100 AS DOUBLE) / COUNT(*) AS pct_multi_flags,
         CAST(SUM(CASE WHEN nf >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS num_multi_flags,
         CAST(SUM(CASE WHEN nf >= 2 THEN amount_cents END) AS DOUBLE) / SUM(CASE WHEN nf >= 2 THEN 1 ELSE 0 END) AS avg_flagged_amount,
         CAST(COALESCE(SUM(CASE WHEN nf >= 2 THEN amount_cents END), 0) AS BIGINT) AS total_flagged_amount
  FROM ev GROUP BY multiplier, days_threshold, price_diff)""", """
dr AS (SELECT multiplier, days_threshold, price_diff, department, CAST(SUM(nf) AS DOUBLE) / COUNT(*) AS rate
       FROM ev WHERE department IS NOT NULL GROUP BY ALL)""", """
dt AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY multiplier, days_threshold, price_diff
                                                   ORDER BY rate DESC, department) AS rn FROM dr) x WHERE rn = 1)""", """
sr AS (SELECT multiplier, days_threshold, price_diff, district, CAST(SUM(nf) AS DOUBLE) / COUNT(*) AS rate
       FROM ev WHERE district IS NOT NULL GROUP BY ALL)""", """
st AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY multiplier, days_threshold, price_diff
                                                   ORDER BY rate DESC, district) AS rn FROM sr) x WHERE rn = 1)""", """
sweep AS (SELECT tot.*, dt.department AS highest_dept_flags, dt.rate AS highest_dept_flag_rate,
                 st.district AS highest_district_flags, st.rate AS highest_district_flag_rate
          FROM tot LEFT JOIN dt USING (multiplier, days_threshold, price_diff)
                   LEFT JOIN st USING (multiplier, days_threshold, price_diff))"""]


def _sweep_sql(body: str, extra=()) -> str:
    return FX.with_views(body, "txn", "price", ctes=[*SWEEP_CTES, *extra])


def sweep_df(spark, sf):
    return SW.threshold_sweep(flagged_txn(spark, sf))


@query("threshold_sweep", covers=("HF-8", "JN-16", "AG-12", "AG-13", "AG-3", "AG-4", "V18"),
       sql=_sweep_sql("SELECT * FROM sweep"))
def threshold_sweep(spark, sf):
    return sweep_df(spark, sf)


@query("sweep_effects", covers=("HF-9",), sql=_sweep_sql("""
SELECT 'multiplier' AS parameter, multiplier AS value, pct_multi_flags FROM sweep WHERE days_threshold = 2 AND price_diff = 1.0
UNION ALL
SELECT 'days_threshold', CAST(days_threshold AS DOUBLE), pct_multi_flags FROM sweep WHERE multiplier = 1.5 AND price_diff = 1.0
UNION ALL
SELECT 'price_diff', price_diff, pct_multi_flags FROM sweep WHERE multiplier = 1.5 AND days_threshold = 2"""))
def sweep_effects(spark, sf):
    return SW.sweep_effects(sweep_df(spark, sf))


def _names_sql() -> str:
    rows = ", ".join(f"(CAST({m!r} AS DOUBLE), {d}, CAST({p!r} AS DOUBLE), '{t}')" for m, d, p, t in SW.KEY_SETTINGS)
    return f"names AS (SELECT * FROM (VALUES {rows}) n(multiplier, days_threshold, price_diff, description))"


@query("sweep_key_settings", covers=("HF-10", "WN-10", "FN-8", "FN-15", "V16"), sql=_sweep_sql("""
SELECT k.multiplier, k.days_threshold, k.price_diff, k.description,
       round_even(k.pct_no_flags, 2) AS pct_no_flags, round_even(k.pct_one_flag, 2) AS pct_one_flag,
       round_even(k.pct_multi_flags, 2) AS pct_multi_flags, k.num_multi_flags,
       'R' || format('{:,.0f}', CAST(k.total_flagged_amount AS DOUBLE) / CAST(100 AS DOUBLE)) AS total_flagged_amount,
       printf('%+.2f%%', (k.pct_multi_flags - b.pct_multi_flags) / b.pct_multi_flags * CAST(100 AS DOUBLE)) AS pct_change_multi_flags,
       printf('%+.2f%%', (k.total_flagged_amount - CAST(b.total_flagged_amount AS DOUBLE)) / CAST(b.total_flagged_amount AS DOUBLE) * CAST(100 AS DOUBLE)) AS pct_change_total_amount
FROM (SELECT s.*, n.description FROM sweep s JOIN names n USING (multiplier, days_threshold, price_diff)) k,
     (SELECT pct_multi_flags, total_flagged_amount FROM sweep WHERE multiplier = 1.5 AND days_threshold = 2 AND price_diff = 1.0) b""",
                                                                                      extra=[_names_sql()]))
def sweep_key_settings(spark, sf):
    return SW.key_settings(sweep_df(spark, sf))


@query("sweep_top_impact", covers=("HF-11", "SR-4", "SR-3"), sql=_sweep_sql("""
SELECT multiplier, days_threshold, price_diff, total_flagged_amount,
       'M:' || CAST(multiplier AS VARCHAR) || ', D:' || CAST(days_threshold AS VARCHAR) || ', P:R' || CAST(price_diff AS VARCHAR) AS param_combo
FROM sweep ORDER BY total_flagged_amount DESC, multiplier, days_threshold, price_diff LIMIT 5"""))
def sweep_top_impact(spark, sf):
    return SW.top_impact(sweep_df(spark, sf))


@query("sweep_heatmap", covers=("RS-5", "AG-18"), sql=_sweep_sql("""
SELECT multiplier,
       AVG(CASE WHEN days_threshold = 1 THEN pct_multi_flags END) AS days_1,
       AVG(CASE WHEN days_threshold = 2 THEN pct_multi_flags END) AS days_2,
       AVG(CASE WHEN days_threshold = 3 THEN pct_multi_flags END) AS days_3,
       AVG(CASE WHEN days_threshold = 4 THEN pct_multi_flags END) AS days_4
FROM sweep GROUP BY multiplier"""))
def sweep_heatmap(spark, sf):
    return SW.sweep_heatmap(sweep_df(spark, sf))


# ------------------------------------------------------------ temporal validation

VALIDATION_CTES = [PRICED_SQL, f"""
mr AS (
  SELECT *, CASE WHEN isnan(raw_diff) THEN NULL ELSE raw_diff END AS price_difference
  FROM (SELECT pr.*, CAST(date_trunc('month', pr.ts) AS DATE) AS month,
               date_sub('day', LAG(pr.ts) OVER (PARTITION BY pr.entity_id, CAST(date_trunc('month', pr.ts) AS DATE)
                                                ORDER BY pr.ts, pr.txn_id), pr.ts) AS gap_days,
               abs(CASE WHEN pr.fuel_type = 'Diesel' THEN pr.coastal_diesel_cents + CAST('{UPLIFT_CENTS}' AS DOUBLE)
                        ELSE pr.coastal_petrol_cents END - pr.unit_price) AS raw_diff
        FROM priced pr) x)""", """
months AS (SELECT DISTINCT month FROM mr)""", """
trip AS (SELECT * FROM (SELECT month AS train_month, LEAD(month, 1) OVER (ORDER BY month) AS val_month,
                               LEAD(month, 2) OVER (ORDER BY month) AS test_month FROM months) x
         WHERE test_month IS NOT NULL)""", """
mavg AS (SELECT month, category, district, CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS mavg
         FROM mr WHERE category IS NOT NULL AND district IS NOT NULL GROUP BY ALL)""", """
vrows AS (SELECT t.train_month, t.val_month, t.test_month, r.*, a.mavg AS avg_used
          FROM trip t JOIN mr r ON r.month = t.val_month
          LEFT JOIN mavg a ON a.month = t.train_month AND a.category = r.category AND a.district = r.district)""", """
blend AS (SELECT COALESCE(x.train_month, y.train_month) AS train_month, COALESCE(x.category, y.category) AS category,
                 COALESCE(x.district, y.district) AS district,
                 x.mavg * CAST(0.7 AS DOUBLE) + y.mavg * CAST(0.3 AS DOUBLE) AS bavg
          FROM (SELECT t.train_month, a.category, a.district, a.mavg FROM trip t JOIN mavg a ON a.month = t.train_month) x
          FULL OUTER JOIN (SELECT t.train_month, a.category, a.district, a.mavg FROM trip t JOIN mavg a ON a.month = t.val_month) y
            ON x.train_month = y.train_month AND x.category = y.category AND x.district = y.district)""", """
trows AS (SELECT t.train_month, t.val_month, t.test_month, r.*,
                 CASE WHEN bl.category IS NOT NULL THEN bl.bavg ELSE CAST(r.amount_cents AS DOUBLE) END AS avg_used
          FROM trip t JOIN mr r ON r.month = t.test_month
          LEFT JOIN blend bl ON bl.train_month = t.train_month AND bl.category = r.category AND bl.district = r.district)""",
    grid_sql(SW.VALIDATION_MULTIPLIERS, SW.VALIDATION_DAYS, SW.VALIDATION_PRICE_DIFFS), f"""
ve AS (SELECT b.train_month, b.val_month, b.test_month, g.multiplier, g.days_threshold, g.price_diff, b.entity_id,
              {NF_SQL.format(avg="avg_used")} AS nf FROM vrows b CROSS JOIN grid g)""", f"""
te AS (SELECT b.train_month, b.val_month, b.test_month, g.multiplier, g.days_threshold, g.price_diff, b.entity_id,
              {NF_SQL.format(avg="avg_used")} AS nf FROM trows b CROSS JOIN grid g)""", """
vs AS (SELECT train_month, val_month, test_month, multiplier, days_threshold, price_diff,
              CAST(SUM(CASE WHEN nf >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS s FROM ve GROUP BY ALL)""", """
ts AS (SELECT train_month, val_month, test_month, multiplier, days_threshold, price_diff,
              CAST(SUM(CASE WHEN nf >= 2 THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS s FROM te GROUP BY ALL)""", """
vf AS (SELECT DISTINCT train_month, multiplier, days_threshold, price_diff, entity_id FROM ve WHERE nf >= 2)""", """
tf AS (SELECT DISTINCT train_month, multiplier, days_threshold, price_diff, entity_id FROM te WHERE nf >= 2)""", """
ni AS (SELECT train_month, multiplier, days_threshold, price_diff, COUNT(*) AS n FROM vf
       JOIN tf USING (train_month, multiplier, days_threshold, price_diff, entity_id) GROUP BY ALL)""", """
nv AS (SELECT train_month, multiplier, days_threshold, price_diff, COUNT(*) AS n FROM vf GROUP BY ALL)""", """
nt AS (SELECT train_month, multiplier, days_threshold, price_diff, COUNT(*) AS n FROM tf GROUP BY ALL)""", """
val AS (
  SELECT vs.train_month, vs.val_month, vs.test_month, vs.multiplier, vs.days_threshold, vs.price_diff,
         vs.s * CAST(100 AS DOUBLE) AS val_pct_multi_flags, ts.s * CAST(100 AS DOUBLE) AS test_pct_multi_flags,
         (CAST(1 AS DOUBLE) - abs(vs.s - ts.s)) * CAST(100 AS DOUBLE) AS consistency_score,
         CASE WHEN COALESCE(nv.n, 0) > 0 AND COALESCE(nt.n, 0) > 0
              THEN CAST(COALESCE(ni.n, 0) AS DOUBLE) / (nv.n + nt.n - COALESCE(ni.n, 0)) ELSE CAST(0 AS DOUBLE) END
           * CAST(100 AS DOUBLE) AS vehicle_overlap
  FROM vs JOIN ts USING (train_month, multiplier, days_threshold, price_diff)
  LEFT JOIN ni USING (train_month, multiplier, days_threshold, price_diff)
  LEFT JOIN nv USING (train_month, multiplier, days_threshold, price_diff)
  LEFT JOIN nt USING (train_month, multiplier, days_threshold, price_diff))"""]


def _val_sql(body: str) -> str:
    return FX.with_views(body, "txn", "price", ctes=VALIDATION_CTES)


def validation_df(spark, sf):
    priced = SG.stage(spark, sf, "priced")
    return SW.temporal_validation(priced)


@query("temporal_validation", covers=("HF-12", "JN-12", "ST-3", "WN-8", "FN-12", "V20", "D1"),
       sql=_val_sql("SELECT * FROM val"))
def temporal_validation(spark, sf):
    return validation_df(spark, sf)


@query("temporal_validation_summary", covers=("HF-13", "AG-18", "SR-1"), sql=_val_sql("""
SELECT multiplier, days_threshold, price_diff, AVG(consistency_score) AS consistency_score,
       AVG(vehicle_overlap) AS vehicle_overlap,
       'M:' || CAST(multiplier AS VARCHAR) || ', D:' || CAST(days_threshold AS VARCHAR) || ', P:R' || CAST(price_diff AS VARCHAR) AS param_combo
FROM val GROUP BY multiplier, days_threshold, price_diff"""))
def temporal_validation_summary(spark, sf):
    return SW.validation_summary(validation_df(spark, sf))


@query("month_triples", covers=("WN-8",), sql=_val_sql("SELECT train_month, val_month, test_month FROM trip"))
def month_triples(spark, sf):
    return T.month_triples(SG.stage(spark, sf, "txn")).select(
        F.col("train_month"), F.col("val_month"), F.col("test_month"))
