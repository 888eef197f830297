"""Queries of the evaluation tables on the ``scored`` view (labels with a
rule-made prediction and score)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankline.operators import evaluation as EV
from tankline.plans.registry import query
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG

def conf_ctes(src: str = "scored", x: str = "") -> list[str]:
    return [f"""
cls{x} AS (SELECT DISTINCT c FROM (SELECT y_true AS c FROM {src} UNION ALL SELECT y_pred FROM {src}) u WHERE c IS NOT NULL)""", f"""
cnt{x} AS (SELECT y_true, y_pred, COUNT(*) AS n FROM {src} GROUP BY 1, 2)""", f"""
conf{x} AS (SELECT a.c AS y_true, b.c AS y_pred, CAST(COALESCE(cnt{x}.n, 0) AS BIGINT) AS n
         FROM cls{x} a CROSS JOIN cls{x} b LEFT JOIN cnt{x} ON cnt{x}.y_true = a.c AND cnt{x}.y_pred = b.c)"""]


CONF_CTES = conf_ctes()


@query("confusion", covers=("ML-19", "AG-14"), sql=FX.with_views("""
SELECT c.y_true, c.y_pred, c.n,
       CASE WHEN t.rt = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(c.n * CAST(100 AS DOUBLE) AS DOUBLE) / t.rt END AS row_pct
FROM conf c JOIN (SELECT y_true, SUM(n) AS rt FROM conf GROUP BY y_true) t ON t.y_true = c.y_true""", "scored",
                                                                  ctes=CONF_CTES))
def confusion(spark, sf):
    return EV.confusion(SG.stage(spark, sf, "scored"))


def report_ctes(src: str = "scored", x: str = "") -> list[str]:
    return conf_ctes(src, x) + [f"""
per{x} AS (SELECT s.c, tp.n AS tp, s.support, p.npred,
               CASE WHEN p.npred = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp.n AS DOUBLE) / p.npred END AS precision,
               CASE WHEN s.support = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(tp.n AS DOUBLE) / s.support END AS recall
        FROM (SELECT y_true AS c, SUM(n) AS support FROM conf{x} GROUP BY 1) s
        JOIN (SELECT y_pred AS c, SUM(n) AS npred FROM conf{x} GROUP BY 1) p ON p.c = s.c
        JOIN (SELECT y_true AS c, n FROM conf{x} WHERE y_true = y_pred) tp ON tp.c = s.c)""", f"""
perf{x} AS (SELECT *, CASE WHEN precision + recall = 0 THEN CAST(0 AS DOUBLE)
                        ELSE 2.0 * precision * recall / (precision + recall) END AS f1 FROM per{x})""", f"""
tot{x} AS (SELECT SUM(support) AS n, SUM(tp) AS tp, COUNT(*) AS k, SUM(precision) AS sp, SUM(recall) AS sr, SUM(f1) AS sf,
               SUM(precision * support) AS wp, SUM(recall * support) AS wr, SUM(f1 * support) AS wf FROM perf{x})""", f"""
report{x} AS (
  SELECT CAST(c AS VARCHAR) AS label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM perf{x}
  UNION ALL SELECT 'accuracy', CAST(tp AS DOUBLE) / n, CAST(tp AS DOUBLE) / n, CAST(tp AS DOUBLE) / n, CAST(n AS BIGINT) FROM tot{x}
  UNION ALL SELECT 'macro avg', sp / k, sr / k, sf / k, CAST(n AS BIGINT) FROM tot{x}
  UNION ALL SELECT 'weighted avg', wp / n, wr / n, wf / n, CAST(n AS BIGINT) FROM tot{x})"""]


REPORT_CTES = report_ctes()


@query("class_report", covers=("ML-20",), sql=FX.with_views("SELECT * FROM report", "scored", ctes=REPORT_CTES))
def class_report(spark, sf):
    return EV.class_report(SG.stage(spark, sf, "scored"))


SC_CTES = ["""
sc AS (SELECT CAST(score AS DOUBLE) AS score, SUM(CASE WHEN y_true = 1 THEN 1 ELSE 0 END) AS pos,
              SUM(CASE WHEN y_true = 1 THEN 0 ELSE 1 END) AS neg FROM scored GROUP BY 1)""", """
cum AS (SELECT score, pos, neg,
               SUM(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_pos,
               SUM(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_neg FROM sc)""", """
tt AS (SELECT SUM(pos) AS p, SUM(neg) AS n FROM sc)"""]


@query("roc_points", covers=("ML-21",), sql=FX.with_views("""
SELECT score AS threshold, CAST(cum_neg AS DOUBLE) / tt.n AS fpr, CAST(cum_pos AS DOUBLE) / tt.p AS tpr FROM cum, tt
UNION ALL SELECT CAST('inf' AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE)""", "scored", ctes=SC_CTES))
def roc_points(spark, sf):
    return EV.roc_points(SG.stage(spark, sf, "scored"))


@query("roc_auc", covers=("ML-21",), sql=FX.with_views("""
SELECT SUM(pos * (COALESCE(below, 0) + neg / 2.0)) / (SUM(pos) * SUM(neg)) AS auc
FROM (SELECT score, pos, neg, SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM sc) x""",
                                                            "scored", ctes=SC_CTES))
def roc_auc(spark, sf):
    return EV.roc_auc(SG.stage(spark, sf, "scored"))


@query("pr_points", covers=("ML-22",), sql=FX.with_views("""
SELECT score AS threshold, CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg) AS precision, CAST(cum_pos AS DOUBLE) / tt.p AS recall
FROM cum, tt""", "scored", ctes=SC_CTES))
def pr_points(spark, sf):
    return EV.pr_points(SG.stage(spark, sf, "scored"))


@query("average_precision", covers=("ML-22",), sql=FX.with_views("""
SELECT SUM(pos * (CAST(cum_pos AS DOUBLE) / (cum_pos + cum_neg))) / SUM(pos) AS ap FROM cum""", "scored", ctes=SC_CTES))
def average_precision(spark, sf):
    return EV.average_precision(SG.stage(spark, sf, "scored"))


def _cal_bin_sql() -> str:
    return " + ".join(f"CAST(score > CAST('{e!r}' AS DOUBLE) AS INTEGER)" for e in EV.calibration_edges(10))


@query("calibration", covers=("ML-23",), sql=FX.with_views(f"""
SELECT {_cal_bin_sql()} AS bin, SUM(score) / COUNT(*) AS mean_predicted,
       SUM(CASE WHEN y_true = 1 THEN 1.0 ELSE 0.0 END) / COUNT(*) AS fraction_positive, COUNT(*) AS n
FROM scored GROUP BY 1""", "scored"))
def calibration(spark, sf):
    return EV.calibration(SG.stage(spark, sf, "scored"))


@query("results_summary", covers=("ML-33", "ML-20"), sql=FX.with_views("""
SELECT model, MAX(CASE WHEN label = 'accuracy' THEN f1 END) AS accuracy,
       MAX(CASE WHEN label = 'macro avg' THEN f1 END) AS macro_f1,
       MAX(CASE WHEN label = 'weighted avg' THEN f1 END) AS weighted_f1,
       MAX(CASE WHEN label = '0' THEN f1 END) AS f1_class_0, MAX(CASE WHEN label = '1' THEN f1 END) AS f1_class_1
FROM (
  SELECT 'rule_mod3' AS model, * FROM report
  UNION ALL
  SELECT 'score_half', * FROM report2) r GROUP BY model""", "scored", ctes=[
    "scored2 AS (SELECT doc_id, y_true, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS y_pred FROM scored)",
    *REPORT_CTES, *report_ctes("scored2", "2")]))
def results_summary(spark, sf):
    s = SG.stage(spark, sf, "scored")
    both = (s.select(F.lit("rule_mod3").alias("model"), "y_true", "y_pred")
            .unionByName(s.select(F.lit("score_half").alias("model"), "y_true",
                                  F.when(F.col("score") > 0.5, 1).otherwise(0).alias("y_pred"))))
    return EV.results_summary(both)
