"""Queries of the clustering side (CL-*). Feature preparation, ARI, agreement and
co-occurrence on given labels have DuckDB oracles; fits are rows-only and
checked by invariants in tests."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tankline.operators import cluster as CL
from tankline.operators import stability as ST
from tankline.operators import temporal as T
from tankline.plans.flag_queries import EFF_CTES, PRICED_SQL
from tankline.plans.registry import query
from tankline.session import ensure_checkpoint_dir
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG
from tankline.sources.tables import table

VEH_SQL_CTES = EFF_CTES + ["""
veh AS (SELECT k.entity_id, k.kmpl, t.total_amount, t.mean_amount, t.total_litres_tx, t.mean_litres
        FROM k JOIN (SELECT entity_id, CAST(SUM(amount_cents) AS DOUBLE) AS total_amount,
                            CAST(SUM(amount_cents) AS DOUBLE) / COUNT(amount_cents) AS mean_amount,
                            CAST(SUM(litres) AS DOUBLE) AS total_litres_tx,
                            CAST(SUM(litres) AS DOUBLE) / COUNT(litres) AS mean_litres
                     FROM txn GROUP BY entity_id) t ON t.entity_id = k.entity_id
        WHERE NOT isnan(k.kmpl) AND abs(k.kmpl) <> CAST('inf' AS DOUBLE)
          AND t.total_amount IS NOT NULL AND t.mean_amount IS NOT NULL
          AND t.total_litres_tx IS NOT NULL AND t.mean_litres IS NOT NULL)"""]


def vehicles(spark, sf):
    return CL.vehicle_features(SG.stage(spark, sf, "txn"), SG.stage(spark, sf, "meter"))


def vehicles_scaled(spark, sf):
    return CL.standardize(vehicles(spark, sf), CL.VEHICLE_FEATURES).withColumnRenamed("entity_id", "id").cache()


@query("scaled_features", covers=("CL-1", "CL-2", "V17", "FLT-2"), sql=FX.with_views(
    "SELECT entity_id, " + ", ".join(
        f"ROUND(CASE WHEN s.s_{c} = 0 THEN 0.0 ELSE (v.{c} - s.m_{c}) / s.s_{c} END, 9) AS z_{c}" for c in CL.VEHICLE_FEATURES)
    + " FROM veh v, (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in CL.VEHICLE_FEATURES)
    + " FROM veh) s", "txn", "meter", ctes=VEH_SQL_CTES))
def scaled_features(spark, sf):
    d = CL.standardize(vehicles(spark, sf), CL.VEHICLE_FEATURES, keep_columns=True)
    # reported to 9 decimals: the last digits of mean and std depend on summation order
    return d.select("entity_id", *[F.round(f"z_{c}", 9).alias(f"z_{c}") for c in CL.VEHICLE_FEATURES])


def _fence_sql() -> list[str]:
    return [PRICED_SQL, """
tf0 AS (SELECT txn_id, litres, amount_cents,
               CASE WHEN fuel_type = 'Diesel' THEN coastal_diesel_cents ELSE coastal_petrol_cents END AS fuel_price
        FROM priced)""", """
tf1 AS (SELECT * FROM tf0 WHERE litres IS NOT NULL AND amount_cents IS NOT NULL AND fuel_price IS NOT NULL
                            AND NOT isnan(fuel_price))""", """
q1 AS (SELECT quantile_cont(litres, 0.01) AS lo, quantile_cont(litres, 0.99) AS hi FROM tf1)""", """
tf2 AS (SELECT tf1.* FROM tf1, q1 WHERE litres >= lo - 1.5 * (hi - lo) AND litres <= hi + 1.5 * (hi - lo))""", """
q2 AS (SELECT quantile_cont(amount_cents, 0.01) AS lo, quantile_cont(amount_cents, 0.99) AS hi FROM tf2)""", """
tf3 AS (SELECT tf2.* FROM tf2, q2 WHERE amount_cents >= lo - 1.5 * (hi - lo) AND amount_cents <= hi + 1.5 * (hi - lo))"""]


def transactions(spark, sf):
    priced = SG.stage(spark, sf, "priced")
    return CL.transaction_features(priced)


def transactions_scaled(spark, sf):
    return CL.standardize(transactions(spark, sf), CL.TXN_FEATURES).withColumnRenamed("txn_id", "id").cache()


@query("fence_filter", covers=("FLT-10", "AG-15", "CL-3", "FLT-2", "V15"), sql=FX.with_views(
    "SELECT txn_id, litres, amount_cents, fuel_price FROM tf3", "txn", "price", ctes=_fence_sql()))
def fence_filter(spark, sf):
    return transactions(spark, sf).select("txn_id", "litres", "amount_cents", "fuel_price")


# ------------------------------------------------------------------ fits (rows-only)

@query("kmeans_vehicles", covers=("CL-5", "CL-2"))
def kmeans_vehicles(spark, sf):
    d = vehicles_scaled(spark, sf)
    return CL.kmeans_best(d, 3, restarts=10).transform(d).select("id", F.col("prediction").alias("cluster"))


@query("kmeans_transactions", covers=("CL-5", "CL-3"))
def kmeans_transactions(spark, sf):
    d = transactions_scaled(spark, sf)
    return CL.kmeans_best(d, 4).transform(d).select("id", F.col("prediction").alias("cluster"))


@query("elbow", covers=("CL-6",))
def elbow(spark, sf):
    return CL.elbow(vehicles_scaled(spark, sf), range(1, 11))


@query("elbow_choice", covers=("CL-7", "WN-9"))
def elbow_choice(spark, sf):
    return CL.elbow_choice(CL.elbow(vehicles_scaled(spark, sf), range(1, 11)), default=3)


@query("silhouette_by_k", covers=("CL-8",))
def silhouette_by_k(spark, sf):
    return CL.silhouette_by_k(vehicles_scaled(spark, sf))


@query("ward_merges", covers=("CL-9", "CL-10"))
def ward_merges(spark, sf):
    _, merges = CL.hierarchical(vehicles_scaled(spark, sf), n_clusters=3)
    return merges


@query("ward_labels", covers=("CL-9", "CL-11"))
def ward_labels(spark, sf):
    d = vehicles_scaled(spark, sf)
    lab, _ = CL.hierarchical(d, n_clusters=3)
    return lab.select("id", F.col("prediction").alias("cluster"))


@query("ward_cut_height", covers=("CL-11",))
def ward_cut_height(spark, sf):
    lab, _ = CL.hierarchical(vehicles_scaled(spark, sf), height=6.0)
    return lab.select("id", F.col("prediction").alias("cluster"))


@query("birch", covers=("CL-12",))
def birch(spark, sf):
    lab = CL.birch(transactions_scaled(spark, sf), 4, threshold=0.5)
    return lab.select("id", F.col("prediction").alias("cluster"))


@query("gmm_transactions", covers=("CL-13",))
def gmm_transactions(spark, sf):
    d = transactions_scaled(spark, sf)
    return CL.gmm(d, 4).transform(d).select("id", F.col("prediction").alias("cluster"))


@query("mixture_grid", covers=("CL-14",))
def mixture_grid(spark, sf):
    return CL.mixture_grid(transactions_scaled(spark, sf), ks=(3, 4, 5, 6))


# ------------------------------------------------------------------ agreement on given labels (SQL)

def _ari_sql(a: str, b: str, src: str = "txn") -> str:
    return f"""
SELECT CASE WHEN mx = ex THEN 1.0 ELSE (sij - ex) / (mx - ex) END AS ari FROM (
  SELECT sij, sa * sb / (n * (n - 1) / 2) AS ex, (sa + sb) / 2 AS mx FROM (
    SELECT (SELECT SUM(n * (n - 1) / 2) FROM c) AS sij,
           (SELECT SUM(s * (s - 1) / 2) FROM (SELECT SUM(n) AS s FROM c GROUP BY {a}) x) AS sa,
           (SELECT SUM(s * (s - 1) / 2) FROM (SELECT SUM(n) AS s FROM c GROUP BY {b}) y) AS sb,
           (SELECT SUM(n) FROM c) AS n) t) u"""


@query("ari", covers=("CL-19",), sql=FX.with_views(_ari_sql("department", "category"), "txn", ctes=["""
c AS (SELECT department, category, CAST(COUNT(*) AS DOUBLE) AS n FROM txn
      WHERE department IS NOT NULL AND category IS NOT NULL GROUP BY 1, 2)"""]))
def ari(spark, sf):
    return ST.ari(SG.stage(spark, sf, "txn"), "department", "category")


LABELS = ["department", "category", "fuel_type"]


def _agree_sql() -> str:
    parts = []
    ctes = []
    import itertools
    for i, (x, y) in enumerate(itertools.permutations(LABELS, 2)):
        ctes.append(f"c{i} AS (SELECT {x}, {y}, CAST(COUNT(*) AS DOUBLE) AS n FROM txn WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY 1, 2)")
        body = _ari_sql(x, y).replace("FROM c)", f"FROM c{i})").replace("FROM c GROUP", f"FROM c{i} GROUP")
        parts.append(f"SELECT '{x} vs {y}' AS pair, '{x}' AS a, '{y}' AS b, ari FROM ({body}) r{i}")
    return FX.with_views(" UNION ALL ".join(parts), "txn", ctes=ctes)


@query("agreement_matrix", covers=("CL-20", "RS-6"), sql=_agree_sql())
def agreement_matrix(spark, sf):
    return ST.agreement_matrix(SG.stage(spark, sf, "txn"), LABELS)


@query("cooccurrence", covers=("CL-18", "JN-15"), sql=FX.with_views("""
SELECT s.department AS base, s.size,
       CASE WHEN s.size <= 1 OR COALESCE(p.pairs, 0) = 0 THEN 1.0 ELSE t.together / p.pairs END AS stability
FROM (SELECT department, COUNT(*) AS size FROM txn GROUP BY department) s
LEFT JOIN (SELECT base, SUM(n * n - n) / 2 AS together FROM (
             SELECT department AS base, rep, label, CAST(COUNT(*) AS DOUBLE) AS n FROM reps GROUP BY 1, 2, 3) g GROUP BY base) t
  ON t.base = s.department
LEFT JOIN (SELECT base, SUM(n * n - n) / 2 AS pairs FROM (
             SELECT department AS base, rep, CAST(COUNT(*) AS DOUBLE) AS n FROM reps GROUP BY 1, 2) g GROUP BY base) p
  ON p.base = s.department""", "txn", ctes=["""
reps AS (SELECT department, 'category' AS rep, category AS label FROM txn
         UNION ALL SELECT department, 'site', site FROM txn)"""]))
def cooccurrence(spark, sf):
    t = SG.stage(spark, sf, "txn")
    base = t.select(F.col("txn_id").alias("id"), F.col("department").alias("base"))
    reps = (t.select(F.col("txn_id").alias("id"), F.lit("category").alias("replicate"), F.col("category").alias("label"))
            .unionByName(t.select(F.col("txn_id").alias("id"), F.lit("site").alias("replicate"), F.col("site").alias("label")))
            .withColumn("w", F.lit(1.0)))
    return ST.cooccurrence_stability(base, reps, "id")


# ------------------------------------------------------------------ stability fits (rows-only)

@query("bootstrap_centroids", covers=("CL-17", "SR-6", "D16"))
def bootstrap_centroids(spark, sf):
    return ST.bootstrap_centroids(vehicles_scaled(spark, sf), 3, feature_names=CL.VEHICLE_FEATURES)


@query("bootstrap_cooccurrence", covers=("CL-18", "SR-6"))
def bootstrap_cooccurrence(spark, sf):
    return ST.bootstrap_cooccurrence(vehicles_scaled(spark, sf), 3)


@query("feature_impact", covers=("CL-21",))
def feature_impact(spark, sf):
    return ST.feature_impact(vehicles_scaled(spark, sf), 3, CL.VEHICLE_FEATURES)


@query("temporal_cluster_stability", covers=("CL-22", "AG-16"))
def temporal_cluster_stability(spark, sf):
    priced = SG.stage(spark, sf, "priced")
    feats = CL.transaction_features(priced).withColumnRenamed("txn_id", "id")
    d = CL.standardize(feats, CL.TXN_FEATURES)
    return ST.temporal_stability(d, "ts", k=4, min_rows=100)  # months hold about 200 rows at the smallest check scale


@query("kmeans_grid", covers=("CL-23",))
def kmeans_grid(spark, sf):
    return ST.kmeans_grid(vehicles_scaled(spark, sf))


@query("linkage_grid", covers=("CL-24",))
def linkage_grid(spark, sf):
    return ST.linkage_grid(vehicles_scaled(spark, sf))


@query("best_kmeans_settings", covers=("CL-25", "SR-4"))
def best_kmeans_settings(spark, sf):
    return ST.best_settings(ST.kmeans_grid(vehicles_scaled(spark, sf)))


@query("silhouette_by_algorithm", covers=("CL-27", "CL-8"))
def silhouette_by_algorithm(spark, sf):
    return ST.silhouette_by_algorithm(vehicles_scaled(spark, sf), 3)


@query("stability_report", covers=("CL-26", "SNK-2"))
def stability_report(spark, sf):
    """The reference's six parts, and the centroids' spread."""
    d = vehicles_scaled(spark, sf)
    curve = CL.elbow(d, range(2, 11)).cache()
    labels = ST.algorithm_labels(d, 3)
    parts = {"optimal_clusters": CL.elbow_choice(curve, default=3), "silhouette_scores": CL.silhouette_by_k(d), "inertia_values": curve,
             "cluster_stability": ST.bootstrap_cooccurrence(d, 3), "feature_importance": ST.feature_impact(d, 3, CL.VEHICLE_FEATURES),
             "algorithm_agreement": ST.agreement_matrix(labels, [c for c in labels.columns if c != "id"]),
             "centroids": ST.bootstrap_centroids(d, 3, feature_names=CL.VEHICLE_FEATURES)}
    path = os.path.join(ensure_checkpoint_dir(spark), "reports", "stability_report")
    return ST.stability_report(path, parts)


@query("labels_attached", covers=("JN-7", "JN-6", "AG-14"))
def labels_attached(spark, sf):
    """Transaction clusters attached to every transaction by id (rows removed by the
    fence keep a null label), and vehicle K-means vs Ward labels joined per vehicle."""
    d = transactions_scaled(spark, sf)
    lab = CL.kmeans_best(d, 4).transform(d).select(F.col("id").alias("txn_id"),
                                                               F.col("prediction").alias("cluster"))
    t = SG.stage(spark, sf, "txn").select("txn_id", "entity_id")
    full = t.join(lab, "txn_id", "left")
    v = vehicles_scaled(spark, sf)
    km = CL.kmeans_best(v, 3).transform(v).select("id", F.col("prediction").alias("kmeans"))
    ward, _ = CL.hierarchical(v, n_clusters=3)
    both = km.join(ward.select("id", F.col("prediction").alias("ward")), "id")
    pairs = both.groupBy("kmeans", "ward").count()
    per_cluster = full.groupBy("cluster").count().withColumnRenamed("count", "n_txn")
    return pairs.unionByName(per_cluster.select(F.col("cluster").alias("kmeans"), F.lit(None).cast("int").alias("ward"),
                                                F.col("n_txn").alias("count")))


# ------------------------------------------------------------------ selection steps on given tables (SQL)

@query("elbow_rule", covers=("CL-7", "WN-9"), sql="""
WITH w AS (SELECT c_nationkey + 1 AS k, 1e6 / (c_nationkey + 1) + SUM(c_acctbal) AS wcss FROM customer WHERE c_nationkey < 10 GROUP BY c_nationkey),
r AS (SELECT k, (wcss - lag(wcss) OVER (ORDER BY k)) / (lag(wcss) OVER (ORDER BY k) - lag(wcss, 2) OVER (ORDER BY k)) AS rate FROM w)
SELECT CAST(COALESCE(MIN(k) FILTER (k >= 3 AND rate > 0.7), 4) AS INTEGER) AS k, COUNT(*) FILTER (k >= 3 AND rate > 0.7) = 0 AS defaulted FROM r""")
def elbow_rule(spark, sf):
    """The elbow rule on a given curve (one point per nation)."""
    c = table(spark, sf, "customer").where("c_nationkey < 10").groupBy((F.col("c_nationkey") + 1).alias("k")).agg(F.sum("c_acctbal").alias("s"))
    return CL.elbow_choice(c.select("k", (F.lit(1e6) / F.col("k") + F.col("s")).alias("wcss")))


@query("best_settings_rule", covers=("CL-25", "SR-4"), sql="""
SELECT CAST(c_nationkey AS INTEGER) AS k, c_mktsegment AS init, MAX(c_acctbal) AS silhouette FROM customer
GROUP BY c_nationkey, c_mktsegment ORDER BY silhouette DESC, k, init LIMIT 5""")
def best_settings_rule(spark, sf):
    g = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("int").alias("k"), F.col("c_mktsegment").alias("init")).agg(
        F.max("c_acctbal").alias("silhouette"))
    return ST.best_settings(g)


@query("labels_joined", covers=("JN-6", "JN-7"), sql=FX.with_views("""
SELECT t.txn_id, f.cluster, v.first_label, v.second_label FROM txn t
LEFT JOIN (SELECT txn_id, CAST(litres % 4 AS INTEGER) AS cluster FROM txn WHERE amount_cents > 5000000) f ON f.txn_id = t.txn_id
LEFT JOIN (SELECT x.entity_id, x.l AS first_label, y.l AS second_label
           FROM (SELECT entity_id, MIN(site) AS l FROM txn GROUP BY entity_id) x
           JOIN (SELECT entity_id, MAX(category) AS l FROM txn WHERE litres > 60 GROUP BY entity_id) y ON x.entity_id = y.entity_id) v
  ON v.entity_id = t.entity_id""", "txn"))
def labels_joined(spark, sf):
    """Labels of part of the rows attached to all of them by id, and two labelings of the
    vehicles joined."""
    t = SG.stage(spark, sf, "txn")
    some = t.where("amount_cents > 5000000").select("txn_id", (F.col("litres") % 4).cast("int").alias("cluster"))
    one = t.groupBy("entity_id").agg(F.min("site").alias("first_label"))
    two = t.where("litres > 60").groupBy("entity_id").agg(F.max("category").alias("second_label"))
    return (t.select("txn_id", "entity_id").join(some, "txn_id", "left").join(one.join(two, "entity_id"), "entity_id", "left")
            .select("txn_id", "cluster", "first_label", "second_label"))
