"""Clustering of vehicles and transactions (CL-1..CL-16).

Heavy steps run on Spark: feature preparation, scaling, K-means (``pyspark.ml``),
Gaussian mixtures, clustering-feature summaries and label assignment.
Hierarchical merging (Ward / complete / average / single linkage) runs over a
bounded set of micro-clusters -- (count, centroid) rows produced by a
distributed K-means or by clustering-feature cells -- never over raw points,
so the pairwise-distance matrix of the reference is never built.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.operators import cf_tree as CF
from tankline.operators import kmeans_many as KM
from tankline.operators import mixtures_many as MX
from tankline.operators.joins import checked_broadcast
from tankline.operators.ranking import exact_quantiles
from tankline.operators.temporal import entity_efficiency
from tankline.schema import DEFAULT, TxnCols

FEATURES = "features"
MAX_MICRO = 2000  # largest ``micro`` of the linkage summaries (merged on the driver)


# ------------------------------------------------------------------ features

def standardize(df: DataFrame, cols: Sequence[str], out: str = FEATURES, keep_columns: bool = False) -> DataFrame:
    """CL-1: centre and scale by mean and population std (V17); a constant column
    becomes 0. Adds ``z_<col>`` columns when ``keep_columns`` and the vector ``out``."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
    r = df.agg(*aggs).first()  # 2 scalars per column
    zs = []
    for c in cols:
        m, s = r[f"m_{c}"], r[f"s_{c}"]
        zs.append((F.lit(0.0) if not s else (F.col(c).cast("double") - F.lit(m)) / F.lit(s)).alias(f"z_{c}"))
    d = df.select("*", *zs)
    d = d.withColumn(out, array_to_vector(F.array(*[f"z_{c}" for c in cols])))
    return d if keep_columns else d.drop(*[f"z_{c}" for c in cols])


VEHICLE_FEATURES = ["kmpl", "total_amount", "mean_amount", "total_litres_tx", "mean_litres"]


def vehicle_features(txn: DataFrame, meter: DataFrame, c: TxnCols = DEFAULT) -> DataFrame:
    """CL-2: per vehicle KMPL over the log overlap (PP-6) with transaction totals and
    means; rows with a missing value dropped (FLT-2)."""
    eff = entity_efficiency(txn, meter, c).select(c.entity, "kmpl")
    tot = txn.groupBy(c.entity).agg(
        F.sum(c.amount).cast("double").alias("total_amount"),
        (F.sum(c.amount).cast("double") / F.count(c.amount)).alias("mean_amount"),
        F.sum(c.litres).cast("double").alias("total_litres_tx"),
        (F.sum(c.litres).cast("double") / F.count(c.litres)).alias("mean_litres"))
    d = eff.join(tot, c.entity).where(~F.isnan("kmpl") & (F.abs("kmpl") != F.lit(float("inf"))))
    return d.dropna(subset=VEHICLE_FEATURES)


TXN_FEATURES = ["litres", "amount_cents", "fuel_price"]


def fence_filter(df: DataFrame, cols: Sequence[str], fenced: Sequence[str], lo_q: float = 0.01, hi_q: float = 0.99,
                 k: float = 1.5) -> DataFrame:
    """FLT-10: for each fenced column in turn -- computed on the rows left by the
    previous one -- keep lo - k(hi - lo) <= x <= hi + k(hi - lo) with lo/hi the exact
    (interpolated, V15) quantiles."""
    d = df.dropna(subset=list(cols))
    for c in fenced:
        q = exact_quantiles(d, c, [lo_q, hi_q])
        if q is None:
            return d
        lo, hi = q
        iqr = hi - lo
        d = d.where((F.col(c) >= F.lit(lo - k * iqr)) & (F.col(c) <= F.lit(hi + k * iqr)))
    return d


def transaction_features(priced: DataFrame, c: TxnCols = DEFAULT, with_gap: bool = False) -> DataFrame:
    """CL-3: litres, amount, fuel price by fuel type (+ gap), nulls dropped, fence on
    litres then amount."""
    d = priced.withColumn("fuel_price", F.when(F.col(c.fuel) == "Diesel", F.col(c.coastal_diesel))
                          .otherwise(F.col(c.coastal_petrol)))
    cols = list(TXN_FEATURES) + (["gap_days"] if with_gap else [])
    return fence_filter(d, cols, ["litres", "amount_cents"])


# ------------------------------------------------------------------ K-means

PARALLEL_FITS = 4  # concurrent Spark jobs submitted by driver threads


def parallel_map(fn, items, parallelism: int = PARALLEL_FITS) -> list:
    """Run independent fits as concurrent Spark jobs (driver threads), like
    ``CrossValidator(parallelism=...)``; results keep the input order."""
    items = list(items)
    if parallelism <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    from concurrent.futures import ThreadPoolExecutor
    with ThreadPoolExecutor(max_workers=min(parallelism, len(items))) as ex:
        return list(ex.map(fn, items))


def kmeans_best(df: DataFrame, k: int, restarts: int = 10, max_iter: int = 300, seed: int = 1,
                init: str = "k-means++", features: str = FEATURES, tol: float = 1e-4) -> KM.Centers:
    """CL-5: ``restarts`` K-means fits with different seeds, fitted side by side; the fit
    with the lowest within-cluster sum of squares is kept (ties: the lowest seed)."""
    fits = [KM.Fit(k, seed + r, init, max_iter) for r in range(restarts)]
    return KM.best(KM.fit_many(KM.narrow(df, features), fits, tol))


def best_per_k(df: DataFrame, ks: Sequence[int], restarts: int = 10, max_iter: int = 300, seed: int = 1) -> dict[int, KM.Centers]:
    """The best of ``restarts`` fits for every k; all fits share each pass over the rows."""
    models = KM.fit_many(KM.narrow(df), [KM.Fit(k, seed + r, max_iter=max_iter) for k in ks for r in range(restarts)])
    return {k: KM.best(models[i * restarts : (i + 1) * restarts]) for i, k in enumerate(ks)}


def elbow(df: DataFrame, ks: Sequence[int] = range(1, 11), restarts: int = 10, max_iter: int = 300,
          seed: int = 1) -> DataFrame:
    """CL-6: WCSS of the best of ``restarts`` fits for each k."""
    rows = [(int(k), float(m.cost)) for k, m in best_per_k(df, list(ks), restarts, max_iter, seed).items()]
    return df.sparkSession.createDataFrame(rows, "k int, wcss double")


def elbow_choice(wcss: DataFrame, threshold: float = 0.7, default: int = 4) -> DataFrame:
    """CL-7 (+ WN-9): first k >= 3 where the ratio of successive WCSS drops
    (wcss_k - wcss_k-1) / (wcss_k-1 - wcss_k-2) exceeds the threshold; else default.
    The sweep table has one row per k (bounded)."""
    w = Window.orderBy("k")
    r = (wcss.withColumn("d1", F.col("wcss") - F.lag("wcss", 1).over(w))
         .withColumn("d0", F.lag("wcss", 1).over(w) - F.lag("wcss", 2).over(w))
         .withColumn("rate", F.col("d1") / F.col("d0")))
    pick = r.where((F.col("k") >= 3) & (F.col("rate") > threshold)).agg(F.min("k").alias("k")).first()["k"]
    return wcss.sparkSession.createDataFrame([(int(pick) if pick is not None else default, pick is None)],
                                             "k int, defaulted boolean")


def silhouette(pred: DataFrame, prediction: str = "prediction", features: str = FEATURES) -> float:
    """CL-8: silhouette with squared Euclidean distance (Spark's exact linear-time
    form; the reference uses Euclidean distance)."""
    ev = ClusteringEvaluator(featuresCol=features, predictionCol=prediction, distanceMeasure="squaredEuclidean")
    return float(ev.evaluate(pred))


def silhouette_by_k(df: DataFrame, ks: Sequence[int] = range(2, 11), restarts: int = 10, seed: int = 1) -> DataFrame:
    """CL-8: silhouette per k for the best-of-restarts K-means; the max is marked."""
    models = best_per_k(df, list(ks), restarts, seed=seed)
    rows = parallel_map(lambda k: (int(k), silhouette(models[k].transform(df))), models)
    best = max(rows, key=lambda t: (t[1], -t[0]))[0]
    return df.sparkSession.createDataFrame([(k, s, k == best) for k, s in rows], "k int, silhouette double, best boolean")


# ------------------------------------------------------------------ micro-clusters and linkage

def micro_clusters(df: DataFrame, m: int = 200, seed: int = 1, features: str = FEATURES):
    """Distributed K-means with m centres; returns the model and the (micro, n,
    centroid) summary (bounded by m)."""
    model = KMeans(k=m, maxIter=50, seed=seed, featuresCol=features, predictionCol="micro").fit(df)
    summ = (model.transform(df).groupBy("micro").agg(F.count(F.lit(1)).alias("n"))
            .collect())  # one row per micro-cluster: bounded by m
    centers = model.clusterCenters()
    rows = [(int(r["micro"]), int(r["n"]), np.asarray(centers[r["micro"]], dtype=float)) for r in summ]
    return model, rows


def _dist(a: np.ndarray, b: np.ndarray, metric: str) -> float:
    if metric in ("euclidean", "l2"):
        return float(np.sqrt(((a - b) ** 2).sum()))
    if metric in ("manhattan", "l1"):
        return float(np.abs(a - b).sum())
    if metric == "cosine":
        na, nb = np.linalg.norm(a), np.linalg.norm(b)
        return float(1.0 - (a @ b) / (na * nb)) if na > 0 and nb > 0 else 1.0
    raise ValueError(metric)


def linkage(rows, linkage_kind: str = "ward", metric: str = "euclidean"):
    """CL-9 / CL-10 / CL-24: agglomerative merging of weighted points (n, centroid).
    Ward uses the weighted increase of within-cluster squared error, height
    sqrt(2 * n_a n_b / (n_a + n_b)) * ||c_a - c_b|| (the scipy convention); complete,
    single and average use the given metric between micro-cluster centroids with
    Lance-Williams updates (average weighted by counts). Returns merge rows
    (step, a, b, height, size) with scipy's cluster ids (inputs 0..m-1, merge s
    creates id m + s)."""
    if linkage_kind == "ward" and metric not in ("euclidean", "l2"):
        raise ValueError("ward needs euclidean distances")
    m = len(rows)
    if m > MAX_MICRO:
        raise ValueError(f"too many micro-clusters ({m} > {MAX_MICRO})")
    n = np.array([float(r[1]) for r in rows])
    cen = np.array([r[2] for r in rows], dtype=float)
    D = np.full((m, m), np.inf)
    for i in range(m):
        for j in range(i + 1, m):
            if linkage_kind == "ward":
                D[i, j] = D[j, i] = math.sqrt(2.0 * n[i] * n[j] / (n[i] + n[j])) * float(np.linalg.norm(cen[i] - cen[j]))
            else:
                D[i, j] = D[j, i] = _dist(cen[i], cen[j], metric)
    ids = list(range(m))  # current scipy id held by each slot
    alive = np.ones(m, dtype=bool)
    merges = []
    for step in range(m - 1):
        masked = np.where(alive[:, None] & alive[None, :], D, np.inf)
        flat = int(np.argmin(masked))
        i, j = divmod(flat, m)
        if i > j:
            i, j = j, i
        h = float(masked[i, j])
        a_id, b_id = ids[i], ids[j]
        nn = n[i] + n[j]
        newc = (n[i] * cen[i] + n[j] * cen[j]) / nn
        for o in range(m):
            if not alive[o] or o in (i, j):
                continue
            if linkage_kind == "ward":
                dn = math.sqrt(2.0 * nn * n[o] / (nn + n[o])) * float(np.linalg.norm(newc - cen[o]))
            elif linkage_kind == "complete":
                dn = max(D[i, o], D[j, o])
            elif linkage_kind == "single":
                dn = min(D[i, o], D[j, o])
            elif linkage_kind == "average":
                dn = (n[i] * D[i, o] + n[j] * D[j, o]) / nn
            else:
                raise ValueError(linkage_kind)
            D[i, o] = D[o, i] = dn
        alive[j] = False
        n[i], cen[i] = nn, newc
        ids[i] = m + step
        merges.append((step, min(a_id, b_id), max(a_id, b_id), h, int(nn)))
    return merges


def cut_merges(m: int, merges, n_clusters: int | None = None, height: float | None = None) -> dict[int, int]:
    """CL-11: labels of the m inputs after applying the merges below ``height``
    (fcluster 'distance') or the first m - n_clusters merges; labels 0.. by first
    input index."""
    parent = list(range(m + len(merges)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for step, a, b, h, _ in merges:
        if height is not None and h > height:
            break
        if n_clusters is not None and step >= m - n_clusters:
            break
        parent[find(a)] = m + step
        parent[find(b)] = m + step
    roots, labels = {}, {}
    for i in range(m):
        r = find(i)
        labels[i] = roots.setdefault(r, len(roots))
    return labels


def hierarchical(df: DataFrame, n_clusters: int | None = None, height: float | None = None,
                 linkage_kind: str = "ward", metric: str = "euclidean", micro: int = 200, seed: int = 1,
                 out: str = "prediction"):
    """CL-9 / CL-11: hierarchical clustering of the rows through micro-clusters;
    returns (rows with labels, merge table)."""
    model, rows = micro_clusters(df, micro, seed)
    rows.sort(key=lambda r: r[0])
    merges = linkage(rows, linkage_kind, metric)
    lab = cut_merges(len(rows), merges, n_clusters, height)
    spark = df.sparkSession
    mp = spark.createDataFrame([(rows[i][0], lab[i]) for i in range(len(rows))], f"micro int, {out} int")
    labelled = model.transform(df).join(F.broadcast(mp), "micro").drop("micro")  # bounded by micro
    mt = spark.createDataFrame(merges, "step int, a int, b int, height double, size int")
    return labelled, mt


def birch(df: DataFrame, n_clusters: int, threshold: float = 0.5, out: str = "prediction", features: str = FEATURES,
          restarts: int = 10, seed: int = 1, branching: int = CF.BRANCHING) -> DataFrame:
    """CL-12: a clustering-feature tree of the rows (``cf_tree``), then the global phase: K-means over
    the entries' centroids, weighted by their rows. A row takes the cluster of the entry that
    is nearest to it."""
    entries, _ = CF.subclusters(df, threshold, branching, features)
    d = entries.select("n", array_to_vector(F.transform("total", lambda v: v / F.col("n"))).alias("_c")).checkpoint(eager=True)
    fits = [KM.Fit(n_clusters, seed + r, weight=0) for r in range(restarts)]
    model = KM.best(KM.fit_many(KM.narrow(d, "_c", weights=F.array("n")), fits))
    rows = model.transform(d, "_c", out).select(vector_to_array("_c").alias("c"), out).collect()  # at most CF.MAX_ENTRIES
    near = CF.nearest_label(np.array([r["c"] for r in rows]), np.array([r[out] for r in rows], np.int32))
    return df.withColumn(out, near(vector_to_array(features)))


# ------------------------------------------------------------------ mixtures

def gmm(df: DataFrame, k: int, seed: int = 1, features: str = FEATURES):
    """CL-13: Gaussian mixture with full covariances (pyspark.ml)."""
    return GaussianMixture(k=k, seed=seed, featuresCol=features, maxIter=100, tol=1e-3).fit(df)


def em_mixture(df: DataFrame, k: int, cov: str = "diag", iters: int = 100, seed: int = 1, tol: float = 1e-3,
               features: str = FEATURES):
    """CL-14: one mixture of any covariance type: (weights, means, covariances, log-likelihood)."""
    m = MX.fit_many(df, [(k, cov)], seed, iters, tol, features)[0]
    return m.weight, m.mean, m.covariance, m.log_likelihood


def mixture_grid(df: DataFrame, ks: Sequence[int] = (3, 4, 5, 6), covs: Sequence[str] = MX.COVARIANCES, seed: int = 1) -> DataFrame:
    """CL-14: log-likelihood, AIC, BIC and silhouette per (components, covariance type), all fitted in
    shared passes; the silhouette is null if all rows fall to one component."""
    settings = list(itertools.product(ks, covs))
    models = MX.fit_many(df, settings, seed)
    labelled = df.select(FEATURES, MX.labels_of(models, F.col(FEATURES)).alias("_l")).cache()
    n = labelled.count()
    kinds = labelled.agg(*[F.count_distinct(F.col("_l")[i]).alias(str(i)) for i in range(len(models))]).first()

    def one(i):
        m, (k, cov) = models[i], settings[i]
        sil = silhouette(labelled.select(FEATURES, F.col("_l")[i].alias("prediction"))) if kinds[str(i)] > 1 else None
        ll, p = m.log_likelihood, m.parameters()
        return int(k), cov, ll, 2.0 * p - 2 * ll, p * math.log(n) - 2 * ll, sil

    rows = parallel_map(one, range(len(models)))
    labelled.unpersist()
    return df.sparkSession.createDataFrame(rows, "n_components int, covariance_type string, log_likelihood double, "
                                                 "aic double, bic double, silhouette double")
