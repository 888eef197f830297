"""Cluster stability and agreement (JN-15, CL-17..CL-27).

Agreement (ARI) comes from contingency counts; co-occurrence stability from
per (base cluster, replicate, label) sums of bootstrap weights -- the pair sums
of the reference are expressed through group sums, so no pair of points is
ever materialised. Bootstrap replicates use Poisson(1) weights drawn from a
seeded hash of (row id, replicate), fed to K-means as ``weightCol``.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.operators import cluster as CL
from tankline.operators import kmeans_many as KM
from tankline.session import spread

# Poisson(1) cumulative probabilities P(X <= j), j = 0..11, from the rule e^-1 sum 1/i!.
POISSON1_CDF = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(j + 1)) for j in range(12)]


def _c2(x: Column) -> Column:
    return x * (x - 1) / 2


def ari(df: DataFrame, a: str, b: str) -> DataFrame:
    """CL-19: adjusted Rand index of two labelings (rows with a null label dropped);
    1.0 when both labelings are trivial. Contingency counts, their margins and the
    pair counts are one union of small aggregates folded into one row."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    nij = d.groupBy(a, b).agg(F.count(F.lit(1)).cast("double").alias("n"))
    parts = (nij.select(F.lit("ij").alias("t"), _c2(F.col("n")).alias("v"), F.col("n"))
             .unionByName(nij.groupBy(a).agg(F.sum("n").alias("s"))
                          .select(F.lit("a").alias("t"), _c2(F.col("s")).alias("v"), F.lit(0.0).alias("n")))
             .unionByName(nij.groupBy(b).agg(F.sum("n").alias("s"))
                          .select(F.lit("b").alias("t"), _c2(F.col("s")).alias("v"), F.lit(0.0).alias("n"))))
    t = parts.agg(F.sum(F.when(F.col("t") == "ij", F.col("v"))).alias("sij"),
                  F.sum(F.when(F.col("t") == "a", F.col("v"))).alias("sa"),
                  F.sum(F.when(F.col("t") == "b", F.col("v"))).alias("sb"),
                  F.sum(F.col("n")).alias("n"))
    exp = F.col("sa") * F.col("sb") / _c2(F.col("n"))
    mx = (F.col("sa") + F.col("sb")) / 2
    return t.select(F.when(mx == exp, F.lit(1.0)).otherwise((F.col("sij") - exp) / (mx - exp)).alias("ari"))


def agreement_matrix(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """CL-20: ARI for every ordered pair of different labelings (both directions)."""
    out = None
    for x, y in itertools.permutations(labels, 2):
        r = ari(df, x, y).select(F.lit(f"{x} vs {y}").alias("pair"), F.lit(x).alias("a"), F.lit(y).alias("b"), "ari")
        out = r if out is None else out.unionByName(r)
    return out


def poisson_weight(key: Column, replicate: Column, seed: int) -> Column:
    """Poisson(1) draw from a uniform made of a seeded hash of (key, replicate)."""
    h = F.xxhash64(key, replicate, F.lit(seed))
    u = (F.pmod(h, F.lit(1 << 52)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return sum((u > F.lit(p)).cast("int") for p in POISSON1_CDF)


_P1, _P2, _P3, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def _hash_int(value, h: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int, following on the hash ``h`` of the columns before it."""
    h = (h + _P5 + np.uint64(4)) ^ (np.asarray(value, np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def poisson_weights(key_hash: np.ndarray, n_boot: int, seed: int) -> np.ndarray:
    """(rows, replicates): ``poisson_weight`` of every row in every replicate, from the xxhash64 of the rows' keys."""
    h = key_hash.astype(np.int64).view(np.uint64)
    out = np.empty((len(h), n_boot), np.int8)
    for r in range(n_boot):
        u = ((_hash_int(seed & 0xFFFFFFFF, _hash_int(r, h)) & np.uint64((1 << 52) - 1)).astype(float) + 0.5) / float(1 << 52)
        out[:, r] = np.searchsorted(POISSON1_CDF, u, "left")
    return out


def bootstrap_weights(n_boot: int, key: str = "id", seed: int = 1) -> Column:
    """SR-6: the weights of a row in every replicate, as an array; taken in arrays, as Spark interprets a lambda
    over the replicates element by element."""
    @F.pandas_udf("array<tinyint>")
    def of(h: pd.Series) -> pd.Series:
        return pd.Series(list(poisson_weights(h.to_numpy(), n_boot, seed)), dtype=object)

    return of(F.xxhash64(F.col(key)))


def bootstrap_fits(df: DataFrame, k: int, n_boot: int = 100, key: str = "id", seed: int = 1, restarts: int = 10):
    """SR-6 + CL-5: per replicate the best of ``restarts`` weighted K-means fits, all fitted
    side by side; returns (base fit, fits of the replicates)."""
    w = F.concat(F.array(F.lit(1).cast("tinyint")), bootstrap_weights(n_boot, key, seed))
    fits = [KM.Fit(k, seed + 1000 * r + i, weight=r) for r in range(n_boot + 1) for i in range(restarts)]
    models = KM.fit_many(KM.narrow(df, weights=w), fits)
    each = [KM.best(models[r * restarts : (r + 1) * restarts]) for r in range(n_boot + 1)]
    return each[0], each[1:]


def _match(base: np.ndarray, other: np.ndarray) -> list[int]:
    """Permutation of ``other``'s centres closest to ``base`` (exhaustive for small k,
    greedy otherwise) -- D16."""
    k = len(base)
    if k <= 7:
        best = min(itertools.permutations(range(k)),
                   key=lambda p: sum(float(((base[i] - other[p[i]]) ** 2).sum()) for i in range(k)))
        return list(best)
    left, out = set(range(k)), []
    for i in range(k):
        j = min(left, key=lambda j: float(((base[i] - other[j]) ** 2).sum()))
        out.append(j)
        left.remove(j)
    return out


def bootstrap_centroids(df: DataFrame, k: int = 3, n_boot: int = 100, key: str = "id", seed: int = 1,
                        feature_names: Sequence[str] | None = None, restarts: int = 10) -> DataFrame:
    """CL-17: mean, std and coefficient of variation of every centroid coordinate over
    bootstrap replicates, after matching each replicate's centres to the base fit."""
    first, reps = bootstrap_fits(df, k, n_boot, key, seed, restarts)
    base = np.array(first.clusterCenters())
    cents = []
    for m in reps:
        c = np.array(m.clusterCenters())
        if len(c) == k:
            cents.append(c[_match(base, c)])
    arr = np.array(cents)
    mean, std = arr.mean(axis=0), arr.std(axis=0)
    names = list(feature_names or [f"f{i}" for i in range(base.shape[1])])
    rows = [(int(c), names[f], float(mean[c, f]), float(std[c, f]),
             float(std[c, f] / abs(mean[c, f])) if mean[c, f] != 0 else None)
            for c in range(k) for f in range(base.shape[1])]
    return df.sparkSession.createDataFrame(rows, "cluster int, feature string, mean double, std double, cv double")


def cooccurrence_stability(base_labels: DataFrame, rep_labels: DataFrame, key: str = "id", base: str = "base",
                           rep: str = "replicate", label: str = "label", weight: str = "w") -> DataFrame:
    """CL-18 / JN-15: per base cluster, the share of co-sampled member pairs that a
    replicate puts in the same cluster, summed over replicates (ratio of sums):
    sum_{r,l} ((sum w)^2 - sum w^2) / sum_r ((sum w)^2 - sum w^2) over the cluster's
    members, which counts pairs (with bootstrap multiplicity) from group sums only.
    Clusters with fewer than two members score 1.0."""
    j = rep_labels.join(base_labels.select(key, base), key)
    g = j.groupBy(base, rep, label).agg(F.sum(weight).alias("s1"), F.sum(F.col(weight) * F.col(weight)).alias("s2"))
    return _pair_shares(g, base_labels.groupBy(base).agg(F.count(F.lit(1)).alias("size")), base, rep)


def _pair_shares(g: DataFrame, size: DataFrame, base: str, rep: str) -> DataFrame:
    """The stability from the sums ``s1`` and ``s2`` per (base, replicate, label) and the clusters' sizes."""
    pairs = (F.col("s1") * F.col("s1") - F.col("s2")) / 2
    same = g.groupBy(base).agg(F.sum(pairs).alias("together"))
    tot = (g.groupBy(base, rep).agg(F.sum("s1").alias("s1"), F.sum("s2").alias("s2"))
           .groupBy(base).agg(F.sum(pairs).alias("pairs")))
    out = size.join(same, base, "left").join(tot, base, "left")
    return out.select(base, "size", F.when((F.col("size") <= 1) | (F.coalesce("pairs", F.lit(0.0)) == 0), F.lit(1.0))
                      .otherwise(F.col("together") / F.col("pairs")).alias("stability"))


def bootstrap_cooccurrence(df: DataFrame, k: int = 3, n_boot: int = 100, key: str = "id", seed: int = 1,
                           restarts: int = 10) -> DataFrame:
    """CL-18 end to end: base K-means labels, replicate fits, and in one pass the sums of Poisson weights per
    (base label, replicate, label), then the group-sum form."""
    base_model, reps = bootstrap_fits(df, k, n_boot, key, seed, restarts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, size = np.zeros((2, n_boot, k * k)), np.zeros(k, np.int64)
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["a"].to_numpy())
            base = KM._assign(x, base_model)[0]
            size += np.bincount(base, minlength=k)
            known = b["known"].to_numpy(bool)
            w = poisson_weights(b["h"].to_numpy(), n_boot, seed) * known[:, None].astype(float)
            for r, m in enumerate(reps):
                cell = base * k + KM._assign(x, m)[0]
                s[0, r] += np.bincount(cell, w[:, r], k * k)
                s[1, r] += np.bincount(cell, w[:, r] * w[:, r], k * k)
        r, cell = np.divmod(np.arange(n_boot * k * k), k * k)
        yield pd.DataFrame({"base": cell // k, "replicate": r, "label": cell % k, "s1": s[0].ravel(), "s2": s[1].ravel(), "n": 0})
        yield pd.DataFrame({"base": np.arange(k), "replicate": -1, "label": -1, "s1": 0.0, "s2": 0.0, "n": size})

    rows = df.select(vector_to_array(CL.FEATURES).alias("a"), F.xxhash64(F.col(key)).alias("h"), F.col(key).isNotNull().alias("known"))
    part = rows.mapInPandas(run, "base int, replicate int, label int, s1 double, s2 double, n long")
    g = part.groupBy("base", "replicate", "label").agg(*[F.sum(c).alias(c) for c in ("s1", "s2", "n")]).cache()
    size = g.where("replicate < 0 and n > 0").select("base", F.col("n").alias("size"))
    return _pair_shares(g.where("replicate >= 0").drop("n"), size, "base", "replicate")


def feature_impact(df: DataFrame, k: int, names: Sequence[str], key: str = "id", seed: int = 1, restarts: int = 10) -> DataFrame:
    """CL-21: refit without each feature; impact = 1 - ARI against the labels of the
    full-feature fit. All fits share the passes."""
    dims = [tuple(range(len(names))), *[tuple(j for j in range(len(names)) if j != i) for i in range(len(names))]]
    models = KM.fit_many(KM.narrow(df), [KM.Fit(k, seed + r, dims=x) for x in dims for r in range(restarts)])
    each = [KM.best(models[i * restarts : (i + 1) * restarts]) for i in range(len(dims))]
    lab = df.select(key, KM.labels_of(each, F.col(CL.FEATURES)).alias("_l"))
    lab = lab.select(*[F.col("_l")[i].alias(f"l{i}") for i in range(len(dims))]).cache()
    out = None
    for i, nm in enumerate(names):
        a = ari(lab, "l0", f"l{i + 1}").select(F.lit(nm).alias("feature"), (F.lit(1.0) - F.col("ari")).alias("impact"))
        out = a if out is None else out.unionByName(a)
    return out


def temporal_stability(df: DataFrame, ts: str, k: int = 4, min_rows: int = 1000, key: str = "id", seed: int = 1,
                       restarts: int = 10) -> DataFrame:
    """CL-22: for consecutive months with more than ``min_rows`` rows (AG-16, at least
    three needed), the month-t model applied to month t+1 against a refit on t+1:
    ARI per month pair. All months are fitted side by side, and one pass over the rows
    counts the (previous label, own label) pairs of every month."""
    m = df.withColumn("_m", F.date_format(F.col(ts), "yyyy-MM"))
    months = [r[0] for r in m.groupBy("_m").count().where(F.col("count") > min_rows).orderBy("_m").collect()]
    schema = "month string, next_month string, ari double"
    if len(months) < 3:
        return df.sparkSession.createDataFrame([], schema)
    d = KM.narrow(m.where(F.col("_m").isin(months)), group=F.col("_m"))
    fits = [KM.Fit(k, seed + r, group=mo) for mo in months for r in range(restarts)]
    models = KM.fit_many(d, fits)
    each = [KM.best(models[i * restarts : (i + 1) * restarts]) for i in range(len(months))]
    lab = KM.labels_of(each, array_to_vector("a"))
    at = F.array_position(F.array(*map(F.lit, months)), F.col("g")).cast("int")
    pairs = (d.select("g", at.alias("i"), lab.alias("l")).where("i > 1")
             .groupBy("g", F.get("l", F.col("i") - 2).alias("prev"), F.get("l", F.col("i") - 1).alias("refit")).count().collect())
    rows = []
    for a, b in zip(months[:-1], months[1:]):
        t = np.zeros((k, k))
        for r in pairs:  # k x k counts per month
            if r["g"] == b:
                t[r["prev"], r["refit"]] = r["count"]
        rows.append((a, b, ari_of_table(t)))
    return df.sparkSession.createDataFrame(rows, schema)


def ari_of_table(t: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table."""
    c2 = lambda x: float((x * (x - 1) / 2).sum())
    same, a, b = c2(t), c2(t.sum(axis=1)), c2(t.sum(axis=0))
    n = float(t.sum())
    expected, most = a * b / (n * (n - 1) / 2), (a + b) / 2
    return 1.0 if most == expected else (same - expected) / (most - expected)


def kmeans_grid(df: DataFrame, ks=(2, 3, 4, 5), inits=("k-means++", "random"), restarts=(10, 20),
                iters=(200, 300, 500), seed: int = 1) -> DataFrame:
    """CL-23: silhouette and WCSS for every (k, init, restarts, iterations). Settings share
    fits: 10 restarts are the first 10 of 20."""
    d = spread(df.select(CL.FEATURES).checkpoint(eager=True))
    data = KM.narrow(d)
    longest = [KM.Fit(k, seed + r, init, max(iters)) for k in ks for init in inits for r in range(max(restarts))]
    fitted = dict(zip(longest, KM.fit_many(data, longest)))
    # a fit that settled within fewer iterations is the same under that limit
    cut = [KM.Fit(f.k, f.seed, f.init, it) for f in longest for it in iters if it != max(iters)]
    settled = {f: fitted[KM.Fit(f.k, f.seed, f.init, max(iters))] for f in cut}
    settled = {f: m for f, m in settled.items() if m.iterations < f.max_iter}
    rest = [f for f in cut if f not in settled]
    fitted |= settled | (dict(zip(rest, KM.fit_many(data, rest))) if rest else {})
    settings = list(itertools.product(ks, inits, restarts, iters))
    chosen = [KM.best([fitted[KM.Fit(k, seed + i, init, it)] for i in range(r)]) for k, init, r, it in settings]
    unique = list({id(m): m for m in chosen}.values())

    def score(m):
        p = m.transform(d)
        return None if p.select("prediction").distinct().limit(2).count() < 2 else CL.silhouette(p)

    of = {id(m): s for m, s in zip(unique, CL.parallel_map(score, unique))}
    rows = [(int(k), init, int(r), int(it), of[id(m)], float(m.cost)) for (k, init, r, it), m in zip(settings, chosen) if of[id(m)] is not None]
    return df.sparkSession.createDataFrame(rows, "k int, init string, restarts int, max_iter int, silhouette double, "
                                                 "wcss double")


def linkage_grid(df: DataFrame, ks=(2, 3, 4, 5), linkages=("ward", "complete", "average"),
                 metrics=("euclidean", "l1", "l2", "manhattan"), micro: int = 200, seed: int = 1) -> DataFrame:
    """CL-24: silhouette for every (k, linkage, metric) over one micro-cluster summary;
    ward only with euclidean (as the reference skips the rest)."""
    model, rows = CL.micro_clusters(df, micro, seed)
    rows.sort(key=lambda r: r[0])
    assigned = model.transform(df).select(CL.FEATURES, "micro").cache()
    out = []
    for lk, mt in itertools.product(linkages, metrics):
        if lk == "ward" and mt != "euclidean":
            continue
        merges = CL.linkage(rows, lk, mt)
        for k in ks:
            lab = CL.cut_merges(len(rows), merges, n_clusters=k)
            mp = df.sparkSession.createDataFrame([(rows[i][0], lab[i]) for i in range(len(rows))],
                                                 "micro int, prediction int")
            p = assigned.join(F.broadcast(mp), "micro")  # one row per micro-cluster: bounded
            if len(set(lab.values())) < 2:
                continue
            out.append((int(k), lk, mt, CL.silhouette(p)))
    assigned.unpersist()
    return df.sparkSession.createDataFrame(out, "k int, linkage string, metric string, silhouette double")


def best_settings(grid: DataFrame, metric: str = "silhouette", n: int = 5) -> DataFrame:
    """CL-25 / SR-4: the n best settings by the metric (ties by the setting columns)."""
    keys = [c for c in grid.columns if c != metric]
    return grid.orderBy(F.desc(metric), *keys).limit(n)


def algorithm_labels(df: DataFrame, k: int = 3, key: str = "id", seed: int = 1) -> DataFrame:
    """(key, kmeans, birch, mixture): labels of three algorithms that run over all rows."""
    d = CL.kmeans_best(df, k, seed=seed).transform(df).withColumnRenamed("prediction", "kmeans")
    d = CL.birch(d, k, out="birch", seed=seed)
    mixture = CL.MX.labels_of(CL.MX.fit_many(df, [(k, "full")], seed), F.col(CL.FEATURES))[0]
    return d.select(key, "kmeans", "birch", mixture.alias("mixture")).checkpoint(eager=True)


def silhouette_by_algorithm(df: DataFrame, k: int = 3, seed: int = 1) -> DataFrame:
    """CL-27: silhouette of K-means, Ward (micro-clusters), BIRCH and the Gaussian
    mixture at the same k; the best is marked."""
    rows = []
    km = CL.kmeans_best(df, k, seed=seed).transform(df)
    rows.append(("KMeans", CL.silhouette(km)))
    ward, _ = CL.hierarchical(df, n_clusters=k, seed=seed)
    rows.append(("Agglomerative", CL.silhouette(ward)))
    b = CL.birch(df, k)
    rows.append(("Birch", CL.silhouette(b)))
    g = CL.gmm(df, k, seed).transform(df)
    rows.append(("GaussianMixture", CL.silhouette(g)))
    best = max(rows, key=lambda t: t[1])[0]
    return df.sparkSession.createDataFrame([(a, s, a == best) for a, s in rows],
                                           "algorithm string, silhouette double, best boolean")


def stability_report(path: str, parts: dict[str, DataFrame]) -> DataFrame:
    """CL-26 / SNK-2: one nested JSON record -- each part an array of row structs --
    written with ``write.json``. Parts are small result tables (one row per cluster,
    feature or setting), so they are gathered on the driver."""
    from pyspark.sql.types import ArrayType, StructField, StructType
    spark = next(iter(parts.values())).sparkSession
    schema = StructType([StructField(n, ArrayType(p.schema)) for n, p in parts.items()])
    rec = spark.createDataFrame([tuple([tuple(r) for r in p.collect()] for p in parts.values())], schema)
    rec.coalesce(1).write.mode("overwrite").json(path)
    return rec
