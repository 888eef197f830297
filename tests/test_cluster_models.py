"""Clustering and model invariants on planted fixtures (CL-1, CL-5, CL-6, CL-9,
CL-12, CL-13, CL-14, CL-19, ML-5, ML-6, ML-8, SNK-5)."""

import os
import random
import tempfile

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tankline.operators import cluster as CL
from tankline.operators import models as M
from tankline.operators import stability as ST


def _blobs(spark, k=3, n=150, seed=0):
    rnd = np.random.default_rng(seed)
    centres = [np.array([10.0 * i, -7.0 * i, 3.0 * (i % 2)]) for i in range(k)]
    rows = []
    for c in range(k):
        for _ in range(n):
            x = centres[c] + rnd.normal(0, 0.5, 3)
            rows.append((len(rows), c, float(x[0]), float(x[1]), float(x[2]), 1.0))  # constant last feature
    df = spark.createDataFrame(rows, "id long, truth int, a double, b double, c double, const double")
    return CL.standardize(df, ["a", "b", "c", "const"]).cache()


def test_standardize_population_std(spark):
    d = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, k double")
    r = CL.standardize(d, ["x", "k"], keep_columns=True).collect()
    assert [x.z_x for x in r] == [-1.0, 1.0] and [x.z_k for x in r] == [0.0, 0.0]


def test_kmeans_recovers_planted_and_wcss_monotone(spark):
    d = _blobs(spark)
    p = CL.kmeans_best(d, 3, restarts=2).transform(d)
    assert ST.ari(p, "truth", "prediction").first().ari > 0.95
    w = [r.wcss for r in CL.elbow(d, range(1, 6), restarts=2).orderBy("k").collect()]
    assert all(a >= b - 1e-6 for a, b in zip(w, w[1:]))


def test_ari_properties(spark):
    rnd = random.Random(0)
    rows = [(rnd.randrange(3), rnd.randrange(4)) for _ in range(200)]
    df = spark.createDataFrame(rows, "x int, y int")
    assert ST.ari(df, "x", "x").first().ari == 1.0
    assert abs(ST.ari(df, "x", "y").first().ari - ST.ari(df, "y", "x").first().ari) < 1e-12


def test_ward_birch_gmm_on_blobs(spark):
    d = _blobs(spark, k=3)
    lab, merges = CL.hierarchical(d, n_clusters=3, micro=30)
    assert ST.ari(lab, "truth", "prediction").first().ari > 0.95
    assert merges.count() == 29
    b = CL.birch(d, 3, threshold=0.5)
    assert ST.ari(b, "truth", "prediction").first().ari > 0.95
    g = CL.gmm(d, 3).transform(d)
    assert ST.ari(g, "truth", "prediction").first().ari > 0.95
    pi, mu, covs, ll = CL.em_mixture(d, 3, "diag")
    assert abs(sum(pi) - 1) < 1e-9 and np.isfinite(ll)


def test_cooccurrence_singleton_and_identity(spark):
    base = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, base int")
    reps = spark.createDataFrame([(1, 0, 5, 1.0), (2, 0, 5, 1.0), (3, 0, 6, 1.0)],
                                 "id int, replicate int, label int, w double")
    got = {r.base: r.stability for r in ST.cooccurrence_stability(base, reps).collect()}
    assert got == {0: 1.0, 1: 1.0}


def _model_frame(spark, n=600):
    rnd = random.Random(4)
    rows = []
    for i in range(n):
        lab = rnd.choice([0, 0, 0, 1, 2, 3])
        rows.append((i, lab, float(rnd.randrange(100, 900) + 400 * lab), float(rnd.randrange(5, 50)),
                     rnd.choice([100.0, None]), rnd.choice(["D1", "D2"]), rnd.choice(["m1", "m2", "m3"]),
                     rnd.choice(["Petrol", "Diesel"]), rnd.choice(["C1", "C2", " MANAGED MAINTENANCE "])))
    df = spark.createDataFrame(rows, "txn_id long, number_of_flags int, amount_cents double, litres double, "
                                     "coastal_diesel_cents double, district string, site string, fuel_type string, "
                                     "category string")
    df = df.withColumn("coastal_petrol_cents", F.col("coastal_diesel_cents"))
    return M.model_frame(df, min_counts={"district": 10, "make": 10, "category": 10})


def test_split_folds_weights(spark):
    d = _model_frame(spark)
    s = M.stratified_split(d, "txn_id", seed=3)
    per = {r.label: (r.n, r.t) for r in s.groupBy("label").agg(F.count("*").alias("n"),
                                                               F.sum(F.col("is_test").cast("int")).alias("t")).collect()}
    assert all(t == round(n * 0.2 + 1e-9) or abs(t - n * 0.2) <= 0.5 for n, t in per.values())
    f = M.stratified_folds(d, "txn_id", 3, seed=3)
    sizes = f.groupBy("label", "fold").count().collect()
    for lab in per:
        c = [r["count"] for r in sizes if r.label == lab]
        assert max(c) - min(c) <= 1
    w = {r.label: r.weight for r in M.class_weights(d).select("label", "weight").distinct().collect()}
    n = d.count()
    assert abs(sum(w[k] * per[k][0] for k in w) - n) < 1e-6


def test_fit_save_load_same_predictions(spark):
    d = M.class_weights(_model_frame(spark))
    model = M.fit(d, "logistic")
    path = tempfile.mkdtemp(prefix="tankline-model-", dir="/tmp")
    model.write().overwrite().save(os.path.join(path, "m"))
    loaded = PipelineModel.load(os.path.join(path, "m"))
    a = [r.prediction for r in model.transform(d).orderBy("txn_id").collect()]
    b = [r.prediction for r in loaded.transform(d).orderBy("txn_id").collect()]
    assert a == b


def test_perturb_level_zero_is_identity(spark):
    d = _model_frame(spark, 100)
    for kind in ("missing", "noise", "swap"):
        p = M.perturb(d, kind, 0.0, seed=1)
        assert p.exceptAll(d).count() == 0


def test_forest_keeps_each_rows_node(spark):
    from pyspark.ml import Pipeline
    d = M.class_weights(_model_frame(spark))
    x = Pipeline(stages=M.preprocessing()).fit(d).transform(d).cache()
    est = M.estimator("random_forest", weight="weight", numTrees=5, maxDepth=6)
    assert est.getCacheNodeIds()
    walked = est.copy({est.cacheNodeIds: False})
    assert est.fit(x).toDebugString.split("\n")[1:] == walked.fit(x).toDebugString.split("\n")[1:]


def test_run_metrics_reads_predictions_once(spark):
    from tankline.operators import evaluation as EV
    from tankline.operators import validation as V
    pairs = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 1.0), (2.0, 0.0), (2.0, 2.0), (None, 1.0)]
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(len(b))
            yield b

    pred = spark.createDataFrame(pairs, "label double, prediction double")
    got = V.run_metrics(pred.mapInPandas(run, pred.schema))
    assert seen.value == len(pairs)
    ints = pred.selectExpr("cast(label as int) as y_true", "cast(prediction as int) as y_pred")
    rep = {r["label"]: r["f1"] for r in EV.class_report(ints).collect()}
    assert got["accuracy"] == rep["accuracy"] and got["macro_f1"] == rep["macro avg"] and got["f1_class_2"] == rep["2"]
    assert sorted(EV.confusion(EV.pair_counts(ints), rows="n").collect()) == sorted(EV.confusion(ints).collect())
