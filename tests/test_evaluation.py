"""Evaluation tables on edge_report fixtures (ML-19..ML-23)."""

import pytest

from tankline.operators import evaluation as EV


def test_report_class_never_predicted(spark):
    rows = [(0, 0), (0, 0), (1, 0), (2, 2), (2, 0)]
    df = spark.createDataFrame(rows, "y_true int, y_pred int")
    rep = {r.label: r for r in EV.class_report(df).collect()}
    assert rep["1"].precision == 0.0 and rep["1"].recall == 0.0 and rep["1"].f1 == 0.0
    assert abs(rep["accuracy"].f1 - 3 / 5) < 1e-12
    conf = EV.confusion(df).collect()
    assert len(conf) == 9 and sum(r.n for r in conf) == 5


def test_auc_perfect_and_ties(spark):
    perfect = spark.createDataFrame([(0, 0.1), (0, 0.2), (1, 0.8), (1, 0.9)], "y_true int, score double")
    assert EV.roc_auc(perfect).first().auc == 1.0
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)], "y_true int, score double")
    assert EV.roc_auc(tied).first().auc == 0.5
    assert EV.average_precision(perfect).first().ap == 1.0


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 0.1), (1, 0.30000000000000004), (0, 0.3), (1, 1.0)],
                               "y_true int, score double")
    got = {r.bin: r.n for r in EV.calibration(df).collect()}
    # 0.1 sits on an inner edge -> lower bin; 0.3 < 0.30000000000000004 (numpy's edge) -> bin 2
    assert got == {0: 2, 2: 2, 9: 1}


@pytest.mark.parametrize("name", ["random_search", "random_search_linear", "grid_search_forest"])
def test_searches_fit_all_training_rows(spark, monkeypatch, name):
    from tankline.plans import model_queries as Q

    seen = []
    monkeypatch.setattr(Q, "_split", lambda *a: (spark.range(6000).withColumnRenamed("id", "txn_id"), None))
    for f in ("random_search", "grid_search"):
        monkeypatch.setattr(Q.M, f, lambda train, kind, space: (None, seen.append((train.count(), space))))
    getattr(Q, name)(spark, None)
    assert seen[0][0] == 6000
    if name == "random_search":
        assert seen[0][1]["numTrees"] == (50, 299) and seen[0][1]["maxDepth"] == (10, 30)


def test_permutation_importance_orders_the_rows_once_per_repeat(spark, monkeypatch):
    """One order of the rows per repeat serves all columns, and the drops are those of shuffling each alone."""
    import numpy as np
    from pyspark.sql import functions as F

    from tankline.operators import models as M

    class Model:
        def transform(self, df):
            return df.withColumn("prediction", ((F.col("a") + F.col("b")) % 3).cast("double"))

    d = spark.range(0, 300, 1, 3).select(F.col("id").alias("txn_id"), (F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"),
                                         (((F.col("id") % 5) + (F.col("id") % 7)) % 3).cast("double").alias("label"))
    calls, rank = [], M.rank_within_group
    monkeypatch.setattr(M, "rank_within_group", lambda *a, **k: calls.append(a) or rank(*a, **k))
    got = {r.feature: r for r in M.permutation_importance(Model(), d, ["a", "b"], repeats=3).collect()}
    assert len(calls) == 1 + 3
    for f in ("a", "b"):
        drops = [1.0 - M.evaluator("accuracy").evaluate(Model().transform(M.permute_column(d, f, "txn_id", 1 + r))) for r in range(3)]
        assert np.isclose(got[f].importance_mean, np.mean(drops)) and np.isclose(got[f].importance_std, np.std(drops))


def test_permutation_importance_runs_the_model_once_per_repeat(spark):
    from pyspark.sql import functions as F

    from tankline.operators import models as M

    calls = []

    class Model:
        def transform(self, df):
            calls.append(1)
            return df.withColumn("prediction", ((F.col("a") + F.col("b")) % 3).cast("double"))

    d = spark.range(0, 300, 1, 3).select(F.col("id").alias("txn_id"), (F.col("id") % 5).alias("a"), (F.col("id") % 7).alias("b"),
                                         (((F.col("id") % 5) + (F.col("id") % 7)) % 3).cast("double").alias("label"))
    for metric in ("macro_f1", "f1"):  # counted, and by Spark's evaluator
        calls.clear()
        got = {r.feature: r for r in M.permutation_importance(Model(), d, ["a", "b"], repeats=2, metric=metric).collect()}
        assert len(calls) == 1 + 2
        for f in ("a", "b"):
            drops = [1.0 - M.evaluator(metric).evaluate(Model().transform(M.permute_column(d, f, "txn_id", 1 + r))) for r in range(2)]
            assert abs(got[f].importance_mean - sum(drops) / 2) < 1e-9


@pytest.mark.parametrize("digits,few", [(3, 20_000), (1, 5)])
def test_split_by_cuts_is_the_ranked_one(spark, monkeypatch, digits, few):
    """No row is sorted or written for a split, unless hashes don't tell the rows apart."""
    from pyspark.sql import functions as F

    from tankline.operators import models as M

    monkeypatch.setattr(M, "CUT_DIGITS", digits)
    monkeypatch.setattr(M, "CUT_ROWS", few)
    ranked, rank = [], M.rank_within_group
    monkeypatch.setattr(M, "rank_within_group", lambda *a, **k: ranked.append(a) or rank(*a, **k))
    d = spark.range(0, 1003, 1, 4).select(F.col("id").alias("txn_id"), F.when(F.col("id") < 2, 2.0).when(F.col("id") % 19 > 0, F.col("id") % 2).cast("double").alias("label"))
    for seed in (1, 2):
        got = {(r.txn_id, r.is_test) for r in M.stratified_split(d, "txn_id", seed=seed).collect()}
        assert not ranked
        assert got == {(r.txn_id, r.is_test) for r in M.stratified_split(d, "txn_id", seed=seed, ranked=True).collect()} and len(ranked) == 1
        ranked.clear()
    for odd in (d.unionAll(d).unionAll(d), d.withColumn("txn_id", F.when(F.col("txn_id") > 5, F.col("txn_id")))):
        n = {r.label: r["count"] for r in odd.where("label is not null").groupBy("label").count().collect()}
        for frac in (0.2, 0.201):
            got = M.stratified_split(odd, "txn_id", test_frac=frac, seed=1).where("is_test").groupBy("label").count().collect()
            assert {r.label: r["count"] for r in got} == {k: int(v * frac + 0.5) for k, v in n.items() if int(v * frac + 0.5)}


def test_stability_runs_write_no_copy_of_the_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from tankline.operators import models as M
    from tankline.operators import validation as V

    d = spark.range(0, 600, 1, 3).select(
        F.col("id").alias("txn_id"), (F.col("id") % 3).cast("double").alias("label"), (F.col("id") % 3 * 5 + F.rand(1)).alias("amount_cents"),
        F.rand(2).alias("litres"), F.rand(3).alias("fuel_price"), *[(F.col("id") % k).cast("string").alias(c) for k, c in zip((2, 4, 5, 7), M.CATEGORICAL)]).cache()
    want = {}
    for seed in range(2):
        s = M.stratified_split(d, "txn_id", seed=seed, ranked=True)
        model = M.fit(s.where("not is_test"), "naive_bayes", seed=seed)
        want[seed] = V.run_metrics(model.transform(s.where("is_test")))["accuracy"]
    monkeypatch.setattr(M, "rank_within_group", None)
    got = {r.run: r.accuracy for r in V.stability_runs(d, "naive_bayes", n_runs=2).collect()}
    assert got == want
