"""Queries of the classification side (ML-*). Preparation, splits, folds, weights
and ANOVA scores have DuckDB oracles; fits and validation runs are rows-only
(checked by invariants in tests)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tankline.operators import linear_many as LM
from tankline.operators import mlp_many as MLP
from tankline.operators import models as M
from tankline.operators import trees_many as TM
from tankline.operators import validation as V
from tankline.plans.flag_queries import PRICED_SQL, flagged_sql, flagged_txn
from tankline.plans.registry import query
from tankline.sources import fixtures as FX
from tankline.sources import stages as SG
from tankline.sources.tables import table


# Floors at which the small check scale both keeps and lumps categories (the operator's
# defaults are the reference's).
FLOORS = {"district": 3000, "make": 600, "category": 3000}


def model_df(spark, sf):
    """The modelling table, written once to the checkpoint directory: splits,
    folds and every fit read it many times."""
    return M.model_frame(SG.stage(spark, sf, "flagged"), min_counts=FLOORS).checkpoint(eager=True)


def _rare_sql(col: str, out: str, n: int) -> str:
    return (f"CASE WHEN COUNT(*) OVER (PARTITION BY {col}) < {n} THEN 'Other' ELSE {col} END AS {out}")


MODEL_CTES = [PRICED_SQL, flagged_sql(), f"""
mf AS (SELECT txn_id, CAST(LEAST(number_of_flags, 2) AS DOUBLE) AS label,
              CASE WHEN fuel_type = 'Diesel' THEN coastal_diesel_cents ELSE coastal_petrol_cents END AS fuel_price,
              {_rare_sql("district", "district_new", FLOORS["district"])},
              {_rare_sql("site", "make_new", FLOORS["make"])},
              trim(CASE WHEN cn = 'MANAGED MAINTENANCE' THEN 'Other' ELSE cn END) AS cat_new
       FROM (SELECT *, {_rare_sql("category", "cn", FLOORS["category"])} FROM counted) x)"""]


def _msql(body: str, extra=()) -> str:
    return FX.with_views(body, "txn", "price", ctes=[*MODEL_CTES, *extra])


@query("model_features", covers=("ML-4", "ML-1", "ML-2", "PRJ-5", "PRJ-8", "FN-3", "AG-16"),
       sql=_msql("SELECT txn_id, label, fuel_price, district_new, make_new, cat_new FROM mf"))
def model_features(spark, sf):
    return model_df(spark, sf).select("txn_id", "label", "fuel_price", "district_new", "make_new", "cat_new")


def _hash_sql(seed: int) -> str:
    return f"md5(CAST(txn_id AS VARCHAR) || '|{seed}') || CAST(txn_id AS VARCHAR)"


@query("stratified_split", covers=("ML-5",), sql=_msql(f"""
SELECT txn_id, label, rk <= round(nc * 0.2) AS is_test
FROM (SELECT txn_id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {_hash_sql(1)}) AS rk,
             COUNT(*) OVER (PARTITION BY label) AS nc FROM mf) x"""))
def stratified_split(spark, sf):
    return M.stratified_split(model_df(spark, sf), "txn_id", seed=1).select("txn_id", "label", "is_test")


@query("stratified_folds", covers=("ML-6",), sql=_msql(f"""
SELECT txn_id, label, CAST((ROW_NUMBER() OVER (PARTITION BY label ORDER BY {_hash_sql(1)}) - 1) % 3 AS INTEGER) AS fold FROM mf"""))
def stratified_folds(spark, sf):
    return M.stratified_folds(model_df(spark, sf), "txn_id", 3, seed=1).select("txn_id", "label", "fold")


@query("class_weights", covers=("ML-8",), sql=_msql("""
SELECT label, CAST((SELECT COUNT(*) FROM mf) AS DOUBLE) / (CAST((SELECT COUNT(DISTINCT label) FROM mf) AS DOUBLE) * COUNT(*)) AS weight
FROM mf GROUP BY label"""))
def class_weights(spark, sf):
    return M.class_weights(model_df(spark, sf)).select("label", "weight").distinct()


@query("anova_f", covers=("ML-9",), sql=_msql(" UNION ALL ".join(f"""
SELECT '{f}' AS feature, ROUND((ssb / (k - 1)) / (ssw / (nn - k)), 6) AS f_value
FROM (SELECT SUM(g.n * (g.mc - t.m) * (g.mc - t.m)) AS ssb, MAX(t.k) AS k, MAX(t.nn) AS nn FROM g_{f} g, t_{f} t) b,
     (SELECT SUM((d.x - g.mc) * (d.x - g.mc)) AS ssw FROM d_{f} d JOIN g_{f} g USING (label)) w"""
                                                                  for f in M.NUMERICAL), extra=["""
mf2 AS (SELECT mf.label, c.amount_cents, c.litres, mf.fuel_price FROM mf JOIN counted c USING (txn_id))"""] + [
    c for f in M.NUMERICAL for c in (
        f"d_{f} AS (SELECT label, CAST({f} AS DOUBLE) AS x FROM mf2 WHERE {f} IS NOT NULL)",
        f"g_{f} AS (SELECT label, COUNT(x) AS n, SUM(x) / COUNT(x) AS mc FROM d_{f} GROUP BY label)",
        f"t_{f} AS (SELECT SUM(n * mc) / SUM(n) AS m, SUM(n) AS nn, COUNT(*) AS k FROM g_{f})")]))
def anova_f(spark, sf):
    return M.anova_f(model_df(spark, sf), M.NUMERICAL)


@query("tuning_subset", covers=("ML-7",), sql=_msql("""
SELECT txn_id FROM mf WHERE (SELECT COUNT(*) FROM mf) <= 5000 OR substr(md5(CAST(txn_id AS VARCHAR) || '|1'), 1, 8) <= '19999999'"""))
def tuning_subset(spark, sf):
    # the operator's default is the reference's 50,000 rows; here the sampling is to run
    return M.subset_for_tuning(model_df(spark, sf), "txn_id", above=5000).select("txn_id")


# ------------------------------------------------------------------ fits (rows-only)

FOREST = "random_forest"
ORDERED = (FOREST, "mlp")       # kinds whose fits go by the order and the partitions of the rows


def _rows(spark, sf, weighted=True):
    """The modelling table's columns that fits and validation runs read, written once."""
    d = M.model_frame(SG.stage(spark, sf, "flagged"), min_counts=FLOORS).select("txn_id", M.LABEL, *M.NUMERICAL, *M.CATEGORICAL)
    d = d.checkpoint(eager=True)
    return M.class_weights(d) if weighted else d


def _split(spark, sf, weighted=True, kind=None):
    """(training rows, test rows). Spark's forests draw their bootstraps by partition, so ``ORDERED`` kinds keep the table
    whose rows are sorted by their ranks, with all its columns: their models stay as they were."""
    if kind in ORDERED:
        d = model_df(spark, sf)
        s = M.stratified_split(M.class_weights(d) if weighted else d, "txn_id", seed=1, ranked=True).cache()
    else:
        s = M.stratified_split(_rows(spark, sf, weighted), "txn_id", seed=1).cache()
    return s.where(~F.col("is_test")), s.where(F.col("is_test"))


def _predict(kind, **params):
    def run(spark, sf):
        train, test = _split(spark, sf, weighted=kind != "mlp", kind=kind)
        model = M.fit(train, kind, **params)
        return model.transform(test).select("txn_id", "label", "prediction")
    return run


query("train_svm", covers=("ML-10", "ML-3", "ML-8", "ML-9", "UD-3"))(_predict("svm", select_k=15))
query("train_naive_bayes", covers=("ML-11",))(_predict("naive_bayes"))
query("train_gbt", covers=("ML-12",))(_predict("gbt"))
query("train_random_forest", covers=("ML-13",))(_predict("random_forest", numTrees=100, maxDepth=15, minInstancesPerNode=5))
query("train_mlp", covers=("ML-14",))(_predict("mlp"))
query("train_logistic", covers=("ML-15",))(_predict("logistic", elasticNetParam=0.5))


@query("grid_search", covers=("ML-16", "ML-6"))
def grid_search(spark, sf):
    train, _ = _split(spark, sf)
    n = train.count()
    # C of the reference's hinge-loss SVM in Spark's scale: regParam = 1 / (C * n)
    grid = {"regParam": [1.0 / (c * n) for c in (0.1, 0.5, 1.0, 5.0)]}
    _, trials = M.grid_search(train, "svm", grid, folds=3, metric="accuracy")
    return trials


# The reference's grids.
SGD_GRID = [LM.Setting(loss, alpha, penalty) for loss in LM.LOSSES for alpha in (1e-4, 1e-3) for penalty in ("l1", "l2", "elasticnet")]
CLASSES = (0, 1, 2)


def _binned(spark, sf, folds):
    train, _ = _split(spark, sf, weighted=False)
    return TM.binned(M.stratified_folds(train, "txn_id", folds, seed=1), M.NUMERICAL, M.CATEGORICAL, fold="fold")


def _trial_table(spark, settings, scores):
    """One row per setting, with its parameters and its mean score on the left-out folds."""
    import dataclasses
    rows = [dataclasses.asdict(x) for x in settings]
    names = [n for n in rows[0] if n not in ("seed", "leave_out")]
    kinds = {int: "long", float: "double", str: "string", bool: "boolean", tuple: "string"}
    kind = {n: next((kinds[type(r[n])] for r in rows if r[n] is not None), "string") for n in names}
    table = [(i, *[str(list(r[n])) if isinstance(r[n], tuple) else r[n] for n in names], v) for i, (r, v) in enumerate(zip(rows, scores))]
    return spark.createDataFrame(table, "candidate int, " + "".join(f"{n} {kind[n]}, " for n in names) + "mean_score double")


def _search(spark, sf, name):
    """The trials of a search, written once as a stage table: several queries report on them."""
    import hashlib
    import inspect
    source = "".join(inspect.getsource(m) for m in (TM, MLP, M))
    path = SG.named_path(spark, sf, f"search-{name}-{hashlib.sha1(source.encode()).hexdigest()[:12]}")
    return SG.written_once(spark, path, lambda: SEARCHES[name](spark, sf))


def _forest_search(spark, sf):
    d, cols = _binned(spark, sf, 5)
    draws = TM.forest_draws()
    return _trial_table(spark, draws, TM.cross_validate(d, cols, draws, 5, len(CLASSES)))


def _boosted_search(spark, sf):
    d, cols = _binned(spark, sf, 5)
    draws = TM.boost_draws()
    return _trial_table(spark, draws, TM.cross_validate(d, cols, draws, 5, len(CLASSES)))


def _mlp_search(spark, sf):
    train, _ = _split(spark, sf, weighted=False)
    d = M.stratified_folds(train, "txn_id", 5, seed=1)
    draws = MLP.net_draws()
    return _trial_table(spark, draws, MLP.cross_validate(MLP.narrow(_vectors(d).transform(d), fold="fold"), draws, 5, len(CLASSES)))


SEARCHES = {"forest": _forest_search, "boosted": _boosted_search, "mlp": _mlp_search}


@query("grid_search_forest", covers=("ML-16", "ML-13"))
def grid_search_forest(spark, sf):
    """The reference's 8 settings x 3 folds, side by side."""
    d, cols = _binned(spark, sf, 3)
    return _trial_table(spark, TM.forest_grid(), TM.cross_validate(d, cols, TM.forest_grid(), 3, len(CLASSES), "accuracy"))


@query("grid_search_boosted", covers=("ML-16", "ML-12"))
def grid_search_boosted(spark, sf):
    d, cols = _binned(spark, sf, 3)
    return _trial_table(spark, TM.boost_grid(), TM.cross_validate(d, cols, TM.boost_grid(), 3, len(CLASSES), "accuracy"))


@query("grid_search_mlp", covers=("ML-16", "ML-14"))
def grid_search_mlp(spark, sf):
    """The reference's 4 settings x 3 folds, side by side."""
    train, _ = _split(spark, sf, weighted=False)
    d = M.stratified_folds(train, "txn_id", 3, seed=1)
    x = MLP.narrow(_vectors(d).transform(d), fold="fold")
    return _trial_table(spark, MLP.net_grid(), MLP.cross_validate(x, MLP.net_grid(), 3, len(CLASSES), "accuracy"))


@query("train_boosted", covers=("ML-12",))
def train_boosted(spark, sf):
    """Softmax boosted trees (100 rounds of depth 6) on all training rows; predictions on the test rows."""
    train, test = _split(spark, sf, weighted=False)
    both = train.withColumn("part", F.lit(-1)).unionByName(test.withColumn("part", F.lit(0)))
    d, cols = TM.binned(both, M.NUMERICAL, M.CATEGORICAL, fold="part")
    return TM.predictions(d, cols, TM.Boost(leave_out=0), len(CLASSES)).where("f = 0").select(
        F.col("h").alias("row_hash"), F.col("y").alias("label"), "prediction")


def _vectors(df):
    from pyspark.ml import Pipeline
    return Pipeline(stages=M.preprocessing()).fit(df)


@query("grid_search_sgd", covers=("ML-16", "ML-15"))
def grid_search_sgd(spark, sf):
    """All 18 settings x 3 folds fitted side by side."""
    train, _ = _split(spark, sf)
    d = M.stratified_folds(train, "txn_id", 3, seed=1)
    return LM.cross_validate(_vectors(d).transform(d), SGD_GRID, 3, CLASSES)


@query("train_sgd", covers=("ML-15",))
def train_sgd(spark, sf):
    train, test = _split(spark, sf)
    prep = _vectors(train)
    x = prep.transform(test)
    out = x.select("txn_id", "label", "features")
    theta = LM.fit_many(LM.blocks(prep.transform(train)), [LM.Setting(loss) for loss in LM.LOSSES], CLASSES)
    for loss, t in zip(LM.LOSSES, theta):
        out = LM.predict(out, t, CLASSES).withColumnRenamed("prediction", loss)
    return out.drop("features")


@query("random_search", covers=("ML-17", "ML-18", "ML-13"))
def random_search(spark, sf):
    """50 forests drawn from the reference's ranges x 5 folds, side by side."""
    return _search(spark, sf, "forest")


@query("random_search_boosted", covers=("ML-17", "ML-12"))
def random_search_boosted(spark, sf):
    return _search(spark, sf, "boosted")


@query("random_search_mlp", covers=("ML-17", "ML-14"))
def random_search_mlp(spark, sf):
    return _search(spark, sf, "mlp")


@query("search_influence", covers=("ML-18", "FN-17"))
def search_influence(spark, sf):
    """Influence of the numeric parameters in the trials of the forest search."""
    t = _search(spark, sf, "forest")
    names = ["trees", "max_depth", "min_split", "min_leaf"]
    return M.parameter_influence(t.select(*[F.col(n).cast("double").alias(n) for n in names], "mean_score"), names)


@query("search_scores", covers=("ML-18",))
def search_scores(spark, sf):
    """Distribution of the mean scores in the trials of the forest search."""
    return M.score_distribution(_search(spark, sf, "forest"))


@query("random_search_linear", covers=("ML-17", "ML-15"))
def random_search_linear(spark, sf):
    train, _ = _split(spark, sf)
    space = {"regParam": (1e-5, 1e-1), "elasticNetParam": (0.0, 1.0)}
    _, trials = M.random_search(train, "logistic", space)
    return trials


TRIALS_CTE = """
tr AS (SELECT c_custkey % 3 AS depth, c_nationkey % 4 AS trees, c_acctbal AS mean_score FROM customer)"""


@query("parameter_influence", covers=("ML-18", "FN-17"), sql=f"""WITH {TRIALS_CTE},
lg AS (SELECT 'depth' AS param, CAST(depth AS DOUBLE) AS value, mean_score AS s FROM tr
       UNION ALL SELECT 'trees', CAST(trees AS DOUBLE), mean_score FROM tr),
ln AS (SELECT param, covar_pop(value, s) / NULLIF(var_pop(value), 0) AS slope FROM lg GROUP BY param)
SELECT lg.param, value, COUNT(*) AS n, ROUND(AVG(s), 9) AS mean_score, MAX(s) AS best_score, ROUND(MAX(slope), 9) AS slope
FROM lg JOIN ln ON ln.param = lg.param GROUP BY lg.param, value""")
def parameter_influence(spark, sf):
    """A given trials table (customers stand for trials, so that SQL can check it)."""
    t = table(spark, sf, "customer").select(
        (F.col("c_custkey") % 3).cast("double").alias("depth"), (F.col("c_nationkey") % 4).cast("double").alias("trees"),
        F.col("c_acctbal").cast("double").alias("mean_score"))
    return M.parameter_influence(t, ["depth", "trees"])


@query("score_distribution", covers=("ML-18",), sql="""
WITH t AS (SELECT CAST(c_acctbal AS DOUBLE) AS s FROM customer), mm AS (SELECT MIN(s) AS lo, MAX(s) AS hi FROM t)
SELECT b.bin, mm.lo + b.bin * ((mm.hi - mm.lo) / 20) AS lo,
       CASE WHEN b.bin = 19 THEN mm.hi ELSE mm.lo + (b.bin + 1) * ((mm.hi - mm.lo) / 20) END AS hi,
       CAST(COALESCE(c.n, 0) AS BIGINT) AS n, mm.hi AS best_score
FROM (SELECT CAST(range AS INTEGER) AS bin FROM range(20)) b CROSS JOIN mm
LEFT JOIN (SELECT LEAST(CAST(floor((s - mm.lo) / ((mm.hi - mm.lo) / 20)) AS INTEGER), 19) AS bin, COUNT(*) AS n
           FROM t CROSS JOIN mm GROUP BY 1) c ON c.bin = b.bin""")
def score_distribution(spark, sf):
    """The rule on a given table of scores, so that SQL can check it; search_scores has real trials."""
    return M.score_distribution(table(spark, sf, "customer").select(F.col("c_acctbal").cast("double").alias("mean_score")))


@query("impurity_importance", covers=("ML-24",))
def impurity_importance(spark, sf):
    train, _ = _split(spark, sf, kind=FOREST)
    model = M.fit(train, FOREST, numTrees=100, maxDepth=15)
    return M.impurity_importance(model, train, 20)


@query("permutation_importance", covers=("ML-25",))
def permutation_importance(spark, sf):
    train, test = _split(spark, sf)
    model = M.fit(train, "naive_bayes")
    return M.permutation_importance(model, test, [*M.NUMERICAL, *M.CATEGORICAL])


@query("stability_runs", covers=("ML-26", "AG-17"))
def stability_runs(spark, sf):
    runs = V.stability_runs(_rows(spark, sf), "naive_bayes", n_runs=10)
    from tankline.operators.profile import run_stats
    return run_stats(runs, [], ["accuracy", "macro_f1", "weighted_f1"])


@query("kfold", covers=("ML-27",))
def kfold(spark, sf):
    rows, confusion = V.kfold(M.class_weights(model_df(spark, sf)), "naive_bayes", k=5)
    return V.bundle_table({"folds": rows, "mean_confusion": confusion})


@query("learning_curve", covers=("ML-28",))
def learning_curve(spark, sf):
    return V.learning_summary(V.learning_curve(_rows(spark, sf), "naive_bayes"))


@query("robustness", covers=("ML-29", "ML-30", "ML-31", "D6"))
def robustness(spark, sf):
    return V.robustness(M.class_weights(model_df(spark, sf)), "logistic")


@query("model_comparison", covers=("ML-32",))
def model_comparison(spark, sf):
    kinds = {"naive_bayes": ("naive_bayes", {}), "logistic": ("logistic", {}),
             "random_forest": ("random_forest", {"numTrees": 100, "maxDepth": 15})}
    return V.compare_models(M.class_weights(model_df(spark, sf)), kinds)


@query("evaluation_bundle", covers=("ML-34", "ML-19", "ML-20", "ML-21", "ML-22", "ML-23"))
def evaluation_bundle(spark, sf):
    train, test = _split(spark, sf)
    b = V.evaluation_bundle(M.fit(train, "naive_bayes"), test)
    return V.bundle_table(b)


@query("model_roundtrip", covers=("SNK-5",))
def model_roundtrip(spark, sf):
    """Fit, save with Spark ML persistence, load, predict: equal predictions."""
    import uuid
    from pyspark.ml import PipelineModel
    from tankline.session import ensure_checkpoint_dir
    train, test = _split(spark, sf)
    model = M.fit(train, "naive_bayes")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex[:8]}"
    model.write().overwrite().save(path)
    loaded = PipelineModel.load(path)
    a = model.transform(test).select("txn_id", F.col("prediction").alias("p_fitted"))
    b = loaded.transform(test).select("txn_id", F.col("prediction").alias("p_loaded"))
    return a.join(b, "txn_id")
