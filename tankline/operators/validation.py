"""Model validation runs (ML-26..ML-32, ML-34): every run is a Spark ML fit, every
metric a DataFrame aggregation over predictions; only one metric row per run
reaches the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.operators import evaluation as EV
from tankline.operators import models as M
from tankline.operators.ranking import dense_rank_keys


def run_metrics(pred: DataFrame, pairs: DataFrame | None = None) -> dict:
    """accuracy, macro F1, weighted F1 and F1 per class of one prediction frame, which is read once
    (not at all if its ``pair_counts`` are given)."""
    rep = EV.class_report(EV.pair_counts(pred, M.LABEL, "prediction") if pairs is None else pairs, rows="n")
    rows = {r["label"]: r for r in rep.collect()}  # a handful of rows: one per class + 3
    out = {"accuracy": rows["accuracy"]["f1"], "macro_f1": rows["macro avg"]["f1"],
           "weighted_f1": rows["weighted avg"]["f1"]}
    for k, r in rows.items():
        if k not in ("accuracy", "macro avg", "weighted avg"):
            out[f"f1_class_{k}"] = r["f1"]
    return out


def _frame(spark, rows: list[dict]) -> DataFrame:
    keys = sorted({k for r in rows for k in r})
    return spark.createDataFrame([tuple(r.get(k) for k in keys) for r in rows], keys)


def stability_runs(df: DataFrame, kind: str, n_runs: int = 10, test_frac: float = 0.2, **params) -> DataFrame:
    """ML-26: repeated stratified splits with different seeds; one metric row per run
    (AG-17 gives mean and std)."""
    rows = []
    cuts = M.split_cuts(df, "txn_id", M.LABEL, test_frac, range(n_runs))
    if cuts is not None:  # the rows are kept once, with a mark per run
        d = df.where(F.col(M.LABEL).isNotNull()).select("*", *[M._is_test("txn_id", M.LABEL, i, c).alias(f"_t{i}") for i, c in enumerate(cuts)]).cache()
    for seed in range(n_runs):
        if cuts is None:
            s = M.stratified_split(df, "txn_id", test_frac=test_frac, seed=seed, ranked=True).cache()
        else:
            s = d.withColumn("is_test", F.col(f"_t{seed}")).drop(*[f"_t{i}" for i in range(n_runs)])
        model = M.fit(s.where(~F.col("is_test")), kind, seed=seed, **params)
        rows.append({"run": seed, **run_metrics(model.transform(s.where(F.col("is_test"))))})
        if cuts is None:
            s.unpersist()
    if cuts is not None:
        d.unpersist()
    return _frame(df.sparkSession, rows)


def kfold(df: DataFrame, kind: str, k: int = 5, seed: int = 1, **params) -> tuple[DataFrame, DataFrame]:
    """ML-27: stratified k-fold metrics per fold and the confusion matrix averaged
    over folds."""
    d = M.stratified_folds(df, "txn_id", k, seed=seed).cache()
    rows, confs = [], None
    for f in range(k):
        model = M.fit(d.where(F.col("fold") != f), kind, seed=seed, **params)
        pred = model.transform(d.where(F.col("fold") == f))
        pairs = EV.pair_counts(pred, M.LABEL, "prediction")
        rows.append({"fold": f, **run_metrics(pred, pairs)})
        c = EV.confusion(pairs, rows="n")
        confs = c if confs is None else confs.unionByName(c, allowMissingColumns=True)
    avg = confs.groupBy("y_true", "y_pred").agg((F.sum("n") / F.lit(float(k))).alias("mean_n"))
    return _frame(df.sparkSession, rows), avg


def learning_curve(df: DataFrame, kind: str, sizes: Sequence[float] = tuple(i / 10 for i in range(1, 11)), k: int = 5,
                   seed: int = 1, **params) -> DataFrame:
    """ML-28: for growing training fractions (nested hash-ordered prefixes of each
    training fold), train and test macro F1 per fold."""
    d = M.stratified_folds(df, "txn_id", k, seed=seed)
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.col("txn_id").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    d = d.withColumn("_u", h.cast("double") / F.lit(float(16 ** 8))).cache()

    def one(run):
        f, size = run
        tr = d.where((F.col("fold") != f) & (F.col("_u") < F.lit(size)))
        model = M.fit(tr, kind, seed=seed, **params)
        ev = M.MacroF1()
        return (f, float(size), tr.count(), ev.evaluate(model.transform(tr)), ev.evaluate(model.transform(d.where(F.col("fold") == f))))

    rows = M.parallel_map(one, [(f, s) for f in range(k) for s in sizes], 8)
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "fold int, train_fraction double, n_train long, train_macro_f1 double, test_macro_f1 double")


def learning_summary(curve: DataFrame) -> DataFrame:
    """ML-28: mean and population std over the folds, per training size."""
    return curve.groupBy("train_fraction").agg(
        F.avg("n_train").alias("mean_n_train"), *[f(c).alias(f"{n}_{c}") for c in ("train_macro_f1", "test_macro_f1")
                                                  for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def bundle_table(parts: dict[str, DataFrame]) -> DataFrame:
    """The tables of ``evaluation_bundle`` as one: (part, row as JSON), a row per row."""
    out = None
    for name, df in parts.items():
        rows = df.select(F.lit(name).alias("part"), F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("row"))
        out = rows if out is None else out.unionByName(rows)
    return out


def robustness(df: DataFrame, kind: str, levels: Sequence[float] = (0.05, 0.1, 0.2), seed: int = 1, **params) -> DataFrame:
    """ML-29..ML-31: metrics of a model (trained on clean training rows, with mean
    imputation so nulls are handled -- D6) on test rows perturbed by missing
    values, Gaussian noise and category swaps at each level; level 0 is the baseline."""
    # ranked: the draws of ``perturb`` go by the order of the rows
    s = M.stratified_split(df, "txn_id", seed=seed, ranked=True).cache()
    train, test = s.where(~F.col("is_test")), s.where(F.col("is_test"))
    stages = M.preprocessing(impute=True)
    from pyspark.ml import Pipeline
    est = M.estimator(kind, weight="weight" if "weight" in df.columns else None, seed=seed, **params)
    model = Pipeline(stages=[*stages, est]).fit(train)
    rows = [{"perturbation": "none", "level": 0.0, **run_metrics(model.transform(test))}]
    for kind_p in ("missing", "noise", "swap"):
        for lv in levels:
            rows.append({"perturbation": kind_p, "level": float(lv),
                         **run_metrics(model.transform(M.perturb(test, kind_p, lv, seed)))})
    return _frame(df.sparkSession, rows)


def compare_models(df: DataFrame, kinds: dict, seed: int = 1) -> DataFrame:
    """ML-32: one split, several model families, the same metric table."""
    s = M.stratified_split(df, "txn_id", seed=seed, ranked=True).cache()
    rows = []
    for name, (kind, params) in kinds.items():
        model = M.fit(s.where(~F.col("is_test")), kind, seed=seed, **params)
        rows.append({"model": name, **run_metrics(model.transform(s.where(F.col("is_test"))))})
    return _frame(df.sparkSession, rows)


def thinned(curve: DataFrame, points: int, order: str = "threshold") -> DataFrame:
    """About ``points`` rows of a curve, evenly spread over its rows in the given order; the first and
    the last are kept. Positions come from range partitions, so no task sorts the whole curve."""
    keyed = curve.withColumn("_k", F.struct(F.coalesce(order, F.lit(float("inf"))), F.xxhash64(*curve.columns)))
    rank = dense_rank_keys(keyed, "_k", "_r")
    n = rank.agg(F.max("_r").alias("n")).first()["n"] or 0
    step = max(1, n // max(1, points))
    wanted = rank.where(((F.col("_r") - 1) % step == 0) | (F.col("_r") == n))
    return keyed.join(F.broadcast(wanted), "_k").drop("_k", "_r")  # about ``points`` rows


def evaluation_bundle(model, test: DataFrame, points: int = 100) -> dict[str, DataFrame]:
    """ML-34: confusion, report, permutation importances, and per class ROC and precision-recall
    curves (``points`` of them, evenly spread over the curve's points, first and last included),
    AUC, average precision and calibration of one fitted model on test rows (scores from the
    probability vector); impurity importances of models that have them."""
    from pyspark.ml.functions import vector_to_array
    pred = model.transform(test)
    yp = pred.select(F.col(M.LABEL).cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                     *([vector_to_array("probability").alias("p")] if "probability" in pred.columns else [])).cache()  # every table reads it
    out = {"confusion": EV.confusion(yp), "report": EV.class_report(yp),
           "permutation_importance": M.permutation_importance(model, test, [*M.NUMERICAL, *M.CATEGORICAL])}
    if hasattr(model.stages[-1], "featureImportances"):
        out["impurity_importance"] = M.impurity_importance(model, test)
    if "probability" in pred.columns:
        aucs, aps, cals, rocs, prs = [], [], [], [], []
        for c in range(3):
            one = yp.select(F.col("y_true"), F.col("p")[c].alias("score"))
            aucs.append(EV.roc_auc(one, positive=c).withColumn("class", F.lit(c)))
            aps.append(EV.average_precision(one, positive=c).withColumn("class", F.lit(c)))
            rocs.append(thinned(EV.roc_points(one, positive=c), points).withColumn("class", F.lit(c)))
            prs.append(thinned(EV.pr_points(one, positive=c), points).withColumn("class", F.lit(c)))
            cals.append(EV.calibration(one, positive=c).withColumn("class", F.lit(c)))
        out["roc_auc"] = aucs[0].unionByName(aucs[1]).unionByName(aucs[2])
        out["average_precision"] = aps[0].unionByName(aps[1]).unionByName(aps[2])
        out["roc_curve"] = rocs[0].unionByName(rocs[1]).unionByName(rocs[2])
        out["pr_curve"] = prs[0].unionByName(prs[1]).unionByName(prs[2])
        out["calibration"] = cals[0].unionByName(cals[1]).unionByName(cals[2])
    return out
