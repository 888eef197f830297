"""Classification of the flag count (ML-1..ML-18, ML-24..ML-32, ML-34) with
``pyspark.ml``.

Data preparation, splits, folds, weights and feature scores are DataFrame
jobs; model fitting is ``Pipeline.fit`` (distributed by Spark ML), model
selection is ``CrossValidator`` over an explicit fold column with
``parallelism`` for concurrent candidate fits.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression, MultilayerPerceptronClassifier,
                                       NaiveBayes, OneVsRest, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, UnivariateFeatureSelector, VectorAssembler
from pyspark.ml.param.shared import HasInputCols, HasOutputCol, Param, Params
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.operators.cluster import parallel_map
from tankline.operators.joins import attach
from tankline.operators.ranking import rank_within_group
from tankline.operators.summaries import histogram
from tankline.schema import DEFAULT, TxnCols

LABEL = "label"
FEATURES = "features"

# Rare-category floors of the reference (district, make, category).
MIN_COUNTS = {"district": 10000, "make": 10000, "category": 5000}
OTHER = "Other"


# ------------------------------------------------------------- preparation

def rare_grouping(df: DataFrame, col: str, out: str, min_count: int) -> DataFrame:
    """ML-2: categories with fewer than ``min_count`` rows become 'Other' (AG-16 +
    a join of the per-category counts, one row per category)."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    j = attach(df, counts, col, "left")
    return j.withColumn(out, F.when(F.col("_cnt") < min_count, F.lit(OTHER)).otherwise(F.col(col))).drop("_cnt")


def model_frame(flagged: DataFrame, c: TxnCols = DEFAULT, make_col: str | None = None,
                min_counts: dict | None = None) -> DataFrame:
    """ML-4: label = flag count with 3 -> 2 (ML-1); fuel price by fuel type (PRJ-5);
    rare-category grouping of district, make and category (ML-2); the category value
    'MANAGED MAINTENANCE' to 'Other' (PRJ-8) and trimmed (FN-3)."""
    mc = {**MIN_COUNTS, **(min_counts or {})}
    make_col = make_col or c.site
    d = flagged.withColumn(LABEL, F.least(F.col("number_of_flags"), F.lit(2)).cast("double"))
    d = d.withColumn("fuel_price", F.when(F.col(c.fuel) == "Diesel", F.col(c.coastal_diesel))
                     .otherwise(F.col(c.coastal_petrol)))
    d = rare_grouping(d, c.district, "district_new", mc["district"])
    d = rare_grouping(d, make_col, "make_new", mc["make"])
    d = rare_grouping(d, c.category, "cat_new", mc["category"])
    d = d.withColumn("cat_new", F.trim(F.when(F.col("cat_new") == "MANAGED MAINTENANCE", F.lit(OTHER))
                                       .otherwise(F.col("cat_new"))))
    return d


CATEGORICAL = ["district_new", "make_new", "fuel_type", "cat_new"]
NUMERICAL = ["amount_cents", "litres", "fuel_price"]


# ------------------------------------------------------------- splits and weights

def _hash_order(key: str, seed: int):
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


CUT_DIGITS = 3          # hex digits of a hash by which the rows of a class are counted at once
CUT_ROWS = 20_000       # hashes of a class that are gathered at most to find the last one of a test part


def _split_hash(key: str, seed: int):
    return F.concat(_hash_order(key, seed), F.col(key).cast("string"))


def split_cuts(df: DataFrame, key: str, label: str, test_frac: float, seeds: Sequence[int]) -> list[dict] | None:
    """Per seed: the hash of the last test row of every class ("" where it has none), so that a split neither
    sorts nor writes the rows. Rows are counted by the first digits of their hashes, then by the next ones
    where the last test row lies, until few are left there. None if hashes don't tell the rows apart: a
    missing key, or equal keys on both sides of a cut."""
    h = F.array(*[_split_hash(key, s) for s in seeds])
    sizes = df.where(F.col(label).isNotNull()).groupBy(label).agg(
        F.count(F.lit(1)).alias("n"), F.count(key).alias("known")).withColumn("k", F.round(F.col("n") * F.lit(test_frac))).collect()  # classes
    if any(r["known"] < r["n"] or r[label] != r[label] for r in sizes):
        return None
    cuts: list[dict] = [{} for _ in seeds]
    want = []  # (seed number, class, known digits, rank of the last test row among those that begin with them, rows there)
    for i, _ in enumerate(seeds):
        for r in sizes:
            if r["k"] < 1:
                cuts[i][r[label]] = ""
            else:
                want.append((i, r[label], "", min(int(r["k"]), r["n"]), r["n"]))
    long = df.where(F.col(label).isNotNull()).select(F.col(label).alias("c"), F.posexplode(h).alias("i", "h"))
    depth = 0
    while want:
        few = max(w[4] for w in want) <= CUT_ROWS
        at = df.sparkSession.createDataFrame([(w[0], w[1], w[2]) for w in want], ["i", "c", "p"]).select(
            F.col("i").cast("int").alias("i"), F.col("c").cast(df.schema[label].dataType).alias("c"), "p")
        some = long.withColumn("p", F.substring("h", 1, depth)).join(F.broadcast(at), ["i", "c", "p"], "left_semi")  # seeds x classes rows
        if few:
            got: dict = {}
            for r in some.select("i", "c", "h").collect():  # at most CUT_ROWS per seed and class
                got.setdefault((r["i"], r["c"]), []).append(r["h"])
            for i, c, _, k, _ in want:
                hs = sorted(got[i, c])
                if k < len(hs) and hs[k] == hs[k - 1]:
                    return None
                cuts[i][c] = hs[k - 1]
            return cuts
        depth += CUT_DIGITS
        if depth > 32:
            return None  # as many rows of one key
        counts: dict = {}
        for r in some.groupBy("i", "c", F.substring("h", 1, depth).alias("p")).count().collect():  # 16 ** CUT_DIGITS per seed and class
            counts.setdefault((r["i"], r["c"]), []).append((r["p"], r["count"]))
        nxt = []
        for i, c, _, k, _ in want:
            for p, n in sorted(counts[i, c]):
                if k <= n:
                    nxt.append((i, c, p, k, n))
                    break
                k -= n
        want = nxt
    return cuts


def _is_test(key: str, label: str, seed: int, cuts: dict):
    out = F.lit(False)
    for c, last in cuts.items():
        if last:
            out = F.when(F.col(label) == F.lit(c), _split_hash(key, seed) <= F.lit(last)).otherwise(out)
    return out


def stratified_split(df: DataFrame, key: str, label: str = LABEL, test_frac: float = 0.2, seed: int = 1,
                     out: str = "is_test", ranked: bool = False) -> DataFrame:
    """ML-5: exact per-class split: within each class, rows ordered by a seeded
    hash of the key; the first round(test_frac * n_class) are test rows. The hash of
    the last of them decides (``split_cuts``); ``ranked``, or rows that their hashes don't tell
    apart: distributed ranks (no per-class window), the rows sorted by class and hash."""
    cuts = None if ranked else split_cuts(df, key, label, test_frac, [seed])
    if cuts is not None:
        return df.where(F.col(label).isNotNull()).withColumn(out, _is_test(key, label, seed, cuts[0]))
    d = df.withColumn("_h", _split_hash(key, seed))
    n = d.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    r = rank_within_group(d, label, "_h", "_rk")
    r = r.join(F.broadcast(n), label)  # one row per class
    return r.withColumn(out, F.col("_rk") <= F.round(F.col("_nc") * F.lit(test_frac))).drop("_h", "_rk", "_nc")


def stratified_folds(df: DataFrame, key: str, k: int, label: str = LABEL, seed: int = 1, out: str = "fold") -> DataFrame:
    """ML-6: fold = (rank in class - 1) mod k, rank by a seeded hash: fold sizes per
    class differ by at most one."""
    d = df.withColumn("_h", F.concat(_hash_order(key, seed), F.col(key).cast("string")))
    r = rank_within_group(d, label, "_h", "_rk")
    return r.withColumn(out, ((F.col("_rk") - 1) % k).cast("int")).drop("_h", "_rk")


def class_weights(df: DataFrame, label: str = LABEL, out: str = "weight") -> DataFrame:
    """ML-8: balanced weights n / (k * n_class) joined to the rows."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    tot = df.count()
    k = n.count()
    w = n.select(label, (F.lit(float(tot)) / (F.lit(float(k)) * F.col("_nc"))).alias(out))
    return df.join(F.broadcast(w), label)  # one row per class


def subset_for_tuning(df: DataFrame, key: str, frac: float = 0.1, above: int = 50000, seed: int = 1) -> DataFrame:
    """ML-7: tune on a repeatable hash-chosen fraction when the frame is large."""
    if df.count() <= above:
        return df
    h = F.conv(F.substring(_hash_order(key, seed), 1, 8), 16, 10).cast("double") / F.lit(float(16 ** 8))
    return df.where(h < F.lit(frac))


def anova_f(df: DataFrame, features: Sequence[str], label: str = LABEL) -> DataFrame:
    """ML-9: one-way ANOVA F statistic of each numeric feature against the class.
    Two passes for numerical stability: per-class count and mean (one row per
    class), then between- and within-class sums of squares around those means."""
    rows = []
    for f in features:
        d = df.where(F.col(f).isNotNull()).select(label, F.col(f).cast("double").alias("x"))
        g = d.groupBy(label).agg(F.count("x").alias("n"), (F.sum("x") / F.count("x")).alias("mc"))
        tot = g.agg((F.sum(F.col("n") * F.col("mc")) / F.sum("n")).alias("m"), F.sum("n").alias("N"),
                    F.count(F.lit(1)).alias("K")).first()  # three scalars
        m, N, K = tot["m"], tot["N"], tot["K"]
        ssb = g.agg(F.sum(F.col("n") * (F.col("mc") - F.lit(m)) * (F.col("mc") - F.lit(m))).alias("ssb"))
        ssw = d.join(F.broadcast(g), label).agg(  # one row per class
            F.sum((F.col("x") - F.col("mc")) * (F.col("x") - F.col("mc"))).alias("ssw"))
        # reported to 6 decimals: the last digits depend on summation order
        fstat = F.round((F.col("ssb") / F.lit(float(K - 1))) / (F.col("ssw") / F.lit(float(N - K))), 6)
        both = ssb.select("ssb", F.lit(None).cast("double").alias("ssw")).unionByName(
            ssw.select(F.lit(None).cast("double").alias("ssb"), "ssw")).agg(F.max("ssb").alias("ssb"), F.max("ssw").alias("ssw"))
        rows.append(both.select(F.lit(f).alias("feature"), fstat.alias("f_value")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


# ------------------------------------------------------------- custom stages

class PopulationScaler(Estimator, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """UD-3 / CL-1: centre and scale numeric columns by mean and population std
    (a constant column scales to 0), then assemble them into one vector."""

    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol or "scaled")

    def _fit(self, df: DataFrame) -> PopulationScalerModel:
        cols = self.getInputCols()
        aggs = []
        for c in cols:
            aggs += [F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}")]
        r = df.agg(*aggs).first()  # 2 scalars per column
        model = PopulationScalerModel(inputCols=cols, outputCol=self.getOutputCol())
        model._set(means=[float(r[f"m_{c}"] or 0.0) for c in cols], stds=[float(r[f"s_{c}"] or 0.0) for c in cols])
        return model


class PopulationScalerModel(Model, HasInputCols, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "column means")
    stds = Param(Params._dummy(), "stds", "column population standard deviations")

    def __init__(self, inputCols=None, outputCol=None):
        super().__init__()
        self._set(inputCols=inputCols or [], outputCol=outputCol or "scaled")

    def _transform(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector
        cols, means, stds = self.getInputCols(), self.getOrDefault("means"), self.getOrDefault("stds")
        parts = [F.lit(0.0) if s == 0 else (F.col(c).cast("double") - F.lit(m)) / F.lit(s)
                 for c, m, s in zip(cols, means, stds)]
        return df.withColumn(self.getOutputCol(), array_to_vector(F.array(*parts)))


def preprocessing(categorical: Sequence[str] = CATEGORICAL, numerical: Sequence[str] = NUMERICAL,
                  impute: bool = True) -> list:
    """ML-3: population-std scaling of numeric columns, one-hot of categorical ones
    (unknown values ignored: ``handleInvalid='keep'`` gives them their own slot),
    assembled into ``features``. Mean imputation of numeric nulls first (D6; a
    transaction without litres or without a price row has nulls)."""
    stages: list = []
    num = list(numerical)
    if impute:
        stages.append(Imputer(inputCols=num, outputCols=[f"{c}_imp" for c in num], strategy="mean"))
        num = [f"{c}_imp" for c in num]
    stages.append(PopulationScaler(inputCols=num, outputCol="num_vec"))
    idx = [f"{c}_idx" for c in categorical]
    stages.append(StringIndexer(inputCols=list(categorical), outputCols=idx, handleInvalid="keep",
                                stringOrderType="alphabetAsc"))
    stages.append(OneHotEncoder(inputCols=idx, outputCols=[f"{c}_oh" for c in categorical], dropLast=False,
                                handleInvalid="keep"))
    stages.append(VectorAssembler(inputCols=["num_vec", *[f"{c}_oh" for c in categorical]], outputCol=FEATURES))
    return stages


def with_selector(k: int = 15) -> UnivariateFeatureSelector:
    """ML-9 stage: keep the k features with the best ANOVA F score."""
    sel = UnivariateFeatureSelector(featuresCol=FEATURES, outputCol="selected", labelCol=LABEL,
                                    selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return sel


# ------------------------------------------------------------- estimators

def estimator(kind: str, features: str = FEATURES, weight: str | None = "weight", seed: int = 1, **params):
    """ML-10..ML-15 classifiers. Spark's perceptron takes no weights and has no L2
    term; boosted trees and the SVM are one-vs-rest."""
    common = dict(featuresCol=features, labelCol=LABEL)
    if kind == "svm":
        base = LinearSVC(featuresCol=features, labelCol=LABEL, regParam=params.get("regParam", 0.1),
                         maxIter=params.get("maxIter", 25),
                         **({"weightCol": weight} if weight else {}))
        return OneVsRest(classifier=base, featuresCol=features, labelCol=LABEL, **({"weightCol": weight} if weight else {}))
    if kind == "naive_bayes":
        return NaiveBayes(modelType="gaussian", **common, **({"weightCol": weight} if weight else {}))
    if kind == "gbt":
        base = GBTClassifier(featuresCol=features, labelCol=LABEL, maxIter=params.get("maxIter", 20),
                             maxDepth=params.get("maxDepth", 5), seed=seed)
        return OneVsRest(classifier=base, featuresCol=features, labelCol=LABEL)
    if kind == "random_forest":
        # a row's node is kept from level to level: without it every level walks all trees from their roots
        return RandomForestClassifier(numTrees=params.get("numTrees", 100), maxDepth=params.get("maxDepth", 15),
                                      minInstancesPerNode=params.get("minInstancesPerNode", 5), seed=seed, cacheNodeIds=True, **common,
                                      **({"weightCol": weight} if weight else {}))
    if kind == "mlp":
        return MultilayerPerceptronClassifier(layers=params["layers"], maxIter=params.get("maxIter", 200), seed=seed,
                                              **common)
    if kind == "logistic":
        return LogisticRegression(regParam=params.get("regParam", 0.0001),
                                  elasticNetParam=params.get("elasticNetParam", 0.0), maxIter=100, **common,
                                  **({"weightCol": weight} if weight else {}))
    raise ValueError(kind)


def fit(train: DataFrame, kind: str, select_k: int | None = None, seed: int = 1, **params) -> PipelineModel:
    """Preprocess (+ optional ANOVA selection), then the classifier. The preprocessing is
    fitted once on all training rows; the perceptron's input width is that of its vectors."""
    stages = preprocessing()
    feats = FEATURES
    if select_k:
        stages.append(with_selector(select_k))
        feats = "selected"
    prep = Pipeline(stages=stages).fit(train)
    x = prep.transform(train)
    if kind == "mlp" and "layers" not in params:
        params["layers"] = [vector_width(x, feats), 100, 50, 3]
    model = estimator(kind, feats, weight="weight" if "weight" in train.columns else None, seed=seed, **params).fit(x)
    return PipelineModel(stages=[*prep.stages, model])


def vector_width(df: DataFrame, col: str) -> int:
    """Slots of a vector column: its metadata, or else the one width of all its rows."""
    meta = df.schema[col].metadata.get("ml_attr", {})
    if "num_attrs" in meta:
        return int(meta["num_attrs"])
    if "attrs" in meta:
        return sum(len(v) for v in meta["attrs"].values())
    from pyspark.ml.functions import vector_to_array
    return int(df.agg(F.max(F.size(vector_to_array(col)))).first()[0])


def pair_counts(pred: DataFrame, *by: str) -> dict:
    """{(class, prediction): rows} of predictions, or {values of ``by``: such counts}."""
    out: dict = {}
    for r in pred.groupBy(*by, LABEL, "prediction").count().collect():  # classes squared, per group
        (out.setdefault(tuple(r[: len(by)]), {}) if by else out)[r[len(by)], r[len(by) + 1]] = r["count"]
    return out


def score_of(n: dict, metric: str) -> float:
    """Accuracy, or the unweighted mean of the per-class F1 (classes seen as label or prediction), from pair counts."""
    if metric == "accuracy":
        return sum(v for (y, p), v in n.items() if y == p) / sum(n.values()) if n else 0.0
    if metric != "macro_f1":
        raise ValueError(metric)
    classes = sorted({c for pair in n for c in pair})
    total = 0.0
    for c in classes:
        hit = n.get((c, c), 0)
        both = sum(v for (y, _), v in n.items() if y == c) + sum(v for (_, p), v in n.items() if p == c)
        total += 2 * hit / both if both else 0.0
    return total / max(1, len(classes))


class MacroF1(Evaluator):
    """Unweighted mean of the per-class F1 (classes seen as label or prediction)."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return score_of(pair_counts(dataset), "macro_f1")

    def isLargerBetter(self) -> bool:  # noqa: N802  as pyspark.ml names it
        return True


def evaluator(metric: str) -> Evaluator:
    return MacroF1() if metric == "macro_f1" else MulticlassClassificationEvaluator(labelCol=LABEL, metricName=metric)


def accuracy_f1(pred: DataFrame) -> dict:
    ev = MulticlassClassificationEvaluator(labelCol=LABEL, predictionCol="prediction")
    return {"accuracy": ev.setMetricName("accuracy").evaluate(pred), "f1_weighted": ev.setMetricName("f1").evaluate(pred)}


# ------------------------------------------------------------- model selection

def grid_search(train: DataFrame, kind: str, grid: dict, folds: int = 3, seed: int = 1, parallelism: int = 8,
                metric: str = "accuracy") -> tuple[PipelineModel, DataFrame]:
    """ML-16: ``CrossValidator`` over the grid with stratified folds (ML-6) as
    ``foldCol``; returns the refit best pipeline (D15: refit on all rows) and a
    table of mean metric per candidate."""
    est = estimator(kind, weight="weight" if "weight" in train.columns else None, seed=seed)
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(inner.getParam(name), values)
    maps = b.build()
    if isinstance(est, OneVsRest):
        maps = [{est.classifier: inner.copy(m)} for m in maps]
    return _cross_validate(train, est, maps, folds, seed, parallelism, metric)


def random_search(train: DataFrame, kind: str, space: dict, n_iter: int = 50, folds: int = 5, seed: int = 1,
                  parallelism: int = 8, metric: str = "macro_f1") -> tuple[PipelineModel, DataFrame]:
    """ML-17: seeded draws from the space (lists are sampled uniformly, (lo, hi)
    int/float tuples uniformly in range) evaluated by ``CrossValidator``."""
    rng = random.Random(seed)
    est = estimator(kind, weight="weight" if "weight" in train.columns else None, seed=seed)
    inner = est.getClassifier() if isinstance(est, OneVsRest) else est
    maps = []
    for _ in range(n_iter):
        m = {}
        for name, dom in space.items():
            if isinstance(dom, list):
                v = rng.choice(dom)
            elif isinstance(dom[0], int):
                v = rng.randint(dom[0], dom[1])
            else:
                v = rng.uniform(dom[0], dom[1])
            m[inner.getParam(name)] = v
        maps.append(m)
    if isinstance(est, OneVsRest):
        maps = [{est.classifier: inner.copy(m)} for m in maps]
    return _cross_validate(train, est, maps, folds, seed, parallelism, metric)


def _cross_validate(train, est, maps, folds, seed, parallelism, metric):
    d = stratified_folds(train, "txn_id", folds, seed=seed)
    prep = Pipeline(stages=preprocessing()).fit(d)
    x = prep.transform(d).select("txn_id", LABEL, FEATURES, "fold", *(["weight"] if "weight" in d.columns else []))
    cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=evaluator(metric), foldCol="fold", numFolds=folds,
                        parallelism=parallelism, seed=seed)
    cvm = cv.fit(x)
    spark = train.sparkSession

    def settings(m) -> dict:
        out = {}
        for p, v in m.items():
            out.update({q.name: v.getOrDefault(q) for q in v.params if v.isSet(q)} if p.name == "classifier" else {p.name: v})
        return out

    each = [settings(m) for m in maps]
    names = sorted({k for s in each for k in s if len({str(o.get(k)) for o in each}) > 1} or {k for s in each for k in s})
    kinds = {n: "double" if all(isinstance(s.get(n), (int, float)) for s in each) else "string" for n in names}
    rows = [(i, *[float(s[n]) if kinds[n] == "double" else str(s.get(n)) for n in names], float(v))
            for i, (s, v) in enumerate(zip(each, cvm.avgMetrics))]
    trials = spark.createDataFrame(rows, "candidate int, " + "".join(f"`{n}` {kinds[n]}, " for n in names) + "mean_score double")
    best = PipelineModel(stages=[*prep.stages, cvm.bestModel])
    return best, trials


def parameter_influence(trials: DataFrame, params: Sequence[str], score: str = "mean_score") -> DataFrame:
    """ML-18: per parameter value the number of trials and their mean and best score, with the
    slope of the linear trend of the score over the parameter (null where it doesn't vary)."""
    long = trials.unpivot([score], list(params), "param", "value")
    line = long.groupBy("param").agg((F.covar_pop("value", score) / F.nullif(F.var_pop("value"), F.lit(0.0))).alias("slope"))
    per = long.groupBy("param", "value").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.max(score).alias("best_score"))
    return attach(per, line, "param", "inner").select(
        "param", "value", "n", F.round("mean_score", 9).alias("mean_score"), "best_score", F.round("slope", 9).alias("slope"))


def score_distribution(trials: DataFrame, score: str = "mean_score", bins: int = 20) -> DataFrame:
    """ML-18: histogram of the trials' scores (SM-3), each bin with the best score."""
    best = trials.agg(F.max(F.col(score).cast("double")).alias("best")).first()["best"]
    return histogram(trials, score, bins).withColumn("best_score", F.lit(best).cast("double"))


# ------------------------------------------------------------- diagnostics

def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the assembled feature slots from the vector metadata."""
    out = model.transform(df.limit(1))
    meta = out.schema[FEATURES].metadata.get("ml_attr", {}).get("attrs", {})
    slots = []
    for kind in meta.values():
        slots += kind
    slots.sort(key=lambda a: a["idx"])
    return [a.get("name", str(a["idx"])) for a in slots]


def impurity_importance(model: PipelineModel, df: DataFrame, top: int = 20) -> DataFrame:
    """ML-24: impurity importances of a tree model with feature names, top n."""
    names = feature_names(PipelineModel(stages=model.stages[:-1]), df)
    imp = model.stages[-1].featureImportances.toArray().tolist()
    rows = sorted(zip(names, imp), key=lambda t: (-t[1], t[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def permute_column(df: DataFrame, col: str, key: str, seed: int) -> DataFrame:
    """Shuffle one column across rows: the value of the row ranked i by a seeded
    hash moves to the row ranked i by key (distributed ranks)."""
    one = F.lit(1)
    a = rank_within_group(df.withColumn("_g", one), "_g", key, "_ra")
    vals = df.select(F.col(col).alias("_v"), F.concat(_hash_order(key, seed), F.col(key).cast("string")).alias("_h"))
    b = rank_within_group(vals.withColumn("_g", one), "_g", "_h", "_ra")
    return a.join(b.select("_ra", "_v"), "_ra").withColumn(col, F.col("_v")).drop("_ra", "_v", "_g", "_h")


def permutation_importance(model: PipelineModel, test: DataFrame, features: Sequence[str], repeats: int = 10,
                           seed: int = 1, metric: str = "accuracy") -> DataFrame:
    """ML-25: drop in the metric when one input column is shuffled, mean and std
    over repeats. Rows are ranked by their key once, and a repeat moves all columns in one
    join (its order of the rows is the same for each) and counts their predictions in one job."""
    features = list(features)
    counted = metric in ("accuracy", "macro_f1")
    base = evaluator(metric).evaluate(model.transform(test))
    ranked = rank_within_group(test.withColumn("_g", F.lit(1)), "_g", "txn_id", "_ra").persist()
    which = range(len(features))

    def run(r: int) -> dict:
        values = ranked.select(*[F.col(f).alias(f"_v{i}") for i, f in enumerate(features)],
                               F.concat(_hash_order("txn_id", seed + r), F.col("txn_id").cast("string")).alias("_h"))
        order = rank_within_group(values.withColumn("_g", F.lit(1)), "_g", "_h", "_ra")
        moved = ranked.join(order.select("_ra", *[f"_v{i}" for i in which]), "_ra").drop("_ra", "_g")
        # every row once per column, with that column's value moved: one run of the model serves all
        each = moved.withColumn("_f", F.explode(F.array(*[F.lit(i) for i in which])))
        for i, f in enumerate(features):
            each = each.withColumn(f, F.when(F.col("_f") == i, F.col(f"_v{i}")).otherwise(F.col(f)))
        pred = model.transform(each.drop(*[f"_v{i}" for i in which]))
        pairs = pair_counts(pred, "_f") if counted else {}
        return {(f, r): base - (score_of(pairs.get((i,), {}), metric) if counted else evaluator(metric).evaluate(pred.where(F.col("_f") == i)))
                for i, f in enumerate(features)}

    got = {k: v for one in parallel_map(run, range(repeats), 4) for k, v in one.items()}
    ranked.unpersist()
    rows = []
    for f in features:
        drops = [got[f, r] for r in range(repeats)]
        m = sum(drops) / len(drops)
        sd = (sum((x - m) ** 2 for x in drops) / len(drops)) ** 0.5
        rows.append((f, m, sd))
    rows.sort(key=lambda t: -t[1])
    return test.sparkSession.createDataFrame(rows, "feature string, importance_mean double, importance_std double")


def perturb(df: DataFrame, kind: str, level: float, seed: int, numerical=NUMERICAL, categorical=CATEGORICAL) -> DataFrame:
    """ML-29..ML-31: missing values (numeric set to null with probability level),
    Gaussian noise (x + N(0,1) * level * sample std) or category swap (value
    replaced by another observed value with probability level)."""
    out = df
    if kind == "missing":
        for i, c in enumerate(numerical):
            out = out.withColumn(c, F.when(F.rand(seed + i) < level, F.lit(None)).otherwise(F.col(c)))
    elif kind == "noise":
        sds = df.agg(*[F.stddev_samp(c).alias(c) for c in numerical]).first()
        for i, c in enumerate(numerical):
            out = out.withColumn(c, F.col(c) + F.randn(seed + i) * F.lit(level * float(sds[c] or 0.0)))
    elif kind == "swap":
        for i, c in enumerate(categorical):
            vals = [r[0] for r in df.select(c).distinct().orderBy(c).collect() if r[0] is not None]  # bounded domain
            if len(vals) < 2:
                continue
            arr = F.array(*[F.lit(v) for v in vals])
            pos = F.array_position(arr, F.col(c)).cast("int")  # 1-based
            shift = (F.floor(F.rand(seed + 100 + i) * (len(vals) - 1)) + 1).cast("int")
            other = F.element_at(arr, ((pos - 1 + shift) % len(vals)) + 1)
            out = out.withColumn(c, F.when((F.rand(seed + i) < level) & (pos > 0), other).otherwise(F.col(c)))
    return out
