"""No prefixes, caps or one-task steps: fits side by side, quantiles, storage."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.operators import cluster as CL
from tankline.operators import kmeans_many as KM
from tankline.operators import models as M
from tankline.operators import ranking as RK
from tankline.operators import stability as ST


def _points(spark, n=200, seed=1):
    rng = random.Random(seed)
    rows = [(i, rng.gauss(3 * (i % 3), 1), rng.gauss(2 * (i % 2), 1), i % 4) for i in range(n)]
    return rows, CL.standardize(spark.createDataFrame(rows, "id long, a double, b double, m int"), ["a", "b"])


def test_fits_side_by_side_are_lloyd_fixed_points(spark):
    rows, d = _points(spark)
    x = np.array([r["features"].toArray() for r in d.orderBy("id").collect()])
    w = F.array(F.lit(1), (F.col("id") % 3).cast("int"))
    fits = [KM.Fit(k, s, init) for k, s, init in itertools.product((1, 3), (1, 2), ("k-means++", "random"))]
    fits += [KM.Fit(2, 5, weight=1), KM.Fit(2, 5, group="2"), KM.Fit(2, 5, dims=(0,))]
    got = KM.fit_many(KM.narrow(d, weights=w, group=F.col("m")), fits, tol=0.0)
    for m in got:
        wt = np.ones(len(x)) if m.fit.weight is None else np.arange(len(x)) % 3
        wt = wt * (1 if m.fit.group is None else (np.arange(len(x)) % 4 == 2))
        y = x * m.mask
        dist = ((y[:, None] - m.centers[None]) ** 2).sum(axis=2)
        lab = dist.argmin(axis=1)
        assert len(m.centers) == m.fit.k and abs((dist.min(axis=1) * wt).sum() - m.cost) < 1e-6 * max(1, m.cost)
        for c in range(m.fit.k):  # every centre is the weighted mean of its rows
            sel = (lab == c) & (wt > 0)
            assert np.allclose(m.centers[c], np.average(y[sel], axis=0, weights=wt[sel]), atol=1e-6)
    again = KM.fit_many(KM.narrow(d, weights=w, group=F.col("m")), fits[:2], tol=0.0)
    assert all(np.allclose(a.centers, b.centers) for a, b in zip(got, again))
    lab = {r.id: r.l for r in d.select("id", KM.labels_of(got[:2], F.col("features")).alias("l")).collect()}
    assert all(len(v) == 2 for v in lab.values())


def test_one_row_and_fewer_rows_than_centres(spark):
    _, d = _points(spark, 2)
    m = CL.kmeans_best(d, 5, restarts=2)
    assert len(m.clusterCenters()) == 2 and m.cost < 1e-12


def test_bootstrap_weights_are_poisson_of_the_row(spark):
    d = spark.range(4000).select(ST.bootstrap_weights(3, "id", 1).alias("w"), "id")
    a = np.array([r.w for r in d.orderBy("id").collect()])
    b = np.array([r.w for r in d.repartition(5).orderBy("id").collect()])
    assert (a == b).all() and abs(a.mean() - 1) < 0.05 and abs(a.var() - 1) < 0.1


def test_feature_impact_and_temporal_stability(spark):
    rng = random.Random(2)
    rows = [(i, 8.0 * (i % 2) + rng.gauss(0, 1), rng.gauss(0, 1), f"2021-{1 + i % 5:02d}-03") for i in range(500)]
    d = CL.standardize(spark.createDataFrame(rows, "id long, a double, b double, ts string").withColumn("ts", F.to_timestamp("ts")), ["a", "b"])
    imp = {r.feature: r.impact for r in ST.feature_impact(d, 2, ["a", "b"], restarts=3).collect()}
    assert imp["a"] > 0.8 and imp["b"] < 0.1
    t = ST.temporal_stability(d, "ts", k=2, min_rows=50, restarts=3).orderBy("month").collect()
    assert [r.month for r in t] == ["2021-01", "2021-02", "2021-03", "2021-04"] and min(r.ari for r in t) > 0.9
    assert ST.temporal_stability(d, "ts", k=2, min_rows=1000).count() == 0


def test_ari_of_table_matches_the_query(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(3), rng.randrange(4)) for _ in range(300)]
    t = np.zeros((4, 4))
    for a, b in pairs:
        t[a, b] += 1
    assert abs(ST.ari_of_table(t) - ST.ari(spark.createDataFrame(pairs, "x int, y int"), "x", "y").first().ari) < 1e-12


def test_birch_keeps_its_threshold_with_thousands_of_cells(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, 20.0 * (i % 2) + rng.uniform(-4, 4), rng.uniform(-4, 4)) for i in range(6000)]
    d = CL.standardize(spark.createDataFrame(rows, "id long, truth int, a double, b double"), ["a", "b"])
    from pyspark.ml.functions import vector_to_array
    cells = d.select(F.transform(vector_to_array("features"), lambda v: F.floor(v / 0.02)).alias("c")).distinct().count()
    assert cells > 2001
    lab = CL.birch(d, 2, threshold=0.02)
    assert lab.count() == 6000 and ST.ari(lab, "truth", "prediction").first().ari == 1.0


def test_exact_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, None if rng.random() < 0.1 else float(rng.choice([1, 2, 2, 3, 50, -7]) * rng.randint(1, 30))) for g in "aaab" * 200]
    d = spark.createDataFrame(rows, "g string, x double")
    xs = [x for _, x in rows if x is not None]
    assert np.allclose(RK.exact_quantiles(d, "x", [0.0, 0.01, 0.5, 0.99, 1.0]), np.quantile(xs, [0, 0.01, 0.5, 0.99, 1]))
    for r in RK.exact_quantiles_by(d, "g", "x", [0.25, 0.5, 0.75]).collect():
        v = [x for g, x in rows if g == r.g and x is not None]
        assert r.n == len(v) and np.allclose(r.q, np.quantile(v, [0.25, 0.5, 0.75]))
    assert RK.exact_quantiles(d.limit(0), "x", [0.5]) is None


def _modelling_rows(spark, n):
    rng = random.Random(6)
    rows = [(i, float(i % 3), float(rng.randrange(100, 900)), float(rng.randrange(5, 50)), 100.0, "new" if i > 1500 else rng.choice("AB"),
             rng.choice("xy"), rng.choice(["Petrol", "Diesel"]), rng.choice("PQ")) for i in range(n)]
    return spark.createDataFrame(rows, "txn_id long, label double, amount_cents double, litres double, fuel_price double, "
                                       "district_new string, make_new string, fuel_type string, cat_new string")


def test_perceptron_width_covers_categories_beyond_the_first_rows(spark):
    d = _modelling_rows(spark, 2000).coalesce(1)
    model = M.fit(d, "mlp", maxIter=2)
    layers = model.stages[-1].getLayers()
    assert layers[0] == len(model.transform(d).first()["features"])
    assert model.transform(d).where("prediction is null").count() == 0


def test_macro_f1(spark):
    rng = random.Random(7)
    pairs = [(float(rng.choice([0, 0, 0, 1, 2])), float(rng.choice([0, 1, 1, 3]))) for _ in range(200)]
    classes = sorted({c for p in pairs for c in p})
    f1 = []
    for c in classes:
        tp = sum(y == c == p for y, p in pairs)
        both = sum(y == c for y, _ in pairs) + sum(p == c for _, p in pairs)
        f1.append(2 * tp / both if both else 0)
    assert abs(M.MacroF1().evaluate(spark.createDataFrame(pairs, "label double, prediction double")) - sum(f1) / len(f1)) < 1e-12


def test_stage_key_follows_the_files(spark, tmp_path):
    from tankline.sources.stages import _key
    spark.range(5).write.parquet(f"{tmp_path}/orders.parquet")
    one = _key(spark, str(tmp_path))
    assert one == _key(spark, str(tmp_path)) == _key(spark, f"{tmp_path}/") and one != _key(spark, f"{tmp_path}/none")
    spark.range(6).write.mode("append").parquet(f"{tmp_path}/orders.parquet")
    assert _key(spark, str(tmp_path)) != one


def test_a_cluster_without_a_shared_folder_is_an_error():
    from tankline.session import ensure_checkpoint_dir

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())


def test_a_replayed_epoch_changes_nothing(spark, tmp_path):
    from tankline.streaming.incremental import write_epoch
    d = spark.range(10)
    for epoch, part in ((0, d.where("id < 4")), (1, d.where("id >= 4")), (0, d.where("id < 4")), (1, d.where("id >= 4"))):
        write_epoch(part, epoch, f"{tmp_path}/t")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect()) == list(range(10))


def test_linear_losses_reach_the_minimum_of_their_objective(spark):
    from tankline.operators import linear_many as LM

    rng = np.random.default_rng(8)
    y = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 2)) + np.array([[2, 0], [-2, 0], [0, 2.5]])[y]
    d = spark.createDataFrame([(int(i), [float(v) for v in r], float(c), int(i) % 3) for i, (r, c) in enumerate(zip(x, y))],
                              "txn_id long, a array<double>, label double, fold int")
    from pyspark.ml.functions import array_to_vector
    d = d.withColumn("features", array_to_vector("a"))
    sets = [LM.Setting(loss, 1e-3, p) for loss in LM.LOSSES for p in ("l1", "l2", "elasticnet")]
    theta = LM.fit_many(LM.narrow(d), sets, (0, 1, 2))
    xs = np.hstack([x, np.ones((300, 1))])

    def objective(s, t, c):
        m = np.where(y == c, 1, -1) * (xs @ t)
        loss = {"hinge": np.maximum(0, 1 - m), "log_loss": np.log1p(np.exp(-m)),
                "modified_huber": np.where(m < -1, -4 * m, np.maximum(0, 1 - m) ** 2)}[s.loss].mean()
        l1 = {"l1": 1, "l2": 0, "elasticnet": LM.ELASTIC_L1}[s.penalty]
        return loss + s.alpha * (l1 * np.abs(t[:-1]).sum() + (1 - l1) * 0.5 * (t[:-1] ** 2).sum())

    for s, t in zip(sets, theta):
        for c in range(3):
            at = objective(s, t[c], c)
            near = min(objective(s, t[c] + rng.normal(scale=0.3, size=3), c) for _ in range(200))
            assert at <= near + 0.03, (s, c, at, near)
    p = LM.predict(d, theta[0], (0, 1, 2)).collect()
    assert np.mean([r.prediction == r.label for r in p]) > 0.85
    cv = LM.cross_validate(d, sets[:2], 3, (0, 1, 2)).collect()
    assert all(r.mean_score > 0.85 for r in cv)


def test_bootstrap_weights_are_those_of_the_hash_expression(spark):
    """Weights taken in arrays equal the expression over (key, replicate, seed), for missing keys too."""
    d = spark.range(500).select(F.when(F.col("id") % 50 > 0, F.col("id") * 7919 - 1000).alias("id"))
    want = [F.col("w")[r] == ST.poisson_weight(F.col("id"), F.lit(r), 5) for r in range(4)]
    got = d.select("id", ST.bootstrap_weights(4, "id", 5).alias("w")).select(*[x.alias(str(i)) for i, x in enumerate(want)]).collect()
    assert len(got) == 500 and all(all(r) for r in got)


def test_cooccurrence_counts_no_rows_per_replicate(spark, monkeypatch):
    """The sums come from one pass over the rows: no join and no row per replicate, and they are the joined form's."""
    _, d = _points(spark, 150)
    d = d.cache()
    first, reps = ST.bootstrap_fits(d, 3, 4, restarts=2)
    lab = d.select("id", KM.labels_of([first, *reps], F.col("features")).alias("l"), ST.bootstrap_weights(4).alias("w"))
    long = lab.select("id", F.posexplode(F.arrays_zip(F.slice("l", 2, 4).alias("label"), F.col("w").alias("w"))).alias("replicate", "z"))
    long = long.select("id", "replicate", F.col("z.label").alias("label"), F.col("z.w").cast("double").alias("w"))
    want = {r.base: (r.size, r.stability) for r in ST.cooccurrence_stability(lab.select("id", F.col("l")[0].alias("base")), long).collect()}
    monkeypatch.setattr(ST, "cooccurrence_stability", None)
    got = {r.base: (r.size, r.stability) for r in ST.bootstrap_cooccurrence(d, 3, 4, restarts=2).collect()}
    assert got == want and len(got) == 3


def test_draws_that_skip_rows_are_those_of_all_rows():
    """Seeding looks at the logarithm and the distance only where a row can win: the drawn rows are those of the plain race."""
    import pandas as pd

    rng = np.random.default_rng(3)
    x, h, w = rng.normal(size=(2000, 3)), rng.integers(0, 2**62, 2000), rng.poisson(1, (2000, 2)).astype(np.int8)
    blocks = [pd.DataFrame({"n": [len(p)], "x": [x[p].tobytes()], "h": [h[p].tobytes()], "w": [w[p].tobytes()], "kind": [w.dtype.str]})
              for p in np.array_split(np.arange(2000), 3)]

    class Data:
        columns = ["x"]

        def mapInPandas(self, run, schema):  # noqa: N802
            self.out = list(run(iter(blocks)))
            return self

        def groupBy(self, *a):  # noqa: N802
            return self

        def agg(self, *a):
            return self

        def collect(self):
            return [{"m": m, "a": a} for f in self.out for m, a in zip(f["m"], f["a"])]

    fits = [KM.Fit(3, s, init, weight=c) for s in range(4) for init in ("k-means++", "random") for c in (None, 0, 1)]
    models = [KM.Centers(f, np.zeros((0, 3)), mask=np.ones(3)) for f in fits]
    for step in range(3):
        want = []
        for m in models:
            p = KM._weight(m, 2000, w)
            if len(m.centers):
                dist = KM._assign(x, m)[1]
                p = p * (dist if m.fit.init == "k-means++" else dist > 1e-12)
            with np.errstate(divide="ignore"):
                want.append(x[np.where(p > 0, -np.log(KM._uniform(h.view(np.uint64), m.fit.seed * 1009 + step + 1)) / p, np.inf).argmin()])
        KM._seed_pass(Data(), models, step, 3)
        assert all(np.array_equal(m.centers[-1], v) for m, v in zip(models, want))
