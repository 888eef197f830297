"""Trees, perceptrons and mixtures fitted side by side against plain computations."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.operators import cluster as CL
from tankline.operators import mixtures_many as MX
from tankline.operators import mlp_many as MLP
from tankline.operators import trees_many as TM


def raw_rows(spark, n=500, seed=2):
    rng = np.random.default_rng(seed)
    a, b, c = rng.normal(size=n), rng.integers(0, 40, n).astype(float), rng.choice(list("uvwx"), n)
    y = (a > 0.3).astype(int) + ((b > 25) & (c == "u"))
    rows = [(i, float(x) if i % 17 else None, float(v), str(k), int(l)) for i, (x, v, k, l) in enumerate(zip(a, b, c, y))]
    d = spark.createDataFrame(rows, "txn_id long, a double, b double, c string, label int")
    return d.withColumn("fold", (F.col("txn_id") % 3).cast("int")).repartition(4)


@pytest.fixture(scope="module")
def table(spark):
    data, cols = TM.binned(raw_rows(spark), ["a", "b"], ["c"], fold="fold", bins=8)
    return data.cache(), cols, TM.rows_of(data.orderBy("h").toPandas(), 3)


def test_bins(spark, table):
    data, cols, rows = table
    assert cols.ordered == (True, True, False) and cols.sizes[:2] == (8, 8) and len(rows) == 500
    assert all(0 <= v < s for x in rows.x for v, s in zip(x, cols.sizes))
    group, cell, column = cols.candidates()
    assert len(group) == 7 + 7 + cols.sizes[2] and column.max() + 1 == cols.columns == 2 + cols.sizes[2]


def best_by_hand(rows, cols, use, kind, stats):
    """(gain, group, cell) of the best first split by trying every one."""
    best = (-np.inf, None)
    for g, size in enumerate(cols.sizes):
        for cell in range(size - 1 if cols.ordered[g] else size):
            low = (rows.x[:, g] <= cell) if cols.ordered[g] else (rows.x[:, g] == cell)
            parts = [use & low, use & ~low]
            if kind == "boost":
                h = [stats[1][p].sum() for p in parts]
                if min(h) < 1:
                    continue
                gain = sum(stats[0][p].sum() ** 2 / (stats[1][p].sum() + 1) for p in parts) - stats[0][use].sum() ** 2 / (stats[1][use].sum() + 1)
            else:
                if min(p.sum() for p in parts) < 1:
                    continue
                sq = lambda p: sum(stats[p & (rows.y == c)].sum() ** 2 for c in range(3)) / stats[p].sum()
                gain = sum(map(sq, parts)) - sq(use)
            if gain > best[0] + 1e-9:
                best = (gain, (g, cell))
    return best


def test_first_splits_are_the_best_ones(table):
    _, cols, rows = table
    s = TM.Boost(rounds=1, leave_out=0)
    for c in range(3):
        stats = TM.boost_stats(rows, s, 0, np.zeros((500, 3)), c)
        tree = TM.boosted_tree(s, 0, c, 3)
        TM.grow_local(rows, cols, tree, stats)
        gain, split = best_by_hand(rows, cols, rows.f != 0, "boost", stats.values)
        assert (tree.group[0], tree.cell[0]) == split and np.isclose(tree.gain[0], gain)
        p = np.full(500, 1 / 3)
        g, h = p - (rows.y == c), 2 * p * (1 - p)
        leaf = tree.leaves(rows.x, np.array(cols.ordered))
        for node in np.unique(leaf):  # leaf weights from their own rows
            own = (leaf == node) & (rows.f != 0)
            assert np.isclose(tree.values(3)[node], -0.3 * g[own].sum() / (h[own].sum() + 1))
    wide = TM.Columns(cols.names, cols.sizes, cols.ordered)
    f = TM.Forest(1, max_depth=1)
    tree, w = TM.Tree(f, 0), TM.bootstrap(rows.h, 0)
    stats = TM.forest_stats(rows, tree, np.ones(3))
    hist = TM.histograms(rows.x, wide, np.zeros(500, int), tree.front, stats)
    assert np.allclose(hist[0, : wide.sizes[0]].sum(axis=0), [*(w[rows.y == c].sum() for c in range(3)), (w > 0).sum()])


def test_forest_rules(table):
    _, cols, rows = table
    for s in (TM.Forest(3, 4, 30, 1), TM.Forest(3, 20, 2, 12), TM.Forest(3, 20, 2, 1, "balanced"), TM.Forest(3, 20, 2, 1, "balanced_subsample", leave_out=1)):
        _, trees = TM.fit_local(rows, cols, s, 3, keep=True)
        for t in trees:
            w = TM.bootstrap(rows.h, t.number) * (rows.f != s.leave_out)
            leaf, depth = t.leaves(rows.x, np.array(cols.ordered)), 0
            n = np.bincount(leaf[w > 0], minlength=len(t.group))
            assert n[n > 0].min() >= s.min_leaf
            rows_of = n.copy()
            for node in range(len(t.group) - 1, -1, -1):
                if t.group[node] >= 0:
                    rows_of[node] = rows_of[t.left[node]] + rows_of[t.left[node] + 1]
                    assert rows_of[node] >= s.min_split
            depth = max(int(p).bit_length() - 1 for p in t.path)
            assert depth <= s.max_depth
            if s.weights == "balanced_subsample":  # classes weigh the same in the bootstrap
                root = t.stats[0][:3]
                per = np.array([(w[rows.y == c] > 0).sum() for c in range(3)])
                assert np.allclose(root[per > 0], root[per > 0][0])
    votes, _ = TM.fit_local(rows, cols, TM.Forest(30, leave_out=0), 3)
    assert np.allclose(votes.sum(axis=1), 1) and (votes.argmax(axis=1) == rows.y)[rows.f == 0].mean() > 0.9


def test_boosting_loss_falls(table):
    _, cols, rows = table
    last = np.inf
    for rounds in (1, 5, 20):
        margin, _ = TM.fit_local(rows, cols, TM.Boost(rounds, 3, 0.3, gamma=0.1), 3)
        loss = -np.log(TM.softmax(margin)[np.arange(500), rows.y]).mean()
        assert loss < last
        last = loss
    # one round, one split, by hand
    s = TM.Boost(1, 1, 0.5)
    margin, trees = TM.fit_local(rows, cols, s, 3, keep=True)
    t = trees[0]
    low = (rows.x[:, t.group[0]] <= t.cell[0]) if cols.ordered[t.group[0]] else (rows.x[:, t.group[0]] == t.cell[0])
    for side in (low, ~low):
        g, h = (1 / 3 - (rows.y[side] == 0)).sum(), side.sum() * 2 * (1 / 3) * (2 / 3)
        assert np.allclose(margin[side, 0], -0.5 * g / (h + 1))


def same(a, b):
    return all(np.array_equal(getattr(a, n), getattr(b, n)) for n in ("group", "cell", "left"))


def test_distributed_rows_give_the_same_trees(table):
    data, cols, rows = table
    shards = TM.Shards(data, cols, 3)
    settings = [TM.Forest(2, 5, 4, 2, leave_out=0), TM.Forest(2, 6, weights="balanced_subsample", leave_out=1)]
    for s, got in zip(settings, shards.forests(settings, wave=3)):
        assert all(same(a, b) for a, b in zip(got, TM.fit_local(rows, cols, s, 3, keep=True)[1]))
    boosts = [TM.Boost(2, 3, 0.3, 0.8, 0.7, 0.05, leave_out=0), TM.Boost(1, 2, 0.1, leave_out=2)]
    for s, got in zip(boosts, shards.boosted(boosts)):
        want = TM.fit_local(rows, cols, s, 3, keep=True)[1]
        assert len(got) == len(want) and all(same(a, b) for a, b in zip(got, want))


def test_search_tables_agree_either_way(table):
    data, cols, rows = table
    settings = [TM.Forest(2, 4, leave_out=0), TM.Boost(1, 2, leave_out=1)]
    local, spread = (TM.confusions(data, cols, settings, 3, local_rows=n) for n in (10_000, 10))
    assert np.array_equal(local, spread) and local[0].sum() == (rows.f == 0).sum()
    assert TM.macro_f1(np.array([[2, 0], [0, 3]])) == 1 and abs(TM.macro_f1(np.array([[1, 1], [0, 0]])) - 1 / 3) < 1e-12
    p = TM.predictions(data, cols, TM.Boost(20, 3), 3)
    assert p.where("prediction = y").count() > 0.9 * 500
    assert len(TM.forest_draws()) == len(TM.boost_draws()) == len(MLP.net_draws()) == 50 and len(TM.forest_grid()) == 8 and len(MLP.net_grid()) == 4


# ------------------------------------------------------------------ perceptrons

def net_rows(n=300, width=5, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width))
    return MLP.Rows(rng.integers(0, 2**63, n).astype(np.uint64), x, (x[:, 0] + x[:, 1] ** 2 > 1).astype(int) + (x[:, 2] > 1), rng.integers(0, 3, n))


def test_perceptron_gradient_is_numerical():
    r = net_rows(20)
    net = MLP.Net((4, 3), alpha=0.1)
    sizes = MLP.shapes(net, 5, 3)
    theta = MLP.initial(net, sizes)
    w = np.array([0.5, 1.0, 2.0])[r.y]
    _, g = MLP.loss_and_gradient(theta, sizes, r.x, r.y, w, net.alpha)
    for i in range(len(theta)):
        up, down = theta.copy(), theta.copy()
        up[i] += 1e-6
        down[i] -= 1e-6
        num = (MLP.loss_and_gradient(up, sizes, r.x, r.y, w, net.alpha)[0] - MLP.loss_and_gradient(down, sizes, r.x, r.y, w, net.alpha)[0]) / 2e-6
        assert abs(num - g[i]) < 1e-6


def test_perceptron_learns_and_stops():
    r = net_rows(1500)
    s = MLP.fit_local(r, MLP.Net((20,), 1e-4, 0.01, 200, leave_out=0), 3)
    own = r.f == 0
    assert (MLP.output(s.theta, MLP.shapes(MLP.Net((20,)), 5, 3), r.x[own]).argmax(axis=1) == r.y[own]).mean() > 0.85
    early = MLP.fit_local(r, MLP.Net((20,), 1e-4, 0.01, 400, early_stopping=True), 3)
    assert early.done and early.epoch < 400 and early.kept is not None
    few = MLP.fit_local(r, MLP.Net((20,), max_iter=3), 3)
    assert few.epoch == 3
    strong = MLP.fit_local(r, MLP.Net((20,), alpha=50.0, rate=0.01, max_iter=50), 3)
    assert np.abs(strong.theta).mean() < np.abs(s.theta).mean() / 2


def test_perceptrons_over_distributed_rows(spark):
    r = net_rows(400)
    d = spark.createDataFrame([(int(h.view(np.int64)), x.tolist(), int(y), int(f)) for h, x, y, f in zip(r.h, r.x, r.y, r.f)], "h long, x array<double>, y int, f int")
    nets = [MLP.Net((8,), rate=0.01, max_iter=4, leave_out=0), MLP.Net((8, 4), rate=0.01, max_iter=3, early_stopping=True, balanced=True)]
    one = d.repartition(1).cache()
    for a, b in zip(MLP.fit_shards(one, nets, 3), [MLP.fit_local(r, n, 3) for n in nets]):  # one shard: nothing to add up
        assert a.epoch == b.epoch
    assert np.allclose(MLP.fit_shards(one, nets[:1], 3)[0].theta, MLP.fit_local(r, nets[0], 3).theta)
    c = MLP.confusions(d.repartition(3), [MLP.Net((20,), rate=0.02, max_iter=30, leave_out=0)], 3, local_rows=10)
    assert c.sum() == (r.f == 0).sum() and TM.accuracy(c[0]) > 0.7


# ------------------------------------------------------------------ mixtures

def blobs(spark, seed=3):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(0, 1, (200, 2)) @ np.array([[1, 0.6], [0, 0.5]]), rng.normal([6, 0], 0.5, (150, 2)), rng.normal([0, 7], [2, 0.3], (100, 2))])
    return x, spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id long, a double, b double")


def plain_em(x, start, kind, steps):
    """Expectation maximisation as in a textbook, from hard labels."""
    k, d = start.max() + 1, x.shape[1]
    r = np.eye(k)[start]
    for step in range(steps + 1):
        n = r.sum(axis=0)
        mean = r.T @ x / n[:, None]
        cov = [((r[:, c, None] * (x - mean[c])).T @ (x - mean[c])) / n[c] + 1e-6 * np.eye(d) for c in range(k)]
        if kind == "diag":
            cov = [np.diag(np.diag(c)) for c in cov]
        if kind == "spherical":
            cov = [np.eye(d) * np.diag(c).mean() for c in cov]
        if kind == "tied":
            cov = [sum(n[c] * (cov[c] - 1e-6 * np.eye(d)) for c in range(k)) / n.sum() + 1e-6 * np.eye(d)] * k
        p = np.stack([n[c] / n.sum() * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - mean[c], np.linalg.inv(cov[c]), x - mean[c]))
                      / np.sqrt(np.linalg.det(2 * np.pi * cov[c])) for c in range(k)], axis=1)
        ll = np.log(p.sum(axis=1)).sum()
        r = p / p.sum(axis=1, keepdims=True)
    return ll, mean


def test_mixtures_equal_plain_em(spark):
    x, raw = blobs(spark)
    from pyspark.ml.functions import array_to_vector
    d = raw.withColumn("features", array_to_vector(F.array("a", "b"))).repartition(3)
    settings = [(3, kind) for kind in MX.COVARIANCES] + [(2, "diag")]
    models = MX.fit_many(d, settings)
    for (k, kind), m in zip(settings, models):
        start = CL.KM.fit_many(CL.KM.narrow(d), [CL.KM.Fit(k, 1)])[0]
        ll, mean = plain_em(x, CL.KM._assign(x, start)[0], kind, m.iterations)
        assert abs(ll - m.log_likelihood) < 1e-3 * abs(ll) and np.allclose(np.sort(mean, axis=0), np.sort(m.mean, axis=0), atol=0.05), kind
    labels = d.select("id", MX.labels_of(models, F.col("features"))[0].alias("l")).collect()
    truth = np.repeat([0, 1, 2], [200, 150, 100])
    for c in range(3):
        own = [r["l"] for r in labels if truth[r["id"]] == c]
        assert max(own.count(v) for v in set(own)) / len(own) > 0.95


def test_mixture_grid_has_all_settings(spark):
    _, raw = blobs(spark)
    g = CL.mixture_grid(CL.standardize(raw, ["a", "b"]), ks=(2, 3)).collect()
    assert {(r["n_components"], r["covariance_type"]) for r in g} == {(k, c) for k in (2, 3) for c in MX.COVARIANCES}
    assert all(r["silhouette"] is not None and np.isfinite(r["bic"]) for r in g)
    full = next(r for r in g if r["n_components"] == 3 and r["covariance_type"] == "full")
    assert np.isclose(full["aic"], 2 * 17 - 2 * full["log_likelihood"])


def test_passes_use_all_cores(spark):
    """A small table comes out of a shuffle as one partition; the passes over it are still spread, and
    sums of fits that share their steps are those of each fit alone."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    d = spark.range(0, 9000, 1, 1).select("id", array_to_vector(F.array(*[F.randn(i) for i in range(3)])).alias("features"))
    data = CL.KM.narrow(d, weights=F.array((F.col("id") % 3).cast("int"), F.lit(1)))
    assert data.rdd.getNumPartitions() >= min(spark.sparkContext.defaultParallelism, 4)
    rng = np.random.default_rng(2)
    fits = [CL.KM.Fit(k, s, weight=w, dims=x) for k in (1, 3, 4) for s in (1, 2) for w in (None, 0, 1) for x in (None, (0, 2))]
    models = [CL.KM.Centers(f, rng.normal(size=(f.k, 3)), mask=np.isin(np.arange(3), f.dims or (0, 1, 2)).astype(float)) for f in fits]
    rows = data.toPandas()
    x, w = np.stack(rows["a"]), np.stack(rows["w"])
    for i, got in CL.KM._lloyd_pass(data, models, list(range(len(models))), 3).items():
        m = models[i]
        best, dist = CL.KM._assign(x, m)
        p = np.ones(len(x)) if m.fit.weight is None else w[:, m.fit.weight].astype(float)
        want = [np.bincount(best, p, m.fit.k), *[np.bincount(best, p * x[:, j] * m.mask[j], m.fit.k) for j in range(3)], [p @ dist]]
        assert np.allclose(got, np.concatenate(want))


def test_many_small_partitions_are_joined(spark):
    """A shuffle without adaptive sizes leaves 200 partitions of a few rows: the passes don't keep them. Blocks
    hold every row with its hash and weights, those of a null group too."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    d = spark.range(0, 9000, 1, 200).select("id", array_to_vector(F.array(*[F.randn(i) for i in range(3)])).alias("features"))
    group = F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("string"))
    data = CL.KM.narrow(d, weights=F.array((F.col("id") % 3).cast("tinyint"), F.lit(1).cast("tinyint")), group=group)
    assert data.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    got = {}
    for x, h, w, g in CL.KM._blocks([CL.KM.packed(data, 3).toPandas()], 3):
        got |= {int(i): (*map(float, r), *map(int, p), g) for i, r, p in zip(h.view(np.int64), x, w)}
    assert got == {r.h: (*r.a, *r.w, r.g) for r in data.collect()} and len(got) == 9000


def test_linear_steps_are_those_of_all_rows(spark):
    """Blocks of one fold each: weights and accuracies equal plain steps over all rows, with 200 partitions as well."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tankline.operators import linear_many as LM

    d = spark.range(0, 4500, 1, 200).select("id", array_to_vector(F.array(F.randn(1), F.randn(2))).alias("features"), (F.col("id") % 3).cast("int").alias("label"),
                                            (F.col("id") % 2 + 1.0).alias("weight"), (F.col("id") % 5).cast("int").alias("fold")).checkpoint(eager=True)
    data = LM.narrow(d, fold="fold")
    assert data.rdd.getNumPartitions() <= 2 * spark.sparkContext.defaultParallelism
    rows = data.toPandas()
    x, y, w, f = np.stack(rows["x"]), rows["y"].to_numpy(), rows["w"].to_numpy(), rows["f"].to_numpy()
    sets = [LM.Setting(loss, 1e-3, "l2", k) for loss in LM.LOSSES for k in (None, 0, 3)]
    got = LM.fit_many(data, sets, (0, 1, 2), steps=1)
    top = np.linalg.eigvalsh((x * w[:, None]).T @ x / w.sum()).max()
    for s, t in zip(sets, got):
        use = np.where(f == s.leave_out, 0.0, w) if s.leave_out is not None else w
        step = 1 / (LM._curvature(s.loss) * top + s.alpha)
        for c in range(3):
            sign = np.where(y == c, 1.0, -1.0)
            v = -step * (LM.loss_slope(s.loss, np.zeros(len(x))) * sign * use) @ x / use.sum()
            assert np.allclose(t[c], np.append(v[:-1] / (1 + step * s.alpha), v[-1]))
    plain = [LM.Setting("hinge", 1e-3, "l2", k) for k in range(5)]
    theta = LM.fit_many(data, plain, (0, 1, 2))
    want = np.mean([((x[f == k] @ theta[k].T).argmax(axis=1) == y[f == k]).mean() for k in range(5)])
    assert np.isclose(LM.cross_validate(d, [LM.Setting("hinge", 1e-3, "l2")], 5, (0, 1, 2)).first()["mean_score"], want)


def test_blocks_hold_one_hot_columns_as_bits(spark):
    """A row of three numbers and 40 one-hot columns takes a few dozen bytes, not 8 per column, and comes back as it was."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import functions as F

    from tankline.operators import linear_many as LM

    hot = [(F.col("id") % 40 == i).cast("double") for i in range(40)]
    odd = F.when(F.col("id") % 11 == 0, F.lit(0.5)).when(F.col("id") % 13 == 0, F.lit(float("nan"))).otherwise(F.lit(1.0))
    d = spark.range(0, 9000, 1, 3).select("id", array_to_vector(F.array(F.randn(1), F.randn(2), odd, *hot)).alias("features"),
                                          (F.col("id") % 3).cast("int").alias("label"), (F.col("id") % 4).cast("int").alias("fold")).cache()
    p = LM.blocks(d, fold="fold").toPandas()
    assert sum(len(r[c]) for r in p.to_dict("records") for c in "kzxyw") < 60 * 9000
    got = sorted((str(list(c)), float(y), float(w), f) for x, ys, ws, f in LM._blocks([p]) for c, y, w in zip(x.T, ys, ws))
    want = sorted((str(list(np.append(r.features.toArray(), 1.0))), float(r.label), 1.0, r.fold) for r in d.collect())
    assert got == want


def test_shares_of_all_mixtures_at_once():
    """One step over tiles for all mixtures gives the sums and likelihoods of each mixture alone; narrow clusters too."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3)) * [1, 3, 1e-4]
    models = []
    for k in (1, 3):
        for kind in MX.COVARIANCES:
            lab = np.arange(700) % k
            models.append(MX.Mixture(k, kind, *MX.maximised(kind, MX.sums(x + lab[:, None], np.eye(k)[lab]), 3)))
    s, ll = MX.Densities(models).expect(x)
    for m, own, got in zip(models, s, ll):
        joint = m.log_joint(x)
        norm = MX.log_sum(joint)
        assert np.isclose(norm.sum(), got) and np.allclose(MX.sums(x, np.exp(joint - norm[:, None])), own)


def test_settings_of_a_family_share_their_trees(table, monkeypatch):
    """Forests that differ by trees or depth, and boosted ones that differ by rounds, grow once; votes, margins and trees
    are those of each alone, on wide levels too."""
    data, cols, rows = table
    settings = [TM.Forest(t, d, 2, m, "balanced", leave_out=0) for t in (2, 4) for d in (3, 6) for m in (1, 5)] + [TM.Boost(t, 3, 0.3, gamma=0.5, leave_out=1) for t in (1, 4)]
    alone = [TM.fit_local(rows, cols, s, 3, keep=True) for s in settings]
    grown = TM.families(settings)
    assert sum(s.trees if isinstance(s, TM.Forest) else 3 * s.rounds for s, _ in grown) == 4 + 4 + 12
    for nodes in (2048, 3):
        monkeypatch.setattr(TM, "NODES", nodes)
        for s, which in grown:
            scores, trees = TM.fit_family(rows, cols, s, [settings[i] for i in which], 3, keep=True)
            for i, score in zip(which, scores):
                own = TM.member(trees, settings[i], 3)
                assert np.array_equal(score, alone[i][0]) and len(own) == len(alone[i][1])
                assert all(same(a, b) and np.array_equal(a.values(3), b.values(3)) for a, b in zip(own, alone[i][1]))
    monkeypatch.setattr(TM, "NODES", 2048)
    local, spread = (TM.confusions(data, cols, settings[:5], 3, local_rows=n) for n in (10_000, 10))
    assert np.array_equal(local, spread)
    c = [np.bincount(rows.y[rows.f == 0] * 3 + alone[i][0][rows.f == 0].argmax(axis=1), minlength=9).reshape(3, 3) for i in range(5)]
    assert np.array_equal(local, c)
