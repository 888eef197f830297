"""The clustering-feature tree: sums, radii, partitions (CL-12)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tankline.operators import cf_tree as CF
from tankline.operators import cluster as CL
from tankline.operators import stability as ST


def rows(spark, n=3000, seed=4):
    rng = np.random.default_rng(seed)
    x = np.vstack([rng.normal(c, 0.6, (n // 3, 3)) for c in ((0, 0, 0), (6, 0, 3), (0, 8, -4))])
    return x, spark.createDataFrame([(i, i // (n // 3), [float(v) for v in r]) for i, r in enumerate(x)], "id long, truth int, features array<double>")


@pytest.mark.parametrize("parts,branching", [(1, 50), (9, 5), (20, 8)])
def test_features_add_up_and_radii_hold(spark, parts, branching):
    x, d = rows(spark)
    got, threshold = CF.subclusters(d, 0.5, branching, parts=parts)
    e = got.collect()
    n, total, square = np.array([r["n"] for r in e]), np.array([r["total"] for r in e]), np.array([r["square"] for r in e])
    assert threshold == 0.5 and n.sum() == len(x) and 10 < len(e) < len(x) / 2
    assert np.allclose(total.sum(axis=0), x.sum(axis=0)) and np.isclose(square.sum(), (x * x).sum())
    assert (CF.radius(n, total, square) <= 0.5 + 1e-9).all()
    other = np.array([np.array(r["total"]) / r["n"] for r in CF.subclusters(d, 0.5, 50, parts=3)[0].collect()])
    own = total / n[:, None]
    apart = np.sqrt(((own[:, None] - other[None]) ** 2).sum(axis=2)).min(axis=1)
    assert (apart[n > 5] <= 2 * 0.5).all()  # the stated bound


def test_tree_shape():
    rng = np.random.default_rng(1)
    t = CF.Tree(2, 0.01, 4)
    x = rng.uniform(0, 10, (500, 2))
    for r in x:
        t.insert(1.0, r, float(r @ r))
    stack, leaves = [t.root], 0
    while stack:
        node = stack.pop()
        assert node.size <= 4
        if node.children is None:
            leaves += node.size
        else:
            for i, c in enumerate(node.children):  # a parent's features are its child's
                assert all(np.allclose(a, b) for a, b in zip((node.n[i], node.total[i], node.square[i]), c.features()))
            stack += node.children
    assert leaves == len(t.entries()) and sum(e[0] for e in t.entries()) == 500


def test_too_many_entries_raise_the_threshold(spark):
    x, d = rows(spark, 600)
    got, threshold = CF.subclusters(d, 0.2, parts=2, max_entries=40)
    assert threshold > 0.2 and got.count() <= 40 and got.agg(F.sum("n")).first()[0] == 600


def test_birch_finds_the_clusters(spark):
    from pyspark.ml.functions import array_to_vector
    _, d = rows(spark)
    lab = CL.birch(d.withColumn("features", array_to_vector("features")), 3)
    assert ST.ari(lab, "truth", "prediction").first().ari > 0.95
