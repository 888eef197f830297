"""Connected components of an edge table, for name groups (PP-3) and density clusters (CL-15).

Hooking and shortcutting on contracted edges. In every round each remaining vertex points to
its neighbour that comes first in an order drawn anew (a hash of vertex and round), if that
one comes before itself; every vertex is then replaced by its ancestor four steps up, and the
edges by the distinct edges between ancestors and those from an ancestor to its own parent.
A vertex with an edge comes after one of its neighbours with a chance of a half at least, so
half of the vertices are expected to go per round. Once at most ``FINISH`` edges are left (they are
counted), one task joins them by union-find, which saves the last rounds. All steps are group minima and equi-joins:
a hub's edges are combined before the exchange and no neighbour list is ever collected.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.operators.joins import attach
from tankline.session import ensure_checkpoint_dir


FINISH = 100_000


def joined(e: DataFrame) -> DataFrame:
    """(node, up) of a small edge table: up is one node of the component."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def find(v):
            while parent.setdefault(v, v) != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            return v

        def plain(v):  # arrays come as numpy
            return tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v

        for b in batches:
            for x, y in zip(b["a"], b["b"]):
                parent[find(plain(x))] = find(plain(y))
        nodes = list(parent)
        if nodes:
            yield pd.DataFrame({"node": [list(v) if isinstance(v, tuple) else v for v in nodes],
                                "up": [list(r) if isinstance(r, tuple) else r for r in map(find, nodes)]})

    kind = e.schema["a"].dataType.simpleString()
    return e.repartition(1).mapInPandas(run, f"node {kind}, up {kind}").checkpoint(eager=True)


def _above(parent: DataFrame, c: str, out: str) -> DataFrame:
    """``parent`` (node, up) as a lookup table from the column ``c`` to the column ``out``."""
    return parent.select(F.col("node").alias(c), F.col("up").alias(out))


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, a: str = "a", b: str = "b", max_rounds: int = 60,
                         finish: int = FINISH) -> DataFrame:
    """(node, root): every node of an edge, and of ``nodes`` (first column) if given, with the
    smallest node of its component. Null ends, loops and repeated edges are ignored; nodes
    without edges are their own roots."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    everyone = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    if nodes is not None:
        everyone = everyone.unionByName(nodes.select(F.col(nodes.columns[0]).alias("node")))
    label = everyone.where("node is not null").distinct().select("node", F.col("node").alias("root")).checkpoint(eager=True)
    e = e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint(eager=True)
    for r in range(max_rounds):
        if e.limit(finish + 1).count() <= finish:
            label = label.join(_above(joined(e), "root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
            first = label.groupBy("root").agg(F.min("node").alias("first"))
            return attach(label, first, "root", "inner").select("node", F.col("first").alias("root")).checkpoint(eager=True)

        def place(c: str, r: int = r) -> Column:
            return F.struct(F.xxhash64(c, F.lit(r)), F.col(c))

        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(place("b")).alias("low"))
        one = low.select(F.col("a").alias("node"), F.when(F.col("low") < place("a"), F.col("low.b")).otherwise(F.col("a")).alias("up")).checkpoint(eager=True)
        two = one.join(_above(one, "up", "top"), "up").select("node", F.col("top").alias("up"))
        four = two.join(_above(two, "up", "top"), "up").select("node", F.col("top").alias("up")).checkpoint(eager=True)
        moved = e.join(_above(four, "a", "x"), "a").join(_above(four, "b", "y"), "b").select("x", "y")
        kept = four.select(F.col("up").alias("x")).distinct().join(_above(one, "x", "y"), "x")  # roots are their own parents
        e = moved.unionByName(kept).where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().checkpoint(eager=True)
        label = label.join(_above(four, "root", "top"), "root", "left").select("node", F.coalesce("top", "root").alias("root")).checkpoint(eager=True)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
