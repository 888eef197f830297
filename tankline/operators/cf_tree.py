"""BIRCH's clustering-feature tree over distributed rows (CL-12).

A clustering feature is (rows, sum, sum of squared lengths): features add up, and give centroid
and radius (root mean square distance from the centroid). Rows are first added up by cells whose
diameter is at most half the threshold, which is one map-side combined aggregate however many
rows a cell holds. Each partition then inserts its cells into a tree: down to the closest child,
into the closest entry of the leaf if the radius stays within the threshold, else as a new entry;
a node of more than ``branching`` children splits around its two farthest ones. The trees' leaf
entries are merged the same way, ``FAN`` partitions at a time, until one tree is left.

Whatever the partitions, the entries' features add up to those of all rows and no radius exceeds
the threshold. Which rows share an entry depends on the order of insertion, so two runs with
other partitions may place a centroid elsewhere, by no more than twice the threshold from the
nearest one of the other run along the rows they share. If more than ``max_entries`` are left,
the threshold grows by half and the entries are merged again, as in the original algorithm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.session import ensure_checkpoint_dir

BRANCHING = 50
FAN = 8
MAX_ENTRIES = 50_000


def radius(n, total, square):
    """Root mean square distance of an entry's rows from its centroid."""
    return np.sqrt(np.maximum(square / n - ((total / np.expand_dims(n, -1)) ** 2).sum(axis=-1), 0))


class Node:
    """Features of the children (or of the entries, in a leaf) as rows of arrays."""

    def __init__(self, d: int, branching: int, leaf: bool):
        self.n, self.total, self.square = np.zeros(branching + 1), np.zeros((branching + 1, d)), np.zeros(branching + 1)
        self.children: list[Node] | None = None if leaf else []
        self.size = 0

    def add(self, n: float, total: np.ndarray, square: float, child: Node | None = None) -> None:
        i = self.size
        self.n[i], self.total[i], self.square[i] = n, total, square
        if child is not None:
            self.children.append(child)
        self.size += 1

    def features(self) -> tuple[float, np.ndarray, float]:
        return self.n[: self.size].sum(), self.total[: self.size].sum(axis=0), self.square[: self.size].sum()

    def closest(self, centre: np.ndarray) -> int:
        c = self.total[: self.size] / self.n[: self.size, None]
        return int(((c - centre) ** 2).sum(axis=1).argmin())


class Tree:
    def __init__(self, d: int, threshold: float, branching: int = BRANCHING):
        self.d, self.threshold, self.branching = d, threshold, branching
        self.root = Node(d, branching, True)

    def insert(self, n: float, total: np.ndarray, square: float) -> None:
        parts = self._insert(self.root, n, total, square)
        if parts:
            self.root = Node(self.d, self.branching, False)
            for p in parts:
                self.root.add(*p.features(), p)

    def _insert(self, node: Node, n: float, total: np.ndarray, square: float) -> list[Node] | None:
        """The two nodes that replace ``node`` if it had to split."""
        if node.children is None:
            if node.size:
                i = node.closest(total / n)
                if radius(node.n[i] + n, node.total[i] + total, node.square[i] + square) <= self.threshold:
                    node.n[i] += n
                    node.total[i] += total
                    node.square[i] += square
                    return None
            node.add(n, total, square)
        else:
            i = node.closest(total / n)
            parts = self._insert(node.children[i], n, total, square)
            if not parts:
                node.n[i] += n
                node.total[i] += total
                node.square[i] += square
                return None
            node.children[i] = parts[0]
            node.n[i], node.total[i], node.square[i] = parts[0].features()
            node.add(*parts[1].features(), parts[1])
        return self._split(node) if node.size > self.branching else None

    def _split(self, node: Node) -> list[Node]:
        k = node.size
        c = node.total[:k] / node.n[:k, None]
        apart = ((c[:, None] - c[None]) ** 2).sum(axis=2)
        a, b = np.unravel_index(apart.argmax(), apart.shape)
        to_a = apart[a] <= apart[b]
        to_a[a], to_a[b] = True, False
        out = [Node(self.d, self.branching, node.children is None) for _ in range(2)]
        for i in range(k):
            out[0 if to_a[i] else 1].add(node.n[i], node.total[i], node.square[i], node.children[i] if node.children is not None else None)
        return out

    def entries(self) -> list[tuple[float, np.ndarray, float]]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if node.children is None:
                out += [(node.n[i], node.total[i], node.square[i]) for i in range(node.size)]
            else:
                stack += node.children[::-1]
        return out


SCHEMA = "part int, n double, total array<double>, square double"


def cell_features(df: DataFrame, threshold: float, features: str) -> tuple[DataFrame, int]:
    """(cell, n, total, square) of the cells of diameter threshold / 2; and the number of coordinates."""
    ensure_checkpoint_dir(df.sparkSession)
    x = F.col(features) if df.schema[features].dataType.typeName() == "array" else vector_to_array(features)
    rows = df.select(x.alias("x"))
    first = rows.select(F.size("x").alias("d")).first()
    d = first["d"] if first else 0
    side = threshold / (2 * math.sqrt(max(1, d)))
    cell = F.transform("x", lambda v: F.floor(v / F.lit(side)).cast("long"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.array(*[F.sum(F.col("x")[j]) for j in range(d)]).alias("total"),
                                                F.sum(square).alias("square")).checkpoint(eager=True), d


def merged(entries: DataFrame, d: int, threshold: float, branching: int, fan: int = FAN) -> DataFrame:
    """Trees over groups of partitions until one is left; entries in columns of ``SCHEMA``."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        tree = Tree(d, threshold, branching)
        for n, total, square in zip(rows["n"], rows["total"], rows["square"]):
            tree.insert(float(n), np.asarray(total, float), float(square))
        e = tree.entries()
        return pd.DataFrame({"part": np.full(len(e), int(rows["part"].iloc[0]) // fan, np.int32), "n": [x[0] for x in e], "total": [x[1] for x in e], "square": [x[2] for x in e]})

    parts = entries.agg(F.max("part")).first()[0]
    while parts is not None:
        entries = entries.groupBy("part").applyInPandas(build, SCHEMA).checkpoint(eager=True)
        if parts == 0:
            break
        parts = parts // fan
    return entries


def subclusters(df: DataFrame, threshold: float = 0.5, branching: int = BRANCHING, features: str = "features", parts: int | None = None,
                max_entries: int = MAX_ENTRIES) -> tuple[DataFrame, float]:
    """(n, total, square) of the tree's leaf entries, and the threshold that they keep."""
    cells, d = cell_features(df, threshold, features)
    spark = df.sparkSession
    parts = parts or max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), cells.count() // 2000 + 1))
    entries = cells.select(F.pmod(F.xxhash64("cell"), F.lit(parts)).cast("int").alias("part"), "n", "total", "square").orderBy("part", "total")
    while True:
        got = merged(entries, d, threshold, branching)
        if got.count() <= max_entries:
            return got.drop("part"), threshold
        threshold *= 1.5
        entries = got.withColumn("part", F.lit(0))


def nearest_label(centres: np.ndarray, labels: np.ndarray):
    """A function of a column of vectors (arrays): the label of the nearest centre."""

    @F.pandas_udf("int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        square = (centres * centres).sum(axis=1)
        for a in parts:
            out = np.zeros(len(a), np.int32)
            for at in range(0, len(a), 500):
                x = np.stack(a.iloc[at : at + 500].to_numpy())
                out[at : at + 500] = labels[(square[None, :] - 2 * x @ centres.T).argmin(axis=1)]
            yield pd.Series(out)

    return of
