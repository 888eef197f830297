"""Quality classifier: a linear-chain CRF labels every line good or bad.

Each line with a word has features of its own (symbols, capitals, repeats, ...) and
those of the lines before and after it. Marginals come from forward-backward over the
text's lines; their mean, weighted by line length, is calibrated into the score.

Learning uses at most ``max_docs`` labelled documents that are among the given ones, half
of them of each label at most (those with the smallest hash of their id), of which only
the features of the first ``max_lines`` lines reach the driver. Lines first take their
document's label; lines of bad documents that look good by their own features alone
are relabelled, and the CRF is fitted to that.

Defined cases: null, empty and blank texts have no line and score 0; repeated rows
are scored one by one; conflicting labels of a document are not learned from; without
labels of both kinds every text with a line scores 0.5 (``LineModel.learned`` is false);
documents that share an id are one in learning, with the smallest text; other columns
are kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm import crf

MAX_DOCS = 2000
MAX_LINES = 1000    # of one document in learning; scores take all lines
SYMBOLS = "#*$%&<>{}=~^_\\@"
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_END = tuple(".!?:;\"'»”")
N_FEATURES = 14


def line_features(line: str, seen: set, before: str) -> list[float]:
    """Features of one line; ``seen`` holds the earlier lines of the text."""
    w = line.split()
    n, chars = len(w), len(line)
    joined = max(1, chars - line.count(" "))
    return [
        math.log1p(n) / 5, math.log1p(joined / n) / 3,
        10 * sum(map(line.count, SYMBOLS)) / joined, 10 * line.count("|") / joined,
        3 * len(_UPPER.findall(line)) / joined, 3 * len(_DIGIT.findall(line)) / joined, 10 * line.count("!") / joined,
        sum(map(eq, w, w[1:])) / n, len(set(w)) / n, float(line in seen), float(line == before),
        float(line.rstrip().endswith(_END)), float(line[:1].isupper()),
        5 * (line.count(",") + line.count(".")) / n,
    ]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines, 3 * N_FEATURES) with the neighbours' features beside each line's own, and the
    number of characters of each line."""
    rows, size, seen, before = [], [], set(), ""
    for line in (text or "").split("\n"):
        if line and not line.isspace():
            rows.append(line_features(line, seen, before))
            size.append(len(line))
            seen.add(line)
            before = line
    x = np.array(rows, np.float32).reshape(-1, N_FEATURES)
    gap = np.full((1, N_FEATURES), -0.5, np.float32)  # no neighbour
    return np.hstack([x, np.vstack([gap, x])[: len(x)], np.vstack([x, gap])[1:][: len(x)]]), np.array(size, np.float64)


@dataclass
class LineModel:
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    slope: float
    shift: float

    @property
    def learned(self) -> bool:
        """False for the model of labels of one kind only, which can't tell texts apart."""
        return bool(self.weights.any())

    def emission(self, x: np.ndarray) -> np.ndarray:
        e = np.zeros((len(x), 2))
        e[:, 1] = x @ self.weights[:-1] + self.weights[-1]
        return e

    def line_marginals(self, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """P(good) of every line of a batch of texts."""
        return crf.marginals(self.emission(x), self.trans, self.start, lengths)[:, 1] if len(x) else np.zeros(0)

    def scores(self, x: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Document scores; 0 for a document without lines."""
        mean = weighted_mean(self.line_marginals(x, lengths), size, lengths)
        return np.where(lengths > 0, 1 / (1 + np.exp(-(self.slope * mean + self.shift))), 0.0)


def weighted_mean(p: np.ndarray, size: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(doc, p * size, len(lengths)) / np.maximum(np.bincount(doc, size, len(lengths)), 1)


def _calibrate(mean: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on the weighted mean (Newton steps, small ridge)."""
    x = np.column_stack([mean, np.ones(len(mean))])
    b = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 0.05 * np.eye(2)
        b = b + np.linalg.solve(h, x.T @ (y - p) - 0.05 * b)
    return float(b[0]), float(b[1])


def fit_arrays(x: np.ndarray, size: np.ndarray, lengths: np.ndarray, quality: np.ndarray) -> LineModel:
    doc = np.repeat(np.arange(len(lengths)), lengths)
    of_doc = quality[doc].astype(int)
    if len(x) == 0 or of_doc.min() == of_doc.max():
        return LineModel(np.zeros(x.shape[1] + 1), np.zeros((2, 2)), np.zeros(2), 0.0, 0.0)

    def learn(x: np.ndarray, gold: np.ndarray, lengths: np.ndarray) -> LineModel:
        def emission(th):
            e = np.zeros((len(x), 2))
            e[:, 1] = x @ th[:-1] + th[-1]
            return e

        return LineModel(*crf.fit(emission, lambda d: np.append(x.T @ d[:, 1], d[:, 1].sum()), np.zeros(x.shape[1] + 1), 2,
                                  gold, lengths, l2=1e-5, steps=200, rate=0.2), 0.0, 0.0)

    # by its own features alone (chains of one line) a line of a bad document may look good
    own = x[:, :N_FEATURES]
    single = learn(own, of_doc, np.ones(len(x), int))
    looks = single.line_marginals(own, np.ones(len(x), int))
    model = learn(x, np.where((of_doc == 0) & (looks > 0.5), 1, of_doc), lengths)
    has = lengths > 0
    mean = weighted_mean(model.line_marginals(x, lengths), size, lengths)
    model.slope, model.shift = _calibrate(mean[has], quality[has])
    return model


def _crc(c: Column) -> Column:
    return F.crc32(c.cast("string").cast("binary"))


def training_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str,
                    max_docs: int, learn: Column | None) -> DataFrame:
    """(quality, text) of at most ``max_docs`` labelled documents that are in ``docs``, with at most
    half of them (rounded up) per label: the smallest id hashes."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_y")).where(
        F.col("_id").isNotNull() & F.col("_y").isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_z")).where(F.col("_y") == F.col("_z"))
    # labels of documents that an earlier stage rejected take no places
    known = known.join(docs.select(F.col(id_col).alias("_id")), "_id", "left_semi").select("_id", F.col("_y").cast("int").alias("_y"))
    bad, good = (known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit((max_docs + 1 - y) // 2) for y in (0, 1))
    # max_docs bounds the broadcast side
    texts = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text"))
    some = F.broadcast(bad.unionByName(good))
    return texts.join(some, texts["_doc"] == some["_id"]).groupBy("_id").agg(
        F.min("_y").alias("y"), F.min("_text").alias("text")).drop("_id")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        max_docs: int = MAX_DOCS, learn: Column | None = None, max_lines: int = MAX_LINES) -> LineModel:
    """``learn`` (over ``_id``) tells which labelled rows may be learned from; at most
    ``max_docs * max_lines`` lines are collected."""
    sample = training_sample(docs, labels, id_col, text_col, label_col, max_docs, learn)

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for y, text in zip(b["y"], b["text"]):
                x, size = (a[:max_lines] for a in text_features(text))
                yield pd.DataFrame({"y": [y], "n": [len(x)], "x": [x.tobytes()], "size": [size.tobytes()]})

    rows = sample.mapInPandas(features, "y int, n int, x binary, size binary").collect()  # max_docs rows of numbers, max_lines long
    rows.sort(key=lambda r: (r["y"], r["n"], bytes(r["x"])))
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, 3 * N_FEATURES)
    size = np.frombuffer(b"".join(bytes(r["size"]) for r in rows), np.float64)
    return fit_arrays(x, size, np.array([r["n"] for r in rows], int), np.array([r["y"] for r in rows], float))


def score(docs: DataFrame, model: LineModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text, 0 to 1."""

    @F.pandas_udf("double")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            got = [text_features(t) for t in texts]
            lengths = np.array([len(x) for x, _ in got], int)
            if not len(got) or not lengths.sum():
                yield pd.Series(np.zeros(len(got)))
                continue
            yield pd.Series(model.scores(np.vstack([x for x, _ in got]), np.concatenate([s for _, s in got]), lengths))

    return docs.withColumn(out, of(F.col(text_col)))


def held_out(id_col: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text leaves ``rest``; false for a null id."""
    return F.coalesce(F.pmod(_crc(id_col), F.lit(mod)) == rest, F.lit(False))
