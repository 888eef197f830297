"""Target-distribution importance resampling (DSIR style) with an exact distributed selection.

Features are runs of 1 to ``max_run`` consecutive words, hashed into ``buckets``. Corpus and
target counts of the buckets give an integer gain per bucket; a document's weight is the sum
of its features' gains (gathered from one array), its score the weight plus Gumbel noise from
its id. The best share of the eligible documents is drawn: the k-th key is found by weighted
median-of-medians selection over the narrow table of keys. A round is one pass: every
partition splits its remaining keys at the pivot and reports both sizes and medians; the
median of the partition medians, weighted by those sizes, is the next pivot and discards at
least a quarter. The last ``FINISH`` keys or fewer are ordered on the driver. Only winners are
sorted, by range.

Keys are (score descending, id ascending with null ids last, row), so ties and repeated rows
have one order. Ids are integers.

Defined cases: null and empty texts have no words, weigh 0 and are not eligible; repeated rows
count and are drawn one by one; a null id has the noise of the empty string; without target or
corpus texts gains follow from the smoothing; empty tables give no rows; input columns are
returned in the struct ``row`` only if asked for, so none can clash.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import WORD_BYTES, packed
from tankline.operators.ranking import dense_rank_keys
from tankline.session import ensure_checkpoint_dir

BUCKETS = 10_000
MIN_WORDS = 20
FINISH = 4096
_LAST = np.iinfo(np.int64).max


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


def buckets_of(words: list[bytes], max_run: int, buckets: int) -> np.ndarray:
    """The bucket of every run of 1 to ``max_run`` words."""
    runs = words
    for n in range(2, max_run + 1):
        runs = runs + [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    return np.fromiter(map(zlib.crc32, runs), np.int64, len(runs)) % buckets


def bucket_counts(texts: DataFrame, text_col: str, max_run: int, buckets: int) -> np.ndarray:
    """Features per bucket over all texts; every task sends at most ``buckets`` sums."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for t in b["text"]:
                total += np.bincount(buckets_of(words_of(t), max_run, buckets), minlength=buckets)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at, "n": total[at]})

    part = texts.select(F.col(f"`{text_col}`").alias("text")).mapInPandas(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in part.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


@dataclass
class Gains:
    gain: np.ndarray
    max_run: int

    @property
    def buckets(self) -> int:
        return len(self.gain)


def fit(corpus: DataFrame, target: DataFrame, text_col: str = "text", max_run: int = 1, buckets: int = BUCKETS) -> Gains:
    s, t = (bucket_counts(d, text_col, max_run, buckets) for d in (corpus, target))
    a, b = int(s.sum()) + buckets, int(t.sum()) + buckets
    ratio = [math.log(float((int(y) + 1) * a) / float((int(x) + 1) * b)) for x, y in zip(s, t)]
    return Gains(np.array([math.floor(1000 * r) for r in ratio], np.int64), max_run)


def weigh(docs: DataFrame, model: Gains, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text",
          carry: bool = False) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row, with ``row`` if ``carry``."""

    @F.pandas_udf("n_words long, n_features long, weight long")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            rows = []
            for t in texts:
                w = words_of(t)
                at = buckets_of(w, model.max_run, model.buckets)
                rows.append((len(w), len(at), int(model.gain[at].sum())))
            yield pd.DataFrame(rows, columns=["n_words", "n_features", "weight"])

    ids = F.col("id").cast("long")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ids.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    d = packed(docs, id=id_col, text=text_col).withColumn("w", of(F.col("text")))
    return d.select(*(["row"] if carry else []), ids.alias("id"), "w.n_words", "w.n_features", "w.weight",
                    (F.col("w.weight") + noise).cast("long").alias("score"))


Key = tuple[int, int, int]


def cutoff(keys: DataFrame, k: int, finish: int = FINISH) -> Key | None:
    """The k-th smallest of the distinct keys (a, b, c: three longs); None if k < 1."""
    if k < 1:
        return None

    def split(lo: Key | None, pivot: Key | None, hi: Key | None):
        def after(x: np.ndarray, p: Key) -> np.ndarray:
            a, b, c = x
            return (a > p[0]) | ((a == p[0]) & ((b > p[1]) | ((b == p[1]) & (c > p[2]))))

        def middle(x: np.ndarray) -> Key:
            a = x[0]
            m = (len(a) - 1) // 2
            v = np.partition(a, m)[m]
            x, m = x[:, a == v], m - int((a < v).sum())
            return tuple(int(q) for q in x[:, np.lexsort((x[2], x[1]))[m]])

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            kept = []
            for d in batches:
                x = d[["a", "b", "c"]].to_numpy(np.int64).T
                if lo is not None:
                    x = x[:, after(x, lo)]
                if hi is not None:
                    x = x[:, ~after(x, hi)]
                kept.append(x)
            x = np.concatenate(kept, axis=1) if kept else np.zeros((3, 0), np.int64)
            up = after(x, pivot) if pivot is not None else np.ones(x.shape[1], bool)
            rows = [(side, y.shape[1], *middle(y)) for side, y in ((0, x[:, ~up]), (1, x[:, up])) if y.shape[1]]
            yield pd.DataFrame(rows, columns=["side", "n", "a", "b", "c"])

        return run

    lo = hi = pivot = None
    while True:
        got = keys.select("a", "b", "c").mapInPandas(split(lo, pivot, hi), "side int, n long, a long, b long, c long").collect()
        below = sum(r["n"] for r in got if r["side"] == 0)  # two rows a partition
        if k <= below:
            side, hi = 0, pivot
        else:
            side, lo, k = 1, pivot, k - below
        medians = sorted((r["a"], r["b"], r["c"], r["n"]) for r in got if r["side"] == side)
        left = sum(m[3] for m in medians)
        if k > left:
            raise ValueError("fewer keys than asked for")
        if left <= finish:
            break
        seen = 0
        for *p, n in medians:
            seen += n
            if 2 * seen >= left:
                pivot = tuple(p)
                break

    def beyond(p: Key):
        return F.struct("a", "b", "c") > F.struct(*[F.lit(v).cast("long") for v in p])

    rest = keys.select("a", "b", "c")
    rest = rest if lo is None else rest.where(beyond(lo))
    rest = rest if hi is None else rest.where(~beyond(hi))
    return sorted((r["a"], r["b"], r["c"]) for r in rest.collect())[k - 1]  # at most ``finish`` rows


def draw(weighed: DataFrame, percent: int = 10, min_words: int = MIN_WORDS, finish: int = FINISH) -> DataFrame:
    """``weighed`` (of ``weigh``) with ``rank``: 1, 2, 3, ... for the drawn, null for the others."""
    spark = weighed.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/resample-{uuid.uuid4().hex}"
    weighed.withColumn("_rid", F.monotonically_increasing_id()).write.parquet(path)  # row ids are fixed from here on
    table = spark.read.parquet(path)
    keys = table.where(F.col("n_words") >= min_words).select(
        (-F.col("score")).alias("a"), F.coalesce("id", F.lit(int(_LAST))).alias("b"), F.col("_rid").alias("c"))
    last = cutoff(keys, percent * keys.count() // 100, finish)
    key = F.struct("a", "b", "c")
    if last is None:
        return table.withColumn("rank", F.lit(None).cast("long")).drop("_rid")
    won = keys.select(key.alias("key")).where(F.col("key") <= F.struct(*[F.lit(int(v)).cast("long") for v in last]))
    ranks = dense_rank_keys(won, "key").select(F.col("key.c").alias("_rid"), F.col("rank").cast("long"))
    return table.join(ranks, "_rid", "left").drop("_rid")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, min_words: int = MIN_WORDS,
             id_col: str = "doc_id", text_col: str = "text", carry: bool = False, max_run: int = 1,
             buckets: int = BUCKETS) -> DataFrame:
    """Every row's id, n_words, n_features, weight, score and rank (and ``row`` if ``carry``); the
    drawn documents are those with a rank."""
    return draw(weigh(docs, fit(docs, target, text_col, max_run, buckets), seed, id_col, text_col, carry), percent, min_words)
