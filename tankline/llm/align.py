"""Cross-tokenizer alignment by merge-path partitioning.

Every text is encoded by two vocabularies; the byte offsets where their tokens end are two
sorted sequences (those of a batch of texts laid end to end, so a text's last byte is an end of
both). Diagonals of the merge grid, ``PIECE`` steps apart, are cut by binary search into pieces
of equal work; all pieces then merge their stretch at once, one step of each per array
operation. A step emits the link of the two tokens that overlap there; a step where both end
closes a group. A piece knows only its own closed groups; the running total of the pieces
before it is added at the end, which joins the groups that lie across a border.

Counts of linked id pairs (in how many texts) are a map-side combined aggregate. They come back
to the texts by a join that broadcasts them only up to a checked number of rows.

Defined cases: a null or empty text, or one whose bytes a vocabulary doesn't give back (after
the space before it), has no tokens; repeated rows are texts of their own; a column named like
an output raises; other columns are kept; empty tables give no rows; a text of any length is
whole in one task (some 100 bytes of memory per byte of it).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tankline.operators.joins import checked_broadcast
from tankline.session import ensure_checkpoint_dir

PIECE = 64                  # merge steps of a piece
BATCH_CHARS = 400_000       # of the texts that are merged in one go, if there are several
PAIR = 20                   # bits of an id in a pair
COUNTS_BROADCAST = 2_000_000


def cut(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> np.ndarray:
    """Tokens of ``a`` consumed where the merge path crosses diagonals 0, piece, 2 * piece, ...; of
    equal ends that of ``a`` comes first."""
    n, m = len(a), len(b)
    d = np.arange(0, n + m, piece)
    lo, hi = np.maximum(0, d - m), np.minimum(d, n)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        more = (lo < hi) & (a[np.minimum(mid, n - 1)] <= b[np.clip(d - 1 - mid, 0, m - 1)])
        lo, hi = np.where(more, mid + 1, lo), np.where(more, hi, np.maximum(lo, mid))
    return lo


def merge(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (index in a, index in b, group) in order, of two increasing sequences of ends with the
    same last value."""
    if not len(a):
        none = np.zeros(0, np.int64)
        return none, none, none
    i = cut(a, b, piece)
    j = np.arange(len(i)) * piece - i
    a1, b1 = np.append(a, a[-1] + 1), np.append(b, b[-1] + 1)
    last = np.maximum(np.where(i > 0, a1[i - 1], 0), np.where(j > 0, b1[j - 1], 0))
    shape = (piece, len(i))
    at_a, at_b, link, closed = np.empty(shape, np.int64), np.empty(shape, np.int64), np.empty(shape, bool), np.empty(shape, bool)
    total = len(a) + len(b)
    for step in range(piece):
        end_a, end_b = a1[i], b1[j]
        first = end_a <= end_b
        end = np.where(first, end_a, end_b)
        live = i + j < total
        at_a[step], at_b[step] = i, j
        np.logical_and(live, end > last, out=link[step])
        np.logical_and(live, end == last, out=closed[step])
        last = end
        i = i + (first & live)
        j = j + (~first & live)
    # stitch: a group's number counts those closed before it, in its piece and in all earlier ones
    own = np.cumsum(closed.T, axis=1)
    group = own - closed.T + (np.cumsum(own[:, -1]) - own[:, -1])[:, None]
    link = link.T
    return at_a.T[link], at_b.T[link], group[link]



class Aligner:
    """Aligns batches of texts; built in the worker from the two vocabularies."""

    def __init__(self, a, b, piece: int = PIECE):
        self.a, self.b, self.piece = a, b, piece
        self.size = [np.array([len(x) for x in v.bytes], np.int64) for v in (a, b)]
        names = [[str(i) for i in range(len(v.bytes))] for v in (a, b)]
        # an id inside its group, then the last one of it
        self.text = [x + end for v, stop in zip(names, ("|", ";")) for end in (",", stop) for x in v]
        self.start = np.cumsum([0, *(len(v.bytes) for v in (a, a, b))])

    def tokens(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]]]:
        full = [t if t else "" for t in texts]
        a, b = self.a.encode([" " + t for t in full]), self.b.encode(full)
        want = [(" " + t).encode("utf-8", "surrogatepass") if t else b"" for t in full]
        ta, tb = self.a.bytes, self.b.bytes
        for k, w in enumerate(want):
            if not w or b"".join(map(ta.__getitem__, a[k])) != w or b"".join(map(tb.__getitem__, b[k])) != w:
                a[k], b[k] = [], []
        return a, b

    def align(self, texts: list[str | None]) -> dict:
        a_of, b_of = self.tokens(texts)
        n_a, n_b = (np.array([len(x) for x in v], np.int64) for v in (a_of, b_of))
        a, b = (np.fromiter((t for x in v for t in x), np.int64, int(n.sum())) for v, n in ((a_of, n_a), (b_of, n_b)))
        at_a, at_b, group = merge(np.cumsum(self.size[0][a]), np.cumsum(self.size[1][b]), self.piece)
        docs = np.arange(len(texts))
        doc_a = np.repeat(docs, n_a)
        of_a, of_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        of_a[at_a], of_b[at_b] = group, group
        groups = int(group[-1]) + 1 if len(group) else 0
        ends = np.append(of_a[1:] != of_a[:-1], True) if len(a) else np.zeros(0, bool)
        n_groups = np.bincount(doc_a[ends], minlength=len(texts))
        doc = doc_a[at_a]
        n_links = np.bincount(doc, minlength=len(texts))
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links,
                "groups": self._written(a, b, of_a, of_b, ends, groups, n_a + n_b), **self._pairs(doc, a[at_a], b[at_b], len(texts))}

    def _written(self, a, b, of_a, of_b, ends, groups: int, sizes: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        in_a, in_b = np.bincount(of_a, minlength=groups), np.bincount(of_b, minlength=groups)
        last_b = np.append(of_b[1:] != of_b[:-1], True) if len(b) else np.zeros(0, bool)
        code = np.empty(len(a) + len(b), np.int64)
        code[np.arange(len(a)) + (np.cumsum(in_b) - in_b)[of_a]] = a + np.where(ends, self.start[1], self.start[0])
        code[np.arange(len(b)) + np.cumsum(in_a)[of_b]] = b + np.where(last_b, self.start[3], self.start[2])
        parts = list(map(self.text.__getitem__, code.tolist()))
        at = np.concatenate([[0], np.cumsum(sizes)]).tolist()
        return ["".join(parts[x:y])[:-1] for x, y in zip(at, at[1:])]

    @staticmethod
    def _pairs(doc, a, b, n: int) -> dict:
        """The distinct linked pairs of every text, with how often each is linked."""
        key, times = np.unique((doc << (2 * PAIR)) | (a << PAIR) | b, return_counts=True)
        sizes = np.bincount(key >> (2 * PAIR), minlength=n)
        return {"pairs": key & ((1 << (2 * PAIR)) - 1), "times": times.astype(np.int32), "sizes": sizes}


OUTPUT = T.StructType([T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [
    T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(T.LongType())),
    T.StructField("times", T.ArrayType(T.IntegerType()))])


def _slices(batch: pa.RecordBatch, text_col: str) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch of at most BATCH_CHARS characters, or of one row."""
    texts = batch.column(text_col).to_pylist()
    start = chars = 0
    for k, t in enumerate(texts):
        if k > start and chars + len(t or "") > BATCH_CHARS:
            yield batch.slice(start, k - start), texts[start:k]
            start, chars = k, 0
        chars += len(t or "")
    if len(texts) > start:
        yield batch.slice(start), texts[start:]


def align(docs: DataFrame, a, b, text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """``docs`` with n_a, n_b, n_groups, n_links, groups (``a1,a2|b1;a3|b2,b3``: the ids of both
    vocabularies, group by group), pairs (distinct linked ids, ``a << 20 | b``) and times (how
    often each is linked)."""
    clash = set(docs.columns) & set(OUTPUT.names)
    if clash:
        raise ValueError(f"columns named like outputs: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al = None
        for whole in batches:
            for batch, texts in _slices(whole, text_col):
                al = al or Aligner(a, b, piece)
                r = al.align(texts)
                at = pa.array(np.concatenate([[0], np.cumsum(r["sizes"])]).astype(np.int32))
                cols = [pa.array(r[n], pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")] + [
                    pa.array(r["groups"], pa.string()), pa.ListArray.from_arrays(at, pa.array(r["pairs"], pa.int64())),
                    pa.ListArray.from_arrays(at, pa.array(r["times"], pa.int32()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *OUTPUT.names])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *OUTPUT.fields]))


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, texts, best): in how many rows a pair is linked, and whether no pair of the same A id
    has more (ties are all best)."""
    n = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("texts"))
    n = n.withColumn("a", F.shiftright("pair", PAIR))
    top = n.groupBy("a").agg(F.max("texts").alias("top"))
    return n.join(top, "a").select("pair", "texts", (F.col("texts") == F.col("top")).alias("best"))


def with_counts(aligned: DataFrame, max_rows: int = COUNTS_BROADCAST) -> DataFrame:
    """``aligned`` (without ``groups``, if it was dropped) with n_best and count_sum for its pairs and
    times. The rows are written to the shared folder first, so that encoding happens once."""
    spark = aligned.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/align-{uuid.uuid4().hex}"
    rid = "_rid" + uuid.uuid4().hex
    aligned.withColumn(rid, F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    table = spark.read.parquet(path)
    counts = checked_broadcast(pair_counts(table), max_rows)
    links = table.select(rid, F.explode(F.arrays_zip("pairs", "times")).alias("l")).select(rid, F.col("l.pairs").alias("pair"), "l.times")
    sums = links.join(counts, "pair").groupBy(rid).agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).cast("long").alias("n_best"),
        F.sum(F.col("times") * F.col("texts")).cast("long").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return table.join(sums, rid, "left").withColumns({c: F.coalesce(c, zero) for c in ("n_best", "count_sum")}).drop(rid)
