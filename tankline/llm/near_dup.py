"""Near duplicates by DartMinHash signatures and banded joins.

Sketch (Christiani, "DartMinHash: Fast Sketching for Weighted Sets"): an element's
region is its weight times a rank axis. Hashed darts fall into unit cells of that
region, one on average per cell, the same for every set that holds the element; those
within the element's weight count, each belongs to one of ``k`` coordinates, and a
coordinate keeps its earliest dart. Two sets agree in a coordinate with the probability
of their weighted Jaccard similarity. With ``k (ln k + 2)`` darts expected, the few
sets with an empty coordinate throw more.

Elements are five-word shingles; by default every distinct shingle weighs 1, so the
similarity is that of the shingle sets, and 0.8 or more is a link. ``weights="count"``
weighs by occurrence instead.

1. One pass over the texts writes (row, id, text key, band hashes). Equal word sequences
   share a key; one row of each (a node) goes on.
2. Band hashes are exploded and grouped. A bucket's most central node (the one that shares
   the largest buckets) is its pivot; every other member is compared with it on the whole
   texts. Links make components; in two more rounds buckets that still span components
   take a pivot outside their first one. All of this is linear in the bucket.
3. Members of buckets that still span components are compared across components; an exact
   prefix filter with length and positional bounds over their rarest shingles finds the
   pairs, so neither a bucket of thousands of copies nor one of texts around a common
   passage costs its square, and no link between components is lost.
4. Components again; a class is named by its smallest id.

50 bands of 7 coordinates miss a pair at 0.8 with probability 1e-5.

Defined cases: texts without words are no copies of anything and are classes of their
own (a null id: the class null); texts of fewer than five words are one shingle;
repeated rows are one class; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import WORD_BYTES, hot_join, packed
from tankline.llm.components import components
from tankline.operators.joins import checked_broadcast
from tankline.session import ensure_checkpoint_dir

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 50, 7
K = BANDS * ROWS
ROUNDS = 3      # of star comparisons before the remainder is paired
_U = np.uint64
#: Poisson(1): probabilities of at most 0, 1, 2, ... darts in a cell.
_POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1.0, n + 1)) for n in range(18)])
CHUNK_CELLS = 600_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def words_of(text: str | None) -> list[bytes]:
    """The words of ``common.WORD`` after A-Z became a-z, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class WordHashes(dict):
    """64-bit hashes of words, remembered within a batch."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(words: list[bytes], seen: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order; of the whole text if it is shorter."""
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    if not size:
        return h
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out * _U(0x9E3779B97F4A7C15) + h[i : i + n])
    return out


def text_key(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b"\0".join(words), digest_size=16).digest()


def dart_minhash(elements: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """(n, k) signatures of ``n`` weighted sets: parallel arrays of hashed elements, positive
    weights and the index of the set that holds each. Sets without elements keep the value
    ``2**64 - 1``. Weights should be about 1 or more (cells are units of weight)."""
    sig = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    total = np.bincount(owner, weights, n)
    with np.errstate(divide="ignore"):
        depth = np.where(total > 0, k * (np.log(k) + 2) / total, 0.0)  # ranks to cover
    done = np.zeros(n)
    unit = bool((weights == 1).all())   # one cell a rank, and no dart above the weight
    todo = total > 0
    while todo.any():
        at = np.flatnonzero(todo[owner])
        own = owner[at]
        # whole rank units from the last one begun
        base = np.floor(done).astype(np.int64)
        units = np.ceil(depth).astype(np.int64) - base
        wide = np.ceil(weights[at]).astype(np.int64)
        cells = wide * units[own]
        edges = np.cumsum(cells)
        lo = 0
        while lo < len(at):  # slices of bounded size
            hi = max(lo + 1, int(np.searchsorted(edges, (edges[lo - 1] if lo else 0) + CHUNK_CELLS, "right")))
            part = slice(lo, hi)
            c = cells[part]
            e = np.repeat(np.arange(lo, hi), c)
            i = np.arange(len(e)) - np.repeat(np.cumsum(c) - c, c)
            if unit:
                rank = np.repeat(base[own[part]], c) + i
                of_rank = mix(np.arange(int(rank.max(initial=0)) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15) + _U(1))
                h = mix(np.repeat(elements[at[part]], c) ^ of_rank[rank])
            else:
                rank = base[own[e]] + i % units[own[e]]
                height = i // units[own[e]]
                h = mix(elements[at[e]] ^ mix(rank.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + height.astype(np.uint64) * _U(0xD6E8FEB86659FD93) + _U(1)))
            darts = np.searchsorted(_POISSON, (h >> _U(11)).astype(float) * 2.0**-53, "right")
            d = np.repeat(np.arange(len(e)), darts)
            j = np.arange(len(d)) - np.repeat(np.cumsum(darts) - darts, darts)
            g = mix(h[d] + (j.astype(np.uint64) + _U(1)) * _U(0xA0761D6478BD642F))
            frac = g >> _U(40)
            of_set, rank = own[e[d]], rank[d]
            when = rank + frac.astype(float) * 2.0**-24
            keep = (when < depth[of_set]) & (when >= done[of_set])
            if not unit:
                up = height[d] + ((g >> _U(16)) & _U(0xFFFFFF)).astype(float) * 2.0**-24
                keep &= up < weights[at[e[d]]]
            g = g[keep]
            value = (rank[keep].astype(np.uint64) << _U(40)) | (frac[keep] << _U(16)) | (mix(g) >> _U(48))
            slot = of_set[keep] * k + ((g & _U(0xFFFF)) * _U(k) >> _U(16)).astype(np.int64)
            np.minimum.at(sig, slot, value)
            lo = hi
        empty = (sig.reshape(n, k) == np.iinfo(np.uint64).max).any(axis=1)
        todo = todo & empty
        done = np.where(todo, depth, done)
        depth = np.where(todo, depth * 2, depth)
        if depth.max(initial=0) >= 1 << 24:  # the rank's bits in a value
            raise ValueError("weights far below 1")
    return sig.reshape(n, k)


def band_hashes(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    s = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sig), bands)).copy()
    for i in range(rows):
        h = mix(h * _U(0x9E3779B97F4A7C15) + s[:, :, i])
    return h.view(np.int64)


def sketch_texts(texts: list[str | None], weights: str = "set", bands: int = BANDS, rows: int = ROWS):
    """(keys, band hashes) of a list of texts; None for texts without words."""
    seen = WordHashes()
    keys, parts, owner, counts = [], [], [], []
    for i, t in enumerate(texts):
        w = words_of(t)
        keys.append(text_key(w) if w else None)
        if w:
            # 48 bits name an element within this text's sketch; links are verified on the texts
            e, c = np.unique(shingle_hashes(w, seen) >> _U(16), return_counts=True)
            parts.append(e)
            counts.append(c if weights == "count" else np.ones(len(c)))
            owner.append(np.full(len(e), i))
    if not parts:
        return keys, [None] * len(texts)
    sig = dart_minhash(mix(np.concatenate(parts)), np.concatenate(counts).astype(float), np.concatenate(owner), len(texts), bands * rows)
    b = band_hashes(sig, bands, rows)
    return keys, [b[i] if k else None for i, k in enumerate(keys)]


def sketch(docs: DataFrame, id_col: str, text_col: str, weights: str = "set") -> DataFrame:
    """(id, text key, bands) of every row."""

    @F.pandas_udf("key binary, bands array<long>")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            keys, bands = [], []
            for lo in range(0, len(texts), 256):  # bounds the darts held at once
                k, b = sketch_texts(list(texts[lo : lo + 256]), weights)
                keys += k
                bands += b
            yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "bands": pd.Series(bands, dtype=object)})

    d = docs.select(F.col(id_col).alias("id"), of(F.col(text_col)).alias("s"))
    return d.select("id", "s.key", "s.bands")


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays without repeats."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / max(1, len(a) + len(b) - both)


def verify(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are at least that similar."""
    both = (pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("ta")), "a")
            .join(texts.select(F.col("node").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen, last, right, ok = WordHashes(), None, None, []
            for a, b in zip(batch["ta"], batch["tb"]):
                if b != last or right is None:  # rows of one pivot lie together
                    last, right = b, np.unique(shingle_hashes(words_of(b), seen))
                ok.append(jaccard(np.unique(shingle_hashes(words_of(a), seen)), right) >= similarity)
                if len(seen) > 300_000:
                    seen.clear()
            yield batch.loc[ok, ["a", "b"]]

    return both.mapInPandas(run, "a long, b long")


def with_roots(members: DataFrame, found: DataFrame) -> DataFrame:
    return members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))


def star_pairs(members: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): in every bucket that spans components, the most central node b outside the
    component of the bucket's most central node (in the first round, that node itself) and
    all members of other components. Linear in the bucket."""
    at = with_roots(members, found)
    rank = F.struct("degree", -F.col("node"))
    first = at.groupBy("band").agg(F.max(F.struct(rank.alias("rank"), "root")).alias("top"))
    if found.isEmpty():
        pivot = first.select("band", (-F.col("top.rank.col2")).alias("b"), F.col("top.root").alias("root_b"))
    else:
        out = at.join(first, "band").where(F.col("root") != F.col("top.root"))
        pivot = out.groupBy("band").agg(F.max(F.struct(rank.alias("rank"), "root")).alias("p")).select(
            "band", (-F.col("p.rank.col2")).alias("b"), F.col("p.root").alias("root_b"))
    return at.join(pivot, "band").where("root <> root_b").select(F.col("node").alias("a"), "b").distinct()


def rare_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots that may be similar, from (node, root, text).

    Exact prefix filter: with shingles ordered by how many of these nodes hold them, sets
    of similarity ``s`` share one among the first ``n - ceil(s n) + 1`` of each. A passage
    that thousands of nodes share is not among the rarest shingles of texts that differ
    otherwise, so such texts, which fall into one bucket, are not paired."""
    kind = "node long, root long, n int, h long"

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = WordHashes()
            for node, root, text in zip(batch["node"], batch["root"], batch["text"]):
                h = np.unique(shingle_hashes(words_of(text), seen)).view(np.int64)
                yield pd.DataFrame({"node": node, "root": root, "n": np.int32(len(h)), "h": h})

    sh = nodes.select("node", "root", "text").mapInPandas(explode, kind)
    freq = sh.groupBy("h").agg(F.count(F.lit(1)).alias("f"))
    order = Window.partitionBy("node").orderBy("f", "h")  # a text's own shingles
    first = sh.join(freq, "h").withColumn("i", F.row_number().over(order)).where(
        (F.col("i") <= F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1) & (F.col("f") > 1))
    left = first.select("h", F.col("node").alias("a"), "root", "n", "i")
    right = first.select("h", F.col("node").alias("b"), F.col("root").alias("root_b"), F.col("n").alias("n_b"), F.col("i").alias("j"))
    alike = (F.least("n", "n_b") >= F.greatest("n", "n_b") * similarity - 1e-9) & (F.col("root") > F.col("root_b"))
    # the first common shingle of a similar pair leaves room for the overlap that it needs
    need = F.ceil((F.col("n") + F.col("n_b")) * (similarity / (1 + similarity)) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("i"), F.col("n_b") - F.col("j")) >= need
    return left.join(right, "h").where(alike & room).select("a", "b").distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY,
            weights: str = "set") -> DataFrame:
    """One row per input row: id, class_id (smallest id of its class), class_size (rows) and
    n_texts (different word sequences in the class)."""
    spark = docs.sparkSession
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/near-dup-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        """A table in the shared folder: cuts the lineage, survives lost executors."""
        df.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    rows = stored(sketch(docs, id_col, text_col, weights).withColumn("row", F.monotonically_increasing_id()), "sketch")
    worded = rows.where(F.col("key").isNotNull())
    # one node per word sequence: its first row, which is stored and so fixed
    keys = stored(worded.groupBy("key").agg(F.min("row").alias("node"), F.min("id").alias("first"), F.count(F.lit(1)).alias("n_rows")), "keys")
    nodes = stored(worded.join(keys.select("node"), F.col("row") == F.col("node"))
                   .select("node", "id", "key", "bands"), "nodes")
    bands = nodes.select("node", F.explode("bands").alias("band"))
    buckets = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = stored(bands.join(buckets, "band"), "members")  # only of buckets with two nodes or more
    # a node that shares large buckets in many bands is central in its group: the best one to compare with
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    members = stored(members.join(degree, "node").select("band", "node", "degree"), "ranked")
    # texts of the nodes in such buckets, found by id and checked by key
    wanted = members.select("node").distinct().join(nodes.select("node", "id", "key"), "node")

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok = [text_key(words_of(t)) == bytes(k) for t, k in zip(b["text"], b["key"])]
            yield b.loc[ok, ["node", "text"]]

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    w = checked_broadcast(wanted.withColumnRenamed("id", "_id"))
    texts = stored(source.join(w, source["id"].eqNullSafe(w["_id"])).select("node", "text", "key")
                   .mapInPandas(keyed, "node long, text string").dropDuplicates(["node"]), "texts")
    found = spark.createDataFrame([], "node long, root long")
    links = []
    for r in range(ROUNDS):
        star = stored(star_pairs(members, found), f"star-{r}")
        if star.isEmpty():  # no bucket spans components any more
            break
        links.append(stored(verify(star, texts, similarity), f"links-{r}"))
        found = components(functools.reduce(DataFrame.unionByName, links))
    if not links:
        links.append(spark.createDataFrame([], "a long, b long"))
    at = with_roots(members, found)
    mixed = at.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    rest = at.join(mixed, "band", "left_semi").select("node", "root").distinct()
    links.append(stored(verify(rare_pairs(rest.join(texts, "node"), similarity), texts, similarity), "more"))
    found = components(functools.reduce(DataFrame.unionByName, links))
    named = stored(keys.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    # counts per class from counts per text, which come back first to the texts, then to the rows
    size = named.groupBy("root").agg(F.min("first").alias("class_id"), F.sum("n_rows").alias("class_size"), F.count(F.lit(1)).alias("n_texts"))
    of_text = stored(hot_join(named.select("key", "n_rows", "root"), size, "root", "n_texts").drop("root"), "classes")
    member = hot_join(rows.select("id", "key"), of_text, "key", "n_rows")
    one = F.lit(1).cast("long")
    return member.select(F.col("id").alias(id_col), F.coalesce("class_id", "id").alias("class_id"),
                         F.coalesce("class_size", one).alias("class_size"), F.coalesce("n_texts", one * 0).alias("n_texts"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each class: that with the smallest id. Rows that repeat
    both id and text count as one."""
    c = classes(docs, id_col, text_col, **how)
    keep = c.where(F.col(id_col).eqNullSafe(F.col("class_id"))).groupBy(F.col(id_col).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    d = packed(docs, i=id_col, t=text_col).join(checked_broadcast(keep), F.col("i").eqNullSafe(F.col("_k")))
    return d.where("_n = 1").unionByName(d.where("_n > 1").dropDuplicates(["i", "t"])).select("row.*")
