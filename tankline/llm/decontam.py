"""Benchmark decontamination: prefix-filtered set join of document windows against items.

An item's windows are its runs of ``window`` words (an item of fewer words is one
window). A document is hit where a window occurs word for word. The join:

* shingles of up to ``shingle`` words are cut from every window and counted over all
  documents; the order by rarity is global;
* containment must be whole, so the necessary prefix of a window is its one rarest
  shingle, and only that shingle is joined;
* positional bound: shingle ``o`` of the window met at word ``p`` fixes the start
  ``p - o >= 0``; length bound: ``start + size <= n_words`` of the document;
* survivors are compared word by word (item-sized windows of the document).

A shingle's hash is that of its words and their number. With an index of up to
``BROADCAST_MAX_ROWS`` windows (counted) shingles are looked up and verified where the
document's words are; only matches (start, size, window) and one row per document are
shuffled, grouped by row. A larger index meets the shingles as (row, position, hash) in a
shuffle join, and words are fetched only for the documents with candidates.

Defined cases: null or empty texts have no words and are clean; items without words
take no part; equal items all count; rows are judged one by one, whatever their ids; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import packed, with_row_id, words
from tankline.operators.joins import BROADCAST_MAX_ROWS, checked_broadcast
from tankline.session import ensure_checkpoint_dir

WINDOW = 10
SHINGLE = 4


def _shingle(p: Column, size: int) -> Column:
    """Hash of the run of ``size`` words of the array column ``w`` from place ``p``; null if the array
    ends before. The number is part of the hash, so runs of different sizes never mix."""
    return F.when(p + size <= F.size("w"), F.xxhash64(*[F.get("w", p + j) for j in range(size)], F.lit(size)))


def item_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, win array of words): every window of every item, once per item."""
    d = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)))
    return d.select("item", F.explode(F.array_distinct(
        F.transform(starts, lambda i: F.slice("w", i + 1, window)))).alias("win")).distinct()


def doc_shingles(base: DataFrame, sizes: list[int]) -> DataFrame:
    """The rows of ``base`` once per place ``p`` of a word and size, with the hash ``h`` of the shingle that
    starts there (null: none does); a row without words comes once, with null for both. The words
    are taken to pieces first and hashed after: an expression over the whole array would be
    interpreted, and would copy the words of a text once per word."""
    at = base.select(*base.columns, F.posexplode_outer("w").alias("p", "_word")).drop("_word")
    h = [_shingle(F.col("p"), k) for k in sizes]
    return at.withColumn("h", F.explode(F.array(*h)) if len(h) > 1 else h[0])


def window_shingles(uniq: DataFrame, sizes: list[int]) -> DataFrame:
    """(win, wid, o, h): the shingles of every window."""
    at = uniq.select("win", "wid", "k", F.col("win").alias("w"), F.posexplode("win").alias("o", "_word"))
    of = F.lit(None).cast("bigint")
    for k in sizes:
        of = F.when(F.col("k") == k, _shingle(F.col("o"), k)).otherwise(of)
    return at.select("win", "wid", "o", of.alias("h")).where("h is not null")


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """One row per input row: id, n_words, n_hit, hits (sorted array of (start, size)),
    items (array of item ids as strings, sorted), contaminated."""
    return _found(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), items, item_col, item_text_col, window, shingle,
                  max_rows).drop("_rid").withColumnRenamed("id", id_col)


def _found(texts: DataFrame, items: DataFrame, item_col: str, item_text_col: str, window: int, shingle: int, max_rows: int) -> DataFrame:
    """``find`` of (id, text), with the ids ``_rid`` of the rows: those given, or else new ones."""
    if "_rid" not in texts.columns:
        texts = with_row_id(texts)
    wins = item_windows(items, item_col, item_text_col, window)
    uniq = (wins.select("win").distinct().withColumn("wid", F.xxhash64("win"))
            .withColumn("k", F.least(F.size("win"), F.lit(shingle))))
    sizes = sorted(r["k"] for r in uniq.select("k").distinct().collect())  # at most ``shingle`` values
    base = texts.select("_rid", "id", words(F.col("text")).alias("w"))
    if not sizes:
        return base.select("_rid", "id", F.size("w").cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
                           F.array().cast("array<struct<start:int,size:int>>").alias("hits"),
                           F.array().cast("array<string>").alias("items"), F.lit(False).alias("contaminated"))
    sh = window_shingles(uniq, sizes)
    # rarity of the benchmark's shingles over all documents
    freq = (doc_shingles(base.select("w"), sizes).select("h")
            .join(checked_broadcast(sh.select("h").distinct()), "h", "left_semi")
            .groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    # windows that hold a shingle no document holds can't occur; of the others the rarest is kept
    index = (sh.join(freq, "h", "left").groupBy("wid", "win")
             .agg(F.min(F.struct("n", "o", "h")).alias("r"), F.max(F.col("n").isNull()).alias("absent"))
             .where(~F.col("absent")).select("wid", "win", F.col("r.o").alias("o"), F.col("r.h").alias("h"))).checkpoint(eager=True)
    start, size = F.col("p") - F.col("o"), F.size("win")
    fits = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.col("wid").isNotNull() & F.when(fits, F.slice("w", F.greatest(start, F.lit(0)) + 1, size) == F.col("win"))
    at = F.when(same, F.struct(start.alias("start"), size.alias("size"))).alias("at")
    found = F.when(same, F.col("wid")).alias("wid")
    if index.limit(max_rows + 1).count() <= max_rows:
        d = doc_shingles(base.select("_rid", "id", "w"), sizes).withColumn("n_words", F.size("w")).join(F.broadcast(index), "h", "left")
        # beside the matches, a row of the first place, or of no place, stands for the text
        hit = d.select("_rid", "id", "n_words", "p", at, found).where(F.col("p").isNull() | (F.col("p") == 0) | F.col("at").isNotNull())
    else:
        path = f"{ensure_checkpoint_dir(texts.sparkSession).rstrip('/')}/decontam-{uuid.uuid4().hex}"
        base.select("_rid", "id", "w").write.parquet(path)  # row ids are fixed from here on
        stored = texts.sparkSession.read.parquet(path)
        cand = doc_shingles(stored.select("_rid", "w"), sizes).select("_rid", "p", "h").where("h is not null")
        cand = cand.join(index.select("h", "wid", "o", size.alias("size")), "h").where(F.col("p") >= F.col("o")).select("_rid", "p", "o", "wid").checkpoint(eager=True)
        full = stored.join(cand.select("_rid").distinct(), "_rid", "left_semi").select("_rid", "w", F.size("w").alias("n_words"))
        met = cand.join(full, "_rid").join(index.select("wid", "win"), "wid").select("_rid", at, found).where(F.col("at").isNotNull())
        rows = stored.select("_rid", "id", F.size("w").alias("n_words"))
        hit = rows.withColumns({"at": F.lit(None).cast("struct<start:int,size:int>"), "wid": F.lit(None).cast("long")}).unionByName(
            met.select("_rid", F.lit(None).cast(rows.schema["id"].dataType).alias("id"), F.lit(None).cast("int").alias("n_words"), "at", "wid"))
    per = hit.groupBy("_rid").agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"),
                                  F.array_sort(F.collect_set("at")).alias("hits"), F.collect_set("wid").alias("wids"))
    # names of the items: one row per distinct window of a document, its spans with the first
    owners = wins.select(F.col("item").cast("string").alias("item"), F.xxhash64("win").alias("wid"))
    per = per.select("_rid", "id", "n_words", "hits", F.posexplode_outer("wids").alias("pos", "wid"))
    per = per.withColumn("hits", F.when(F.coalesce("pos", F.lit(0)) == 0, F.col("hits")))
    out = (per.join(checked_broadcast(owners), "wid", "left").groupBy("_rid")
           .agg(F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.max("hits").alias("hits"),
                F.array_sort(F.collect_set("item")).alias("items")))
    return out.select("_rid", "id", F.col("n_words").cast("long").alias("n_words"),
                      covered(F.col("hits")).alias("n_hit"), "hits", "items", (F.size("hits") > 0).alias("contaminated"))


def covered(hits: Column) -> Column:
    """Words inside at least one of the sorted (start, size) spans."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(hits, zero, lambda a, x: F.struct(
        F.greatest(a["end"], x["start"] + x["size"]).alias("end"),
        (a["n"] + F.greatest(x["start"] + x["size"] - F.greatest(a["end"], x["start"]), F.lit(0))).alias("n")),
        lambda a: a["n"])


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
          max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``docs`` without the rows in which a window of an item occurs. The verdict is the row's own, so
    rows that share an id, or have none, don't go with one another; the rows are written to the
    shared folder first, which fixes their numbers."""
    spark = docs.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/decontam-rows-{uuid.uuid4().hex}"
    packed(docs, id=id_col, text=text_col).select("row", F.monotonically_increasing_id().alias("_rid")).write.parquet(path)
    stored = spark.read.parquet(path)
    texts = stored.select("_rid", F.col("row").getField(id_col).alias("id"), F.col("row").getField(text_col).alias("text"))
    bad = _found(texts, items, "item_id", "text", window, shingle, max_rows).where("contaminated").select("_rid")
    return stored.join(checked_broadcast(bad), "_rid", "left_anti").select("row.*")
