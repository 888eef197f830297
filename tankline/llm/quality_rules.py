"""Quality rules: text statistics and a hashed n-gram log-likelihood ratio.

Two multinomials over ``buckets`` hashed word 1- and 2-grams are counted in one
aggregation: the trusted target (documents that the caller trusts) and the raw
corpus (all documents). A document's score is the mean of
``log(p_target / p_raw)`` over its n-grams, so it doesn't depend on length, and the
verdict is ``score >= min_llr``. ``min_llr`` is a low quantile of the trusted documents'
scores, so it moves with the corpus; for it an n-gram counts once less in the target,
because other clean documents haven't their own n-grams there. The model is one array
of ``buckets`` floats whatever the corpus holds; every document is scored where its
text is, so texts are neither shuffled nor collected.

Statistics: words, their code points, symbol characters, repeated lines, and words
inside 8-word windows that occur twice or more.

Defined cases: a null or empty text has no words, no n-grams, score 0 and fails the
base rule; repeated rows are judged one by one (and count as often as they occur);
other columns are ignored; with no trusted text every score is 0 and the base rule
decides alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tankline.llm.common import indices, let, tokens
from tankline.operators.joins import checked_broadcast
from tankline.session import ensure_checkpoint_dir

BUCKETS = 1 << 18    # the model is one array of this many floats (1 MB)
SMOOTHING = 81920 / BUCKETS     # counts added to every bucket, shared out by the raw distribution: a fixed total
LOW = 0.005          # the share of trusted documents below the threshold
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"


def _pairs(w: Column) -> Column:
    return F.transform(indices(F.size(w) - 1), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1)))


def _bucket(h: Column, buckets: int) -> Column:
    return F.pmod(h, F.lit(buckets)).cast("int")


def ngram_hashes(w: Column) -> Column:
    """64-bit hashes of the words and of the pairs of neighbouring words."""
    return F.concat(F.transform(w, lambda x: F.xxhash64(x)), _pairs(w))


def window_hashes(pairs: Column, n: Column, window: int = WINDOW) -> Column:
    """A 64-bit hash per window of ``window`` words, from those of the pairs of words."""
    if window % 2:
        raise ValueError("window must be even")
    return F.transform(indices(n - (window - 1)),
                       lambda i: F.xxhash64(*[F.get(pairs, i + k) for k in range(0, window, 2)]))


def with_repeated_words(d: DataFrame, heads: str, out: str, window: int = WINDOW) -> DataFrame:
    """Words inside windows that occur at least twice, from the column of window hashes. Only
    texts that repeat a window sort theirs. Steps are columns of their own, as Spark
    evaluates a nested lambda's inputs once per element."""
    keep = [c for c in d.columns if c != heads]
    d = d.withColumn("_srt", F.when(F.size(F.array_distinct(heads)) < F.size(heads), F.sort_array(
        F.transform(heads, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))

    def twin(e: Column, k: Column) -> Column:
        return F.coalesce(F.get("_srt", k - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(
            F.get("_srt", k + 1)["h"] == e["h"], F.lit(False))

    d = d.select(*keep, F.array_sort(F.transform(F.filter("_srt", twin), lambda e: e["i"])).alias("_at"))
    gaps = F.transform("_at", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("_at", k + 1) - p, F.lit(window))))
    total = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)
    return d.select(*keep, F.coalesce(total, F.lit(0)).alias(out))


def text_statistics(text: Column, w: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        # removed by a pattern: Spark's translate looks every character up as a string of its own
        "n_symbols": (F.length(t) - F.length(F.regexp_replace(t, f"[{SYMBOLS}]", ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    }


def fit_llr(docs: DataFrame, trusted_col: str, text_col: str = "text", buckets: int = BUCKETS,
            smoothing: float = SMOOTHING, low: float = LOW) -> DataFrame:
    """One row: ``llr``, the array of bucket log ratios, and ``min_llr``, the ``low`` quantile of
    the trusted documents' scores. All rows of ``docs`` are the raw corpus, those with a true
    ``trusted_col`` the target. The row is checkpointed, as both the threshold and the
    verdict read it."""
    ensure_checkpoint_dir(docs.sparkSession)
    good = F.coalesce(F.col(trusted_col), F.lit(False)).cast("long")
    counts = (docs.select(good.alias("good"), tokens(F.col(text_col)).alias("w"))
              .select("good", F.explode(ngram_hashes(F.col("w"))).alias("h"))
              .groupBy(_bucket(F.col("h"), buckets).alias("b"))
              .agg(F.count(F.lit(1)).alias("raw"), F.sum("good").alias("good")))
    # ``buckets`` rows from here on, whatever the corpus
    table = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left")
    cells = table.agg(F.sort_array(F.collect_list(F.struct(
        "b", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("good", F.lit(0)).alias("good")))).alias("c"),
        F.sum("raw").alias("r"), F.sum("good").alias("g"))
    n_raw, n_good = F.coalesce("r", F.lit(0)), F.coalesce("g", F.lit(0))
    weight = smoothing * buckets

    def ratio(c: Column, good: Column) -> Column:
        p_raw = (c["raw"] + 1.0) / (F.col("n_raw") + float(buckets))
        # the target is smoothed towards the raw distribution: no evidence means ratio 1
        return F.log((good + weight * p_raw) / (F.col("n_good") + weight) / p_raw)

    d = cells.withColumn("n_raw", n_raw).withColumn("n_good", n_good)
    model = d.select(F.transform("c", lambda c: ratio(c, c["good"])).cast("array<float>").alias("llr"),
                     F.transform("c", lambda c: ratio(c, F.greatest(c["good"] - 1, F.lit(0)))).cast("array<float>").alias("others"),
                     ).checkpoint(eager=True)
    trusted = docs.where(F.col(trusted_col)).select(tokens(F.col(text_col)).alias("w")).where(F.size("w") >= MIN_WORDS)
    scored = trusted.select("w", _pairs(F.col("w")).alias("pairs"), model.select("others").scalar().alias("m"))
    score = _llr_sum() / (2 * F.size("w") - 1)
    # rounded: the quantile is exact and its buffer a few thousand values, whatever the corpus
    least = scored.select(F.floor(score * 1000).alias("s")).agg((F.percentile("s", low) / 1000).alias("min_llr"))
    return model.crossJoin(least).select("llr", F.coalesce("min_llr", F.lit(float("-inf"))).alias("min_llr")).checkpoint(eager=True)


def _llr_sum() -> Column:
    """Sum over the n-grams of the columns w and pairs of the array in the column m. The array is
    a scalar put there right before: every projection with it copies it into each row."""
    def add(a: Column, h: Column) -> Column:
        return a + F.get("m", F.pmod(h, F.size("m")).cast("int"))

    return F.aggregate("pairs", F.aggregate("w", F.lit(0.0), lambda a, x: add(a, F.xxhash64(x))), add)


def judge(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, score (mean log ratio), kept and ``row``, the input row as a struct. ``model``
    comes from ``fit_llr``."""
    text = F.col("row").getField(text_col)
    # the model is a scalar: every task gets the one array, texts stay where they are
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), tokens(F.col(text_col)).alias("w"))
    d = d.select("row", "w", _pairs(F.col("w")).alias("pairs"), model.select("llr").scalar().alias("m"))
    stats = text_statistics(text, F.col("w"))
    d = d.select("row", *[c.alias(k) for k, c in stats.items()], _llr_sum().alias("llr_sum"),
                 window_hashes(F.col("pairs"), F.size("w")).alias("heads"))
    d = with_repeated_words(d, "heads", "n_repeat_words")
    n = F.col("n_words")
    grams = F.when(n > 0, 2 * n - 1)
    d = d.select(F.col("row").getField(id_col).alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 ((n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)).alias("base_failed"),
                 F.coalesce(F.col("llr_sum") / grams, F.lit(0.0)).alias("score"), "row")
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= model.select("min_llr").scalar()))
    # what a generator makes can't be filtered below it: callers' filters would else be pushed into the
    # statistics, each of which would be computed again for every use
    return d.select(F.explode(F.array(F.struct(*d.columns))).alias("_r")).select("_r.*")


def kept_rows(judged: DataFrame) -> DataFrame:
    """The kept input rows."""
    return judged.where("kept").select("row.*")


def trusted_flag(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 quality_col: str = "quality") -> DataFrame:
    """Id and text of ``docs`` with a boolean ``_trusted``: labelled, and good in every label row."""
    good = (labels.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.coalesce(quality_col, F.lit(0))).alias("_q"))
            .where(F.col("_q") == 1).select(F.col(id_col), F.lit(True).alias("_trusted")))
    known = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias(text_col))
    good = good.withColumnRenamed(id_col, "_good")
    return known.join(checked_broadcast(good), F.col("_id") == F.col("_good"), "left").drop("_good").withColumnRenamed("_id", id_col)
