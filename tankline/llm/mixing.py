"""Mixing sources to target weights along a time-varying curriculum.

Targets: the sources, in code-point order with null last, weigh 3, 1, 2, 3, 1, 2, ...
and share ``share`` times all words; a source gives at most ``max_epochs`` times its
words, and what it can't give is shared again by weight until no target is above its
bound. That is water-filling: ``target = min(bound, level * weight)``.

Curriculum: source ``s`` is drawn at time ``t`` in [0, 1] with the rate
``target_s * (1 + slope_s * (2 t - 1))``, so its demand up to ``t`` integrates to
``target_s * (t + slope_s * (t^2 - t))`` and the whole run consumes its target. A
document copy whose words start at ``c`` in its source's stream (hash order, one pass
after the other) is trained at the inverse of that integral at ``c``; documents are
range-sorted by this position.

A copy is taken if its middle lies before the target, so each source ends within half
a document of it and a document is taken ``max_epochs`` times at most. Running sums
per source come from sums over hash slices (one row per source and slice) plus a
window inside a slice, so a source with a third of all rows is spread over the slices.

Defined cases: null source is a source of its own; a null or empty text has size 0
and is taken 0 words; repeated rows are separate documents, in arbitrary but equal
order; other columns are ignored by ``plan`` and kept by ``stream``; empty tables
give no rows. Reruns agree: order and targets depend on the rows alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tankline.llm.common import TOKEN
from tankline.session import ensure_checkpoint_dir

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_EPOCHS = 2
SLICES = 1 << 12
#: Slope of the weight schedules, by the source's rank: early, even, late.
SLOPES = (-0.5, 0.0, 0.5)


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """From (source, source_size), one row per source: adds rank, weight and target. The
    windows without partition run over this table only."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("rank", F.row_number().over(by_name) - 1)
    wts = F.array(*[F.lit(w) for w in weights])
    s = s.withColumn("weight", F.get(wts, F.pmod("rank", F.lit(len(weights))).cast("int")).cast("long"))
    s = s.withColumn("bound", F.col("source_size") * max_epochs)
    # sources in the order in which they reach their bound as the level rises
    fill = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(whole) * share - F.coalesce(F.sum("bound").over(before), F.lit(0))
    s = s.withColumn("level", left / F.sum("weight").over(rest))
    s = s.withColumn("open", F.col("bound") > F.col("level") * F.col("weight"))
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("level", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(every))
    target = F.least(F.col("bound").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("bound").cast("double")))
    return s.select("source", "source_size", "rank", "weight", target.alias("target"))


def position(at: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's integrated demand reaches ``at`` words."""
    f = F.least(F.greatest(at / target, F.lit(0.0)), F.lit(1.0))
    root = F.sqrt((1 - slope) * (1 - slope) + 4 * slope * f)
    return F.when(slope == 0, f).otherwise((root - (1 - slope)) / (2 * slope))


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, keep: list[str]) -> DataFrame:
    key = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), n_words(F.col(text_col)).alias("_size"),
                       key.alias("_key"), F.conv(F.substring(key, 1, 3), 16, 10).cast("int").alias("_slice"),
                       *[F.col(c) for c in keep])


def with_plan(d: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: int = MAX_EPOCHS, slopes=SLOPES) -> DataFrame:
    """Rows of ``sized`` with source_size, target, copies, taken and positions (array, one
    per copy taken)."""
    cells = d.groupBy("_source", "_slice").agg(F.sum("_size").alias("n"))
    up_to = Window.partitionBy("_source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_source", "_slice", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("_before"))
    sizes = d.groupBy("_source").agg(F.sum("_size").alias("source_size")).withColumnRenamed("_source", "source")
    t = source_targets(sizes, weights, share, max_epochs)
    # at most SLICES rows per source: small beside the documents, joined by shuffle unless Spark finds it small
    cells = cells.join(t, cells["_source"].eqNullSafe(t["source"])).drop("_source")
    inside = Window.partitionBy("_source", "_slice").orderBy("_key", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    c = cells.withColumnRenamed("_slice", "_cslice")
    d = d.join(c, d["_source"].eqNullSafe(c["source"]) & (d["_slice"] == c["_cslice"])).drop("source", "_cslice")
    start = F.col("_before") + F.col("_in")
    slope = F.get(F.array(*[F.lit(float(x)) for x in slopes]), F.pmod("rank", F.lit(len(slopes))).cast("int"))
    starts = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_epochs - 1)), lambda e: start + e * F.col("source_size")),
                      lambda x: 2 * x + F.col("_size") < 2 * F.col("target"))
    d = d.withColumn("_starts", F.when(F.col("_size") > 0, starts).otherwise(F.array().cast("array<bigint>")))
    return (d.withColumn("copies", F.size("_starts")).withColumn("taken", F.col("copies") * F.col("_size"))
            .withColumn("positions", F.transform("_starts", lambda x: position(x, F.col("target"), slope)))
            .drop("_starts", "_in", "_before"))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: id, size, source, source_size, target, copies, taken, position (of
    the first copy; null if not taken), positions; range-sorted by position, untaken rows last.
    Texts are read once: the narrow rows are checkpointed."""
    ensure_checkpoint_dir(docs.sparkSession)
    d = sized(docs, id_col, text_col, source_col, []).checkpoint(eager=True)
    d = with_plan(d, **how)
    return d.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source").alias(source_col), "source_size",
                    "target", "copies", F.col("taken").cast("long").alias("taken"),
                    F.get("positions", F.lit(0)).alias("position"), "positions").orderBy(
                        F.col("position").asc_nulls_last(), F.col(id_col))


def stream(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The training stream: one row per copy taken with the document's columns and
    ``_position``, range-sorted by it."""
    names = [f"_c{i}" for i in range(len(docs.columns))]
    kept = docs.toDF(*names)
    at = {c: n for n, c in zip(names, docs.columns)}
    d = with_plan(sized(kept, at[id_col], at[text_col], at[source_col], names), **how)
    out = d.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], F.explode("positions").alias("_position"))
    return out.repartitionByRange("_position").sortWithinPartitions("_position")
