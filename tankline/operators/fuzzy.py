"""Fuzzy name consolidation (JN-13, FN-9, PP-3, JN-10).

Similarity of two names is ``100 * (1 - lev(a, b) / max(len))`` on normalised
text; two names are similar when it reaches ``threshold``, i.e. when
``lev <= k(L) = floor(L * (100 - threshold) / 100)`` for the longer length L.

The similarity self-join is exact and never compares all pairs: by the
pigeonhole principle, if lev(s, r) <= k then at least two of k+2 disjoint segments of
the longer string s occur unchanged in r, each shifted by at most k positions and in
order. Every string emits the pairs of its k+2 segments (as the longer side) and, for
each admissible longer length L, the pairs of substrings near those positions (as the
shorter side); candidates meet in an equi-join on (L, segments, both texts) and are
verified with ``levenshtein``. A word that a third of the names share fills one segment;
the other one keeps such names apart. Rows per string grow with k^4, which is small
for names (k <= 2 up to 59 characters at threshold 95).

Representatives: when names are processed in first-appearance order and each
maps its similar names to itself, the last writer wins, so a name's
representative is the candidate with the latest first appearance among the name
and its similar names (``max_by`` on the rank) -- an aggregate, no pair loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.functions import expr as X
from tankline.operators.components import connected_components
from tankline.operators.joins import attach


def _k(length, threshold: float):
    """Largest edit distance still similar for a longer length L (exact integer test)."""
    return F.floor(length * F.lit(100.0 - threshold) / F.lit(100.0) + F.lit(1e-9)).cast("int")


def _segment(L, nseg, i):
    """Start (0-based) and length of segment ``i`` when length L is cut into ``nseg``."""
    base = F.floor(L / nseg).cast("int")
    plain = nseg - (L - base * nseg)  # segments without an extra character
    return i * base + F.greatest(F.lit(0), i - plain), base + F.when(i >= plain, 1).otherwise(0)


def similar_pairs(strings: DataFrame, col: str = "norm", threshold: float = 95.0) -> DataFrame:
    """Distinct string pairs (a < b) with similarity >= threshold (exact)."""
    s = strings.select(F.col(col).alias("s")).where(F.col("s").isNotNull() & (F.length("s") > 0)).distinct()
    s = s.withColumn("L", F.length("s")).withColumn("k", _k(F.col("L"), threshold))
    nseg = F.col("k") + 2
    pairs_of = F.flatten(F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.transform(
        F.sequence(i + 1, F.col("k") + 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))

    def with_segments(df: DataFrame) -> DataFrame:
        df = df.withColumn("ij", F.explode(pairs_of))
        (si, ni), (sj, nj) = (_segment(F.col("L"), nseg, F.col(f"ij.{x}")) for x in "ij")
        return df.select("*", si.alias("si"), ni.alias("ni"), sj.alias("sj"), nj.alias("nj"))

    # long side: every two of the k+2 segments of each string
    seg = with_segments(s).select(F.col("s").alias("a"), "L", "ij", F.substring("s", F.col("si") + 1, F.col("ni")).alias("x"),
                                  F.substring("s", F.col("sj") + 1, F.col("nj")).alias("y"))
    # short side: for each admissible longer length L, substrings near both segments' starts
    maxL = F.floor(F.col("L") * F.lit(100.0) / F.lit(max(threshold, 1e-9)) + F.lit(1e-9)).cast("int")
    p = s.select(F.col("s").alias("b"), F.col("L").alias("len_b"),
                 F.explode(F.sequence(F.col("L"), F.greatest(F.col("L"), maxL))).alias("L"))
    p = p.withColumn("k", _k(F.col("L"), threshold)).where(F.col("L") - F.col("len_b") <= F.col("k"))
    p = with_segments(p)

    def shifts(n: str):  # an empty segment is intact wherever it stands
        return F.when(F.col(n) > 0, F.sequence(-F.col("k"), F.col("k"))).otherwise(F.array(F.lit(0)))

    p = p.withColumn("di", F.explode(shifts("ni"))).withColumn("dj", F.explode(shifts("nj")))
    p = p.withColumn("qi", F.col("si") + F.col("di")).withColumn("qj", F.col("sj") + F.col("dj"))
    ok = [(F.col(n) == 0) | ((F.col(q) >= 0) & (F.col(q) + F.col(n) <= F.col("len_b"))) for q, n in (("qi", "ni"), ("qj", "nj"))]
    together = (F.col("ni") == 0) | (F.col("nj") == 0) | (
        (F.abs(F.col("di") - F.col("dj")) <= F.col("k")) & (F.col("qi") + F.col("ni") <= F.col("qj")))  # edits between them

    def piece(q: str, n: str):
        return F.when(F.col(n) > 0, F.substring("b", F.col(q) + 1, F.col(n))).otherwise(F.lit(""))

    p = p.where(ok[0] & ok[1] & together).select("b", "L", "ij", piece("qi", "ni").alias("x"), piece("qj", "nj").alias("y"))
    cand = seg.join(p, ["L", "ij", "x", "y"]).where(F.col("a") != F.col("b")).select("a", "b").distinct()
    lev = F.levenshtein("a", "b")
    longest = F.greatest(F.length("a"), F.length("b"))
    ok = F.lit(100.0) * lev <= F.lit(100.0 - threshold) * longest
    pairs = cand.where(ok).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.withColumn("score", X.similarity_ratio("a", "b"))


def name_groups(df: DataFrame, name: str, order: str, threshold: float = 95.0) -> DataFrame:
    """PP-3, transitive: names that a chain of similar names connects are one group; its
    representative is the name with the latest first appearance. Names that normalise to
    the same text are one node, so a group may be as long as the chain. Output: name,
    representative, first_seen, group_size (distinct names)."""
    names = (df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("name")).agg(F.min(order).alias("first_seen"))
             .withColumn("norm", X.normalise_text("name")))
    root = connected_components(similar_pairs(names, "norm", threshold), names.select("norm"))
    named = attach(names, root.withColumnRenamed("node", "norm"), "norm", "inner")
    best = named.groupBy("root").agg(F.max_by("name", F.struct("first_seen", "name")).alias("representative"),
                                     F.count(F.lit(1)).alias("group_size"))
    return attach(named, best, "root", "inner").select("name", "representative", "first_seen", "group_size")


def consolidate_names(df: DataFrame, name: str, order: str, threshold: float = 95.0,
                      strict_reference: bool = False, mode: str = "one_hop") -> DataFrame:
    """PP-3: map every distinct non-null name to its representative. ``mode="components"``
    follows chains of similar names instead (``name_groups``).

    ``order`` gives first appearance (smallest value first). Names that normalise
    to the same text score 100; by default they are merged too (the reference's
    'exact match' filter drops them: ``strict_reference=True``).
    Output: name, representative, first_seen.
    """
    if mode == "components":
        return name_groups(df, name, order, threshold).drop("group_size")
    if mode != "one_hop":
        raise ValueError(mode)
    names = (df.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(order).alias("first_seen"))
             .withColumn("norm", X.normalise_text(name)))
    # best (latest first appearance) raw name per normalised text
    best = names.groupBy("norm").agg(F.max_by(name, F.struct("first_seen", name)).alias("best"),
                                     F.max(F.struct("first_seen", name)).alias("best_key"))
    pairs = similar_pairs(names, "norm", threshold)
    sym = pairs.select(F.col("a").alias("norm"), F.col("b").alias("other")).unionByName(
        pairs.select(F.col("b").alias("norm"), F.col("a").alias("other")))
    via_other = (sym.join(best.select(F.col("norm").alias("other"), "best", "best_key"), "other")
                 .groupBy("norm").agg(F.max_by("best", "best_key").alias("o_best"), F.max("best_key").alias("o_key")))
    j = names.join(via_other, "norm", "left")
    if not strict_reference:
        j = j.join(best, "norm", "left")
        own_key, own = F.col("best_key"), F.col("best")
    else:
        own_key, own = F.struct("first_seen", name), F.col(name)
    rep = F.when(F.col("o_key").isNotNull() & (F.col("o_key") > own_key), F.col("o_best")).otherwise(own)
    return j.select(F.col(name).alias("name"), rep.alias("representative"), "first_seen")


def replace_names(df: DataFrame, col: str, names_map: DataFrame) -> DataFrame:
    """JN-10: map lookup with fallback to the name itself."""
    m = names_map.select(F.col("name").alias("_n"), F.col("representative").alias("_r"))
    j = df.join(m, df[col] == m["_n"], "left")
    return j.withColumn(col, F.coalesce(F.col("_r"), F.col(col))).drop("_n", "_r")
