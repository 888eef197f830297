"""Connected components of an edge table by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond"). Every step is a group
minimum and a join; no neighbour list is ever collected, so a hub with a third of all
edges is pre-aggregated like any other key. Each round is checkpointed. At most ``FINISH``
edges (they are counted) are joined by one task instead: their rounds, a dozen small jobs
each, cost the driver more memory for plans than the edges take.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tankline.operators.components import FINISH, joined
from tankline.session import ensure_checkpoint_dir


def _star(arcs: DataFrame, towards: DataFrame) -> DataFrame:
    """Link the far end of every arc (u, v) to the smallest neighbour of u (or u)."""
    low = arcs.groupBy("u").agg(F.min("v").alias("m"))
    low = low.select("u", F.least("u", "m").alias("m"))
    return towards.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, finish: int = FINISH) -> DataFrame:
    """(node, root) for every node of an edge; root is the smallest node of its component."""
    ensure_checkpoint_dir(edges.sparkSession)
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct().checkpoint(eager=True)
    if e.limit(finish + 1).count() <= finish:
        up = joined(e)
        first = up.groupBy("up").agg(F.min("node").alias("root"))
        return up.join(first, "up").select("node", "root").checkpoint(eager=True)
    state = None
    for _ in range(max_rounds):
        # large star: neighbours above u go to the smallest neighbour
        arcs = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        e = _star(arcs, arcs.where("v > u")).distinct()
        # small star: neighbours below u, and u itself, go to the smallest of them
        down = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        own = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("a"), F.col("m").alias("b"))
        e = _star(down, down).unionByName(own).distinct().checkpoint(eager=True)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
