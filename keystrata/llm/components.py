"""Connected components by alternating large-star and small-star rounds.

Every round is joins and minima over the edges; what it leaves is written to the shared folder, so a lost executor
costs one round. Rounds go on until the edges stand still; stars are reached in O(log^2 n) rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keystrata.llm.common import stash


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (comparable, not null) -> ``node, root``: the smallest node of each node's component.

    Only nodes on some edge between different nodes are returned; repeated edges and loops do no harm.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stash(e, "edges")
    before = _state(e)
    while before[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = stash(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        moved = large.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        e = stash(moved.union(least.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        now = _state(e)
        if now == before:
            break
        before = now
    nodes = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return nodes.union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
