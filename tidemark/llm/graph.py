"""Connected components of an undirected edge table by alternating large-star and small-star steps.

Each step is an aggregation (least neighbour, combined map-side) and an equi-join, so no neighbourhood is ever gathered. Only nodes that a step
moves are joined: a node that is the least of its neighbours keeps its edges as they are, and one with a single smaller neighbour has nothing to pass
on. So the roots of large components, whose edges are many, are no keys of the joins' small sides, which Spark then sends to the edges
instead of dealing these by key. Each step is cut by a reliable checkpoint, as its edges are read more than once. The number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut

#: Partitions that the edges of a round are read in: one for so many edges, but some at least.
PART_ROWS, LEAST_PARTS = 50_000, 8


def _large_star(edges: DataFrame) -> DataFrame:
    """Edges u > v: each larger neighbour of a node goes to the node's least neighbour."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    moved = both.groupBy("u").agg(F.min("v").alias("m")).filter("m < u").select(F.col("u").alias("_v"), "m")
    return edges.join(moved, F.col("v") == F.col("_v"), "left").select("u", F.coalesce("m", "v").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges u > v: each smaller neighbour of a node, and the node, go to its least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
    several = least.filter("m < most").select(F.col("u").alias("_u"), "m")
    moved = edges.join(several, F.col("u") == F.col("_u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _size_and_tangled(edges: DataFrame) -> tuple[int, int]:
    """How many edges u > v there are, and how many nodes keep them from being stars: those with several edges upwards, or one and others downwards."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if(F.expr("up > 1 or up = 1 and down > 0"))).first()


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of ``edges`` (u, v) but the roots themselves."""
    now = cut(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        rows, tangled = _size_and_tangled(now)
        if not tangled:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now = now.coalesce(max(LEAST_PARTS, rows // PART_ROWS))  # it is read five times, so a few edges in many partitions would be many tasks
        now = cut(_small_star(cut(_large_star(now).distinct())).filter("u <> v").distinct())
