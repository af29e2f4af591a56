"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footmark.llm.common import drop_staged, staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edge table (u, v), root being the smallest node reachable.

    Nodes may be of any orderable type. Self-links and repeated links change nothing; nodes without a
    link are absent. Each round is a written table, so a lost executor costs only its tasks. A hub with
    very many links meets only aggregates and joins, never one group in one task.
    """
    edges = staged(edges.where(F.col("u") != F.col("v")).select("u", "v").distinct(), "links")
    state = _state(edges)
    while True:
        stars = staged(_small_star(_large_star(edges)), "stars")
        seen = _state(stars)
        drop_staged(edges)
        if seen == state:
            break
        edges, state = stars, seen
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(stars.select("v", "v").distinct())
