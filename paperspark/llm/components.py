"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperspark.llm.common import staged


def is_star_forest(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and no smaller end is a larger
    one elsewhere: then each component is a star around its least node."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not nodes.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).limit(1).count()


def large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # Staged, so that the join shuffles both sides and can split a hot node.
    least = staged(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(
        F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Link a node (the larger end) and its smaller neighbours to the least
    of them."""
    least = staged(edges.groupBy("a").agg(F.min("b").alias("m")), "least")
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges(a, b)``: the least node
    reachable. A node without an edge to another one is not listed."""
    edges = staged(edges.where("a != b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not is_star_forest(edges):
        # Both steps keep the larger end first.
        edges = staged(small_star(staged(large_star(edges), "edges")), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
