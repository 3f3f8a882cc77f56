"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node of the node's neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a AND b <> m").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Edges come as a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    down = edges.join(least, "b").filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return down.union(least.select(F.col("m").alias("a"), "b")).distinct()


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node that can be reached.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs one round. Groups
    are only reduced with min(), which combines on the map side; a node with very many edges is a skewed join
    key, which adaptive execution splits. The number of rounds grows with the logarithm of the longest path.
    """
    current = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).filter("a <> b").distinct()
    current, seen = materialize(current, "edges"), None
    while True:
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        following = materialize(_small_star(_large_star(current)), "edges")
        discard(current)
        current = following
    return current.select(F.col("b").alias("node"), F.col("a").alias("root")).union(current.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
