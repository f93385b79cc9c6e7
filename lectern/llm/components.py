"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.storage import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Each round hangs larger neighbours, then smaller ones, below the smallest
    neighbour of a node, until only stars are left; rounds are logarithmic in the
    length of paths, and each is written to the shared folder. No node's neighbours are gathered: minima are
    aggregated before the shuffle and joined back, so a hub is split like any
    skewed join. Loops and rows with a null end link nothing.
    """
    both = edges.select("a", "b").where("a != b")
    edges = stored(both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _only_stars(edges):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        around = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = around.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b")
        large = stored(large, "large-star")
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where("a != b").distinct(), "small-star")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, or is one: then that neighbour is its component."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).alias("to")))
    node = ends.groupBy("node").agg(F.min("to").alias("lo"), F.max("to").alias("hi"), F.bool_or(F.col("to").isNull()).alias("under"))
    return not node.where("lo <> hi OR (lo IS NOT NULL AND under)").limit(1).count()
