"""Connected components of a graph given as a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.llm._arrow import cut


def _is_star(edges: DataFrame) -> bool:
    """Whether each node has one link, to a node that has none of its own."""
    if not edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()


def _star(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with v the neighbours to move. Links each v, and u itself, to the least of u and its neighbours.

    The minima are written before the join, so that the neighbours of a node with very many of them can be split.
    """
    least = cut(pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
    moved = pairs.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v"), F.col("u").alias("c")), least


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b), any number of times and in any direction. Returns (node, root) for each linked node; root is the
    least node that it can reach. Each round moves the links once; rounds grow with the logarithm of the longest chain.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    while not _is_star(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        moved, _ = _star(both)
        edges = cut(moved.where("u > c").select("u", "v").where("u <> v").distinct())
        moved, least = _star(edges)
        edges = cut(moved.select("u", "v").unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
