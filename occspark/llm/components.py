"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import remove, small, stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, of one orderable type), from a table in the shared folder.

    root is the smallest node that can be reached. Each round hangs every node below the
    smallest node of its neighbourhood, first over larger, then over smaller neighbours,
    until the edges are one star per component. Tables between steps are written to the
    shared folder and deleted when the next is whole. Self-loops and repeated edges don't
    matter; no edges give no rows.
    """
    current = stored(_tidy(edges.select("a", "b")), "edges")
    for _ in range(max_rounds):
        # tables of least neighbours are stored, so that a node with very many neighbours can be split in the join
        least = stored(_least(_both_ways(current)), "least")
        # stars: a node that isn't the least of its neighbourhood has no neighbour but that
        if least.where("m < a and n > 1").isEmpty():
            remove(current)
            return least.select(F.col("a").alias("node"), F.col("m").alias("root"))
        larger = stored(_both_ways(current).join(small(least.select("a", "m")), "a").where("b > a").select(F.col("m").alias("a"), "b"), "larger")
        remove(current)
        remove(least)
        # after a large star a node has few smaller neighbours; it and they go below the least of them
        up = larger.select(F.col("b").alias("a"), F.col("a").alias("b"))
        least = stored(_least(up).select("a", "m"), "least")
        hung = up.join(small(least), "a").where("b <> m").select(F.col("m").alias("a"), "b")
        current = stored(_tidy(hung.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b")))), "edges")
        remove(larger)
        remove(least)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _tidy(edges: DataFrame) -> DataFrame:
    """Distinct edges with a < b."""
    return edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(around: DataFrame) -> DataFrame:
    """(a, m, n): the least of a node and its neighbours, and how many neighbours there are."""
    return around.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n"))
