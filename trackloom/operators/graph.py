"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import forget, stow


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) with an edge to another: component is the smallest node reachable.

    Large and small stars in turn, until nothing changes: each node gives its larger neighbours, then its smaller ones, to
    the least node about it. Chains shrink by halves, so a few rounds do (about log2 of the longest chain), and there is no limit to them. Tables are written to the shared
    folder after each step; only a count and a hash of the edges reach the driver.
    """
    now = stow(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while (mark := _mark(now)) != before:
        before = mark
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stow(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")  # written: a node with very many neighbours can be split in the join
        large = stow(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(down.select("a", F.col("m").alias("b")))
        after = stow(small.distinct(), "edges")
        forget(now, least, large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
