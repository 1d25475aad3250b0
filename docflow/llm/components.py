"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour (or the node)."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least.withColumnRenamed("a", "x"), F.col("a") == F.col("x")).filter("b > a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them. ``a`` is the larger."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "x")
    joined = edges.join(least, F.col("a") == F.col("x"))
    down = joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return down.union(least.select(F.col("x").alias("a"), F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for each node of the links ``a, b``; root is the component's smallest node.

    Every round's links are written to the shared folder; the number of rounds grows with the
    logarithm of the longest path. Nothing is collected but counts and a checksum.
    """
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stored(ordered, "links")
    before = digest(now)
    while before[0]:
        new = stored(small_star(large_star(now)), "links", parts=1 + before[0] // 250_000)  # never more links than before
        after = digest(new)
        discard(now)
        now = new
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
