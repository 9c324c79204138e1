"""Connected components of links between ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in a link (a, b); root is the smallest id that can be reached.

    Large star: every larger neighbour of a node goes to the node's smallest neighbour; small star:
    a node and its smaller neighbours go to the smallest of these. Minima are taken by groupBy, with
    partial results on the map side, so a node with very many links is no burden; no set of
    neighbours is ever gathered. The number of rounds grows with the logarithm of the longest path.
    """
    edges = settle(_ordered(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _ordered(edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("v")))
        first = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _ordered(large.join(first, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(first.select("u", F.col("m").alias("v"))))
        edges = settle(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct links with the larger id first, without loops."""
    return edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
