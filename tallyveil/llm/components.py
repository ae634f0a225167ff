"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, settle


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())


def connected(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links(a, b); root is the smallest node of the component.

    Nodes are longs. Each step takes the minimum of a node's neighbours by a partial aggregate, writes that table, and
    joins it back, so that Spark can split a node with very many links. Steps grow with the logarithm of the size.
    """
    edges = settle(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    before = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-large")
        large = settle(both.where("v > u").join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-edges")
        low = settle(large.groupBy("u").agg(F.min("v").alias("m")), "cc-small")
        near = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = settle(near.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "cc-edges")
        discard(edges, least, large, low)
        edges, after = small, _state(small)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
