"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a minimum per node and a join, written to the shared folder; links never reach the driver. A node's links are
combined before the shuffle, and a node with very many links is one skewed join key, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamis.llm.store import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a, b); the component is its smallest node."""
    spark = links.sparkSession
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), larger_only=True)
        small = stored(_star(large, larger_only=False), "links")
        now = small.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, edges)
        edges = small
        if now == before:
            break
        before = now
    # at the fixed point every node points at its component's smallest
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)


def _star(links: DataFrame, larger_only: bool) -> DataFrame:
    """Large star: every larger neighbour of a node is linked to the smallest of the node and its neighbours. Small star:
    likewise for the node itself and its smaller neighbours (``links`` then lead from larger to smaller)."""
    least = links.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    joined = links.join(least, "a")
    if larger_only:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = out.unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()
