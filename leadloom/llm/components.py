"""Connected components of a graph of links by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from leadloom.session import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of every node of ``links (a, b)``; the component is its smallest node.

    The links are redirected until every node hangs from its component's smallest node, which takes a number
    of rounds that grows with the logarithm of the longest path. Each round is written to the shared folder,
    so lost executors cost one round at most. Minima combine before the shuffle; a node with very many links
    is split by adaptive skew joins. Starts jobs while it builds.
    """
    edges = stage(links.where("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        # Large star: larger neighbours hang from the smallest node around.
        large = both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        # Small star: a node and its smaller neighbours hang from the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
