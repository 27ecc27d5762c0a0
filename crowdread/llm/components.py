"""Connected components of links, by stars of minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from crowdread.llm.staging import release, staged


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of links (a, b); the component is its smallest node.

    Each round joins every node's larger neighbours, then its smaller ones, to its least neighbour;
    links shrink to stars in a number of rounds that grows with the logarithm of the longest path.
    Minima are partial aggregates and joins have one row per key on one side, so a node with many
    links is split by the adaptive skew join. Each round is written, which cuts the lineage.
    """
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u")
        out = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        new = staged(out.distinct(), "links")
        release(edges)
        edges = new
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
