"""Connected components of links by alternating star steps, wholly in joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (a, b); root is the component's smallest node.

    Each round attaches every larger neighbour of a node to the smallest neighbour, then every smaller one; the
    links shrink to stars at the roots in a few rounds. Links are written each round, so lineage stays short.
    """
    links = staged(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").unionByName(down.select("a", F.col("m").alias("b")))
        links = staged(small.distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == before:
            break
        before = now
    own = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return own.unionByName(own.select(F.col("root").alias("node"), "root")).groupBy("node").agg(F.min("root").alias("root"))
