"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import written


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): component is the smallest node reachable.

    Alternating large and small stars: each round hangs the larger neighbours of a node, then
    the smaller ones, below the smallest neighbour.  Rounds grow with the logarithm of the
    longest path.  Links stay in tables; only a count and a checksum reach the driver.
    """
    edges = written(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    before = None
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("v") % 1000003)).first()
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
