"""Connected components of a link table, by Spark joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlens.llm.common import landed


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has a link: columns node, root.

    Alternating contraction: every node hooks its larger neighbours, then its smaller ones, to the smallest neighbour, until each
    link points at a root.  Rounds follow the logarithm of the longest path.  Each round's links are landed in the shared folder.
    A node with many links is first reduced on the map side (minimum per node), and joined adaptively.
    """
    edges, before = landed(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links"), None
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour, itself included
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = landed(large.filter("u <> v").distinct(), "links")
        # small star: a node and its smaller neighbours move to the smallest of those
        joined = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = landed(small.filter("u <> v").distinct(), "links")
        mark = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if mark == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark
