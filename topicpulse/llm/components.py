"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of ``links(a, b)``; root is the component's smallest node.

    Each step replaces links by links to the smallest neighbour and is written to
    the shared folder, so that plans stay short and lost executors cost one step.
    The number of steps grows with the logarithm of the longest path; nothing but
    one row with a count and a checksum comes to the driver. Links with a null end
    and links of a node to itself say nothing and are left out; repeated links
    count once. No links: an empty result.
    """
    edges = written(links.where("a is not null and b is not null and a <> b")
                    .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        # large star: every larger neighbour of a node is tied to the smallest neighbour
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: a node and its smaller neighbours are tied to the smallest of them
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
