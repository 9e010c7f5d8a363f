"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaylens.llm.common import materialise


def smallest_reachable(links: DataFrame) -> DataFrame:
    """node, label for every node with a link: the smallest node that it reaches. links: columns a, b.

    Each round writes its links to the shared folder; the loop ends when every node has one link, to the smallest it reaches,
    after a number of rounds that grows with the logarithm of the longest path.
    """
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _settled(edges):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        joined = large.join(least, F.col("a") == F.col("n"))
        small = joined.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b").unionByName(joined.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def _settled(edges: DataFrame) -> bool:
    """True if the links are stars around their smallest nodes: a node has one link to a smaller node, or any number to greater ones."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("up")))
    ends = ends.groupBy("n").agg(F.sum("up").alias("up"), F.count("*").alias("all"))
    return ends.where("up > 1 or up = 1 and all > 1").isEmpty()
