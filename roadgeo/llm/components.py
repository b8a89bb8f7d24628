"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadgeo.llm.common import discard, staged


def components(links: DataFrame) -> DataFrame:
    """node and component, its smallest reachable node, for every node of the links (a, b).

    Each round points all larger neighbours of a node at its smallest one, and then all smaller ones. Rounds grow with
    the logarithm of the longest path; a node with very many neighbours is a key of plain joins and sums, which Spark
    splits. Every round is written, so that a lost executor costs one round at most, and removed when the next one is."""
    edges = staged(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a <> b").distinct()
        large = staged(large, "large-stars")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        new = staged(small.where("a <> b").distinct(), "small-stars")
        if new.exceptAll(edges).isEmpty() and edges.exceptAll(new).isEmpty():
            found = staged(new.select(F.col("a").alias("node"), F.col("b").alias("component")).union(new.select("b", "b").distinct()), "components")
            discard(edges, large, new)
            return found
        discard(edges, large)
        edges = new
