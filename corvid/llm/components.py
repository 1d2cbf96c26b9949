"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _both(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node with a link; the label is the smallest node of its component.

    Links are (a, b), without NULLs.  Each round hangs a node's larger
    neighbours on its smallest one (large star), then its smaller ones (small
    star), until the links are stars; the number of rounds grows with the
    logarithm of the longest chain.  Per-node minima are combined before the
    shuffle and the joins are left to skew splitting, so a node with many
    links is no hot key.  Every round is checkpointed.
    """
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().checkpoint()
    while True:
        both = _both(links)
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # Small star: every node's smaller neighbours, and the node, hang on the smallest.
        low = large.select(F.col("b").alias("node"), F.col("a").alias("n"))
        least = low.groupBy("node").agg(F.min("n").alias("m"))
        small = (low.join(least, "node").select(F.col("m").alias("a"), F.col("n").alias("b"))
                 .unionAll(least.select(F.col("m").alias("a"), F.col("node").alias("b"))).where("a <> b").distinct())
        next_links = small.checkpoint()
        same = [x.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for x in (links, next_links)]
        links = next_links
        if same[0] == same[1]:
            break
    return links.select(F.col("b").alias("node"), F.col("a").alias("label")).unionAll(
        links.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
