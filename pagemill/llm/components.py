"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (node, root): every linked node with the smallest node of its component.

    Each step sends every neighbour of a node to the smallest one; after O(log^2 n) steps all links are stars around
    their roots. Both steps aggregate by node before they join, and the join splits hot nodes. Steps are cut by
    checkpoints in the shared folder. Nulls and self-links are dropped; an empty table gives an empty one.
    """
    shared_dir(links.sparkSession)
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    before = None
    while True:
        # Minima are checkpointed before they are joined, so that both sides of a join are plain shuffles and hot nodes are split.
        both = pairs.select("u", "v").union(pairs.select(F.col("v"), F.col("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")).checkpoint()
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().checkpoint()
        least = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        pairs = small.where("u <> v").distinct().checkpoint()
        state = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    return pairs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("root")).union(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
