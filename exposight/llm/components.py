"""Connected components of a set of links, by rounds of joins.

Each round first ties every node's larger neighbours to its smallest one, then its smaller neighbours; the links
shrink to stars around the smallest node of each component in a logarithmic number of rounds. The smallest
neighbours are written before they are joined, so the optimizer may split the join at a node with many links, and
each round is written, so a lost executor costs a re-read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposight.session import materialise


def _tied(links: DataFrame) -> DataFrame:
    """``links`` (a > b, distinct) with larger neighbours tied to the smallest, then smaller ones."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    least = materialise(least, "components-least")
    large = links.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
    large = large.select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    large = materialise(large.where("a > b"), "components-large")
    least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "components-least")
    small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b")
    small = small.unionByName(least.select("a", F.col("m").alias("b")))
    return small.distinct()


def components(links: DataFrame) -> DataFrame:
    """``a, b`` (any order, repeats and loops allowed, nulls ignored) → ``node, component``, the smallest node
    reachable, for each node with a link to another one."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    pairs = materialise(pairs.distinct(), "components")
    mark = None
    while True:
        # Stars: no smaller end is a larger end elsewhere, and no node has two centres.
        now = pairs.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == mark or now["n"] == 0:
            break
        mark = now
        pairs = materialise(_tied(pairs), "components")
    stars = pairs.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
