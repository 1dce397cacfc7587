"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """One step: hang neighbours (greater ones, or smaller ones and itself) on the least of all."""
    turned = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    near = links.unionByName(turned) if large else links
    least = near.groupBy("a").agg(F.min("b").alias("_least"))
    # A table, so that the join can split the partition of a node with very many links.
    least = written(least.withColumn("_least", F.least("_least", "a")), "least")
    hung = near.join(least, "a")
    if large:
        moved = hung.filter("b > a").select(F.col("b").alias("a"), F.col("_least").alias("b"))
    else:
        moved = hung.select(F.col("b").alias("a"), F.col("_least").alias("b")).unionByName(
            least.select("a", F.col("_least").alias("b")))
    return moved.filter("a != b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; a component is its least node.

    Each step is written to the shared folder, so a lost executor repeats one step at most. Only
    a count and a checksum reach the driver. Loops and repeated links do no harm.
    """
    a, b = F.greatest("a", "b"), F.least("a", "b")
    now = written(links.select(a.alias("a"), b.alias("b")).filter("a != b").distinct(), "links")
    before = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        now = written(_stars(_stars(now, True), False), "links")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component"))
                             .distinct())
