"""Connected components of a link table, by alternating large and small stars.

Both steps are joins and aggregations over the links, so nothing of the graph comes to
the driver but two numbers an iteration, which tell whether the links still change.
Each iteration is written to the shared folder, which cuts its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.llm import shared


def _same(a: str, b: str) -> Column:
    """a = b, in a form by which neither side is partitioned yet.

    A side that was just aggregated by its key would be joined where it is, and Spark splits a partition
    of many links of one node only if both sides are shuffled for the join.
    """
    return F.col(a).bitwiseXOR(F.lit(1)) == F.col(b).bitwiseXOR(F.lit(1))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the node's smallest neighbour (or itself)."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.filter("v > u").join(least, _same("u", "c"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked with the smallest of them."""
    least = links.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    near = links.join(least, _same("u", "c")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): for each node of the links (a, b) but the smallest of its component, that smallest node."""
    spark = links.sparkSession
    at = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    at, path = shared.written(at, "links")
    seen = None
    while True:
        following, next_path = shared.written(_small_star(_large_star(at)), "links")
        state = tuple(following.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        shared.remove(spark, path)
        at, path = following, next_path
        if state == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
