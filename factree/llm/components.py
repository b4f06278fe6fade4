"""Connected components of a table of links, by alternating stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import scratch


def _least(edges: DataFrame) -> DataFrame:
    """u -> its least neighbour or itself, with map-side combine."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "node")


def components(spark: SparkSession, links: DataFrame, rounds: int = 50) -> DataFrame:
    """links (a, b) of longs -> (node, root) for every node that has a link; root is the least node of its component."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges, before = scratch(spark, edges, "edges"), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: neighbours above a node go to the least of its neighbours
        large = both.join(_least(both), F.col("u") == F.col("node")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch(spark, large.filter("u <> v").distinct(), "large")
        # small star: a node and its neighbours below go to the least of those
        joined = large.join(_least(large), F.col("u") == F.col("node"))
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges = scratch(spark, small.filter("u <> v").distinct(), "small")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return scratch(spark, nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
