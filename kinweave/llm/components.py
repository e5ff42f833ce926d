"""Connected components by alternating large-star and small-star over DataFrames of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_one


def _with_min(links: DataFrame, scratch: Scratch) -> DataFrame:
    """u, v and m = the smallest of u and its neighbours. A node of many links is pre-aggregated and split, never gathered."""
    least = scratch.keep(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links")), "least")
    return join_one(links, least, "u", scratch, counted="links").withColumn("m", F.least("u", "m"))


def _are_stars(edges: DataFrame) -> bool:
    """Every node either points to one node, or is pointed to: nothing is left to do. One pre-aggregated shuffle."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("n"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("n"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    open_ = ends.groupBy("n").agg(F.sum("out").alias("out"), F.max("in").alias("in")).where("out + in > 1 and out > 0")
    return open_.limit(1).count() == 0


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node and component (its smallest reachable node) for every node that has a link.

    links has u and v; loops, repeated and reversed links and nulls do no harm. Both stars keep connectivity, and
    after some rounds (the logarithm squared of the links at most) each link leads from a node to the smallest node of its component.
    """
    edges = scratch.keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "star")
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both, scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.keep(large.where("u <> v"), "star")
        small = _with_min(large, scratch)  # here v < u in every link
        small = small.select("v", "m").where("v <> m").union(small.select("u", "m")).toDF("u", "v").distinct()
        edges = scratch.keep(small, "star")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
