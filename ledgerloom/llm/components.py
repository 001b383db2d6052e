"""Connected components of a graph given as links between ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.storage import Scratch


def components(links: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of every node of ``links`` (a, b; of any ordered type), by alternating large and small stars.

    The least neighbour of a node is a minimum that combines before the shuffle and is joined back, so the centre of a large star is split
    like any skewed join; each round is written to the shared folder and the one before it dropped. Rounds grow with the logarithm of the
    longest path. Self-links, nulls and repeated links change nothing.
    """
    scratch = Scratch(links.sparkSession, "components")

    def least(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.min("v").alias("m"))

    def large_stars(edges: DataFrame) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        met = both.join(least(both), "u").where("v > u")
        return met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u <> v").distinct()

    def small_stars(edges: DataFrame) -> DataFrame:
        met = edges.join(least(edges), "u")
        ends = F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
        return met.select(F.explode(ends).alias("e")).select("e.*").where("u <> v").distinct()

    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = mark(edges)
    while before[0]:
        large = scratch.write(large_stars(edges), "large")
        now = scratch.write(small_stars(large), "small")
        scratch.drop(edges, large)
        edges, after = now, mark(now)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
