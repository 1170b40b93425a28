"""Connected components of a graph given as a table of edges, without gathering edges or labels in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import drop, stored


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges (a, b): the component is its smallest node.

    Large-star and small-star steps in turn until all components are stars: every node hangs on the smallest node of its
    component then. Each step is a min per node, counted before the shuffle, and a join whose hot nodes Spark splits.
    Rounds grow with the logarithm of a component's size. Loops and repeated edges do no harm; no edges, no rows.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while not all_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        before, now = now, stored(small.filter("u <> v").distinct(), "small-star")
        drop(before, large)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def all_stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one other at most, and those on none: no node has two edges up, or one up and one down."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()
