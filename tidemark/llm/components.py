"""Connected components of an edge table, by alternating large-star and small-star steps (no step gathers a component)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b), component being its smallest node; nodes are long.

    A step only replaces neighbours by smaller ones, so it settles, in a number of steps that is logarithmic in the
    longest path.
    """
    now = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    while True:
        # large star: neighbours above u move to the smallest of u's neighbourhood
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below u, and u, move to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = stage(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
        changed = new.join(now, ["u", "v"], "left_anti").limit(1).count() + now.join(new, ["u", "v"], "left_anti").limit(1).count()
        now = new
        if not changed:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
