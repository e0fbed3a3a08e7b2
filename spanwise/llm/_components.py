"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.runtime import materialize


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(v, component) of (v) and undirected (a, b): the smallest vertex reachable, by alternating large-star and small-star steps.

    Each step is two aggregations over the edges, with every vertex linked to its least neighbour, so a hub isn't gathered;
    the number of steps grows with the logarithm of a component's diameter. Lineage is cut after each.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        # large star: every larger neighbour is linked to the least of a vertex's neighbourhood
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a vertex and its smaller neighbours are linked to the least of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        smaller = e.join(least, "u")
        e = materialize(smaller.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if before == state:
            break
        before = state
    return vertices.join(e.select(F.col("u").alias("v"), F.col("v").alias("m")), "v", "left").select("v", F.coalesce("m", "v").alias("component"))
