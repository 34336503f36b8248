"""Reachable package parts and shortest translation routes: breadth first, a level at a time, however long the chains.

A level is one join of the nodes found last with the edges, without those found before; it is written, so the plan does
not grow with the number of levels, and no path is listed. The nodes of different documents never meet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textveil.shared import written


def reachable(edges: DataFrame, seeds: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, node and least hops of what the edges (keys, src, dst) reach from the seeds (keys, node). keys name the
    document that nodes belong to."""
    level = written(seeds.select(*keys, "node").distinct().withColumn("hops", F.lit(0)), "reached")
    found = level
    while True:
        to = level.withColumnRenamed("node", "src").join(edges.select(*keys, "src", "dst"), [*keys, "src"])
        to = to.select(*keys, F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).distinct()
        level = written(to.join(found.select(*keys, "node"), [*keys, "node"], "left_anti"), "reached")
        if not level.limit(1).count():
            return found
        found = found.unionByName(level)


def routes(edges: DataFrame, source: str) -> DataFrame:
    """node, hops and route: the shortest route from a language to each other one over the edges (src, dst, place); of
    equal length the one whose packages come first. The best route to a node goes on from the best one to the node before,
    so one route for each node and level is enough."""
    spark = edges.sparkSession
    level = spark.range(1).select(F.lit(source).alias("node"), F.lit(0).alias("hops"), F.array(F.lit(0)).alias("places"), F.array(F.lit(source)).alias("path"))
    level = found = written(level, "routes")
    while True:
        to = level.withColumnRenamed("node", "src").join(edges.select("src", "dst", F.col("place").cast("int").alias("place")), "src")
        best = F.min(F.struct(F.array_append("places", F.col("place")).alias("places"), F.array_append("path", F.col("dst")).alias("path"))).alias("best")
        to = to.groupBy(F.col("dst").alias("node"), (F.col("hops") + 1).alias("hops")).agg(best)
        to = to.join(found.select("node"), "node", "left_anti").select("node", "hops", "best.places", "best.path")
        level = written(to, "routes")
        if not level.limit(1).count():
            return found.select("node", "hops", F.array_join("path", ">").alias("route"))
        found = found.unionByName(level)
