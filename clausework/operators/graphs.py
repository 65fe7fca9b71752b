"""Reachability and components of graphs given as edge tables, in few rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.sources.scratch import written


def paths(edges: DataFrame, child: str = "child", parent: str = "parent", rounds: int = 40) -> DataFrame:
    """``node, ancestor, distance``: every pair that one or more steps join, with the shortest distance, by path doubling: a round joins paths with paths, so chains of 2 ** k steps
    take k + 1 rounds and no depth is cut. A node on a cycle reaches itself. Null ends and repeated edges play no part."""
    e = edges.select(F.col(child).alias("node"), F.col(parent).alias("ancestor")).where("node is not null and ancestor is not null").distinct()
    now, before = written(e.withColumn("distance", F.lit(1)), "paths"), None
    for _ in range(rounds):
        size = now.agg(F.count("*"), F.sum("distance")).first()
        if size == before:
            return now
        before = size
        up = now.select(F.col("node").alias("_n"), F.col("ancestor").alias("_a"), F.col("distance").alias("_d"))
        longer = now.join(up, F.col("ancestor") == F.col("_n")).select("node", F.col("_a").alias("ancestor"), (F.col("distance") + F.col("_d")).alias("distance"))
        now = written(now.unionByName(longer).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")), "paths")
    raise RuntimeError(f"paths of more than 2 ** {rounds} steps")


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root``: the least node of each node's component, by alternating large and small stars: edges are moved to least neighbours until every component is one star.
    A hub's edges are rows of a join, never one list. Nodes need an order; null ends and loops are left out, so a node without an edge to another one has no row."""
    lesser, greater = F.least(a, b).alias("v"), F.greatest(a, b).alias("u")
    now, before = written(edges.where(F.col(a) != F.col(b)).select(greater, lesser).distinct(), "stars"), None
    for _ in range(rounds):
        size = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first()
        if size == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = size
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"))
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
