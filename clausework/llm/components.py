"""Connected components of an edge table by alternating large-star and small-star steps, all in joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausework.llm.util import materialise

ROUNDS = 60


def _least(edges: DataFrame) -> DataFrame:
    """``edges`` u, v joined with ``m``, the least of u and all its neighbours v. The minimum is taken map-side first; a hub's rows may be split by the join."""
    least = edges.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", F.least("u", "_m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """``edges``: u, v (any orderable type, not null) -> ``node, root``: every node that has an edge, with its component's least node.

    Each step's edges are written to the shared folder; a step moves every edge to a smaller node, so stars form in a few rounds whatever
    the size of a component. Loops are left out.
    """
    now = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct(), "edges")
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u > v").distinct(), "large-star")  # from a node to a smaller one
        starred = _least(large)
        small = starred.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(starred.select(F.col("u").alias("a"), F.col("m").alias("b")))
        now = materialise(small.where("a > b").select(F.col("b").alias("u"), F.col("a").alias("v")).distinct(), "small-star")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
    leaves = now.select(F.col("v").alias("node"), F.col("u").alias("root"))
    return leaves.unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
