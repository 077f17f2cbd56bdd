"""Connected components of a distributed edge list, by alternating large and small stars.

Each round is a min-aggregate (combined map-side, so a hub costs one row a task) and a join back,
which adaptive execution splits when a hub is skewed. The edges of every round are cut to a table
in the shared folder; only a count and a checksum reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge (columns a, b); root is the least node reachable."""
    edges = cut(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A table, so that the edges of a hub can be split in the join.
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m")))
        large = edges.join(least, edges.v == least.x).select("u", F.col("m").alias("v"))  # u is the larger neighbour of v
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        linked = large.join(least, large.u == least.x)
        small = linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v")))
        edges = cut(small.where("u != v").distinct())
        before, state = state, _state(edges)
        if state == before:
            break
    leaves = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return leaves.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
