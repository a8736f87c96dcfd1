"""Connected components of a graph given as edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import cut

EDGES_PER_PART = 200_000


def _least(edges: DataFrame, parts: int) -> DataFrame:
    """``u, m``: the smaller of each node and its least neighbour. Cut, so that a join with it deals both sides anew and can split a hot node."""
    return cut(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).coalesce(parts))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (columns ``a, b``); the component is its least node.

    Rounds are many and links few, so each step is kept in as many parts as
    the links need, not in as many as a shuffle of documents would have.
    """
    current = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = 1 + current.count() // EDGES_PER_PART
    current, state = current.coalesce(parts), None
    while True:
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(parts)
        large = both.join(_least(both, parts), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.where("u <> v").coalesce(parts).distinct().coalesce(parts))
        tied = large.join(_least(large, parts), "u").coalesce(parts)
        small = tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        current = cut(small.where("u <> v").distinct().coalesce(parts))
        seen = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            break
        state = seen
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots).coalesce(parts).groupBy("node").agg(F.min("component").alias("component")).coalesce(parts)
