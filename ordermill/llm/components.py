"""Connected components of a link table by alternating large and small stars.

Each round links every node to the smallest of its neighbours with one aggregation and
one join; no neighbour list is gathered anywhere. Rounds are written to the shared
folder, so that their number does not lengthen the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ordermill.llm.stored import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Link each larger neighbour of a node to the smallest of the node and its neighbours."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("low"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of those neighbours."""
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(least, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(least.select("a", F.col("low").alias("b"))).distinct()


def _state(links: DataFrame):
    pair = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(links.agg(F.count("*"), F.sum(pair)).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of a link (a, b).

    Nulls and links of a node to itself are ignored. An empty table gives an empty one.
    """
    oriented = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current = stored(oriented, "links")
    before = _state(current)
    while before[0]:
        current = stored(_small_star(_large_star(current)), "stars")
        after = _state(current)
        if after == before:
            break
        before = after
    members = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.union(roots)
