"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pairsieve.llm.common import keep


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the least ones has one edge, and that to a least one: nothing would change any more."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    roles = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return roles.agg(F.count(F.when((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)), 1))).first()[0] == 0


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node``, ``component`` for every end of the edges (``a``, ``b``); the component is its least node.

    Each step only needs the least neighbour of a node, which tasks compute partially before the
    shuffle, and hands every edge on to it: a node with very many edges is never gathered.
    """
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    now = keep(both, name)
    while not _settled(now):
        mirrored = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            mirrored.join(_least(mirrored), "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct()
        )
        small = (
            large.join(_least(large), "u").select(F.greatest("v", "m").alias("x"), F.col("m"), "u")
            .select(F.explode(F.array(F.struct(F.col("x").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").filter("u <> v").distinct()
        )
        now = keep(small, name)
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
