"""Connected components of an undirected edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.frames import cut


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """For each ``u`` the least of itself and its ``v``s. Written out, so that the join with it deals both sides by key and a hot key's edges can be split."""
    return cut(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u bigint, v bigint)`` to ``(node, component)``, where ``component`` is the least node reachable.

    Only nodes with an edge to another node appear. Direction, repeats and loops don't matter; an edge with a null end
    is no edge. Each round is a handful of joins and partial aggregations, cut by a checkpoint; the number of rounds
    grows with the logarithm of the longest chain.
    """
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        joined = large.join(_least_neighbour(large), "u")
        now = cut(joined.select("u", F.col("m").alias("v")).unionByName(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct())
        last, sign = sign, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if sign == last:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
