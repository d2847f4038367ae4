"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, settle

MOST_ROUNDS = 64


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node with an edge to another; root is the least node of its component.

    Alternating large-star and small-star rounds (Kiveris et al., 2014) end in stars around the least
    nodes; every round is joins and partial minima, so no node's neighbours are gathered. The least
    neighbours of a counted, bounded number of edges are sent to the edges by broadcast; of more, they are
    settled before the join, so that Spark can split the edges of a node that has very many.
    """
    e = settle(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).where("u <> v").distinct())
    n, seen = e.count(), None
    for _ in range(MOST_ROUNDS):
        sent, held = (F.broadcast, lambda df: df) if 2 * n <= BROADCAST_ROWS else (settle, settle)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = held(both.where("v > u").join(sent(_least(both)), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        small = large.join(sent(_least(large)), "u").select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("x"))
        e = settle(small.select(F.col("x.v").alias("u"), F.col("x.m").alias("v")).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        n, seen = now[0], now
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
