"""Connected components by alternating large-star and small-star rounds; only tables, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, component) for each node of `edges` (a, b: longs); the component is its smallest node.

    Each round points all larger neighbours of a node to its smallest one, first over both directions, then over the edges that
    lead down. It ends when a round changes nothing, after about the logarithm of the longest path. The minima are combined
    before they are shuffled, and the joins' hot keys (centres of large stars) are split by Spark.
    """
    down = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges-0")
    before = signature(down)
    for turn in range(1, rounds + 1):
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.when(F.col("v") == F.col("m"), F.array(F.struct("u", "m"))).otherwise(F.array(F.struct(F.col("v").alias("u"), "m")))).alias("e"))
        down = scratch.keep(small.select("e.u", F.col("e.m").alias("v")).distinct(), f"edges-{turn}")
        scratch.drop(f"edges-{turn - 1}")
        now = signature(down)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return down.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(down.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("u"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
