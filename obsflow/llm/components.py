"""Connected components of links, by alternating large-star and small-star steps.

Each step takes the smallest neighbour of every node with a map-side aggregate and joins it back, so a node with very many links is
split by adaptive skew joins and never gathered. Every step's links go to the shared checkpoint folder; only their count and checksum
come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsflow.session import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).union(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("w"))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("v").alias("a"), F.least("u", "w").alias("b")).where("a != b")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("w"))
    moved = down.join(least, "u").where("v != w").select(F.col("v").alias("a"), F.col("w").alias("b"))
    return moved.union(least.select(F.col("u").alias("a"), F.col("w").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 40)))).first())


def connected(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node) of all nodes with links; ``links`` has long columns a and b, repeated rows allowed."""
    now = checkpointed(_small_star(links.select("a", "b")))
    state = _state(now)
    while True:
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if state == before:
            break
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.union(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
