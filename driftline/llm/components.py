"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, written


def _settled(edges: DataFrame) -> bool:
    """Whether every node points to one root, and no root points on: one aggregation over the nodes."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    by = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return by.where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _with_least(edges: DataFrame) -> DataFrame:
    """a, b and root, the least b of each a."""
    sizes = edges.groupBy("a").agg(F.min("b").alias("root"), F.count(F.lit(1)).alias("m"))
    return lookup(edges, sizes.select("a", "root"), ["a"], sizes.select("a", "m"), edges.count(), ["b"])


def connected_components(edges: DataFrame, path: str, rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b); root is the least node of its component, which has an entry too.

    Each round is two joins with aggregations; nothing is gathered on the driver, and the edges of a node that has many are dealt
    to several tasks. The number of rounds grows
    with the logarithm of a component's diameter. Loops are ignored; without edges the result is empty.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{path}/edges")
    if _settled(now):
        rounds = 0
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a and b != least(a, root)").select(F.col("b").alias("a"), F.least("a", "root").alias("b")).distinct()
        large = written(large, f"{path}/large{k}")
        small = _with_least(large).select(F.when(F.col("b") != F.col("root"), F.col("b")).otherwise(F.col("a")).alias("a"), F.col("root").alias("b"))
        now = written(small.distinct(), f"{path}/round{k}")
        if _settled(now):
            break
    else:
        if rounds:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
