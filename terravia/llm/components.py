"""Connected components of an edge table by alternating large and small stars.

Every step is a minimum per node (taken before the shuffle) and a join with the edges, which Spark splits
where one node has very many; nothing is collected but two numbers a round. Each round is written to the
shared folder, so a lost executor repeats one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: each greater neighbour of a node to the least of the node and its neighbours. Small: the same with
    the lesser neighbours and the node itself."""
    if large:
        near = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        out = near.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, rounds: int = 60) -> DataFrame:
    """node, component (the least node) of every node that has an edge. Edges may repeat, have either direction and
    be loops; nulls are left out."""
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = common.stored(now.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "edges")
    state = None
    for _ in range(rounds):
        before = now
        now = common.stored(_star(_star(before, True), False), "edges")
        common.dropped(before)
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(
        F.col("a").alias("node"), F.col("b").alias("component")
    ).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
