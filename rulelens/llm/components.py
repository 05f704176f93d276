"""Connected components by alternating star contractions, entirely as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every endpoint of ``edges(a, b)``; component is the smallest node reachable.

    Self-loops and repeated edges are harmless, nulls are dropped, an empty table gives an empty table. Each round is
    two aggregations and two joins over the remaining edges, and is checkpointed; the number of rounds grows with the
    logarithm of the longest path. Nothing but two numbers a round reaches the driver.
    """
    e = cut(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    before = _state(e)
    for _ in range(rounds):
        if not before[0]:
            break
        lowest = (
            e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
            .groupBy("u")
            .agg(F.min("v").alias("m"))
            .select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
        )
        large = (
            e.join(lowest, e.v == lowest.c)
            .select("u", F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        base = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(base.withColumnRenamed("u", "c"), F.col("u") == F.col("c"))
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("p"))
            .select("p.u", "p.v")
            .where("u <> v")
            .distinct()
        )
        e = cut(small)
        after = _state(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
