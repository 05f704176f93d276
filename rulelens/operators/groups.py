"""Groups that hang together, and their even packing into folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settling import narrow_rows, parts_for, settled_table


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, lead) of nodes(node): the least node reachable over edges(a, b); a node without edges leads itself.

    Every node points to another, at first itself. In a round a node and the one it points to learn the least grandparent of
    the node's neighbours, and all pointers are then doubled, so paths halve and rounds grow with the logarithm of the longest
    one. A round is two joins and two aggregations, combined before their shuffle, and is settled; what the driver sees is one
    number. A lead that many nodes point to is the small side of a join whose large side adaptive execution splits. Parts
    follow the number of rows (``narrow_rows``), so a task holds no more of a larger table.
    Null nodes and edges with a null are left out, repeats and loops change nothing.
    """
    with narrow_rows(nodes.sparkSession, parts_for(nodes, nodes.count())):
        return _settled_components(nodes, edges, rounds)


def _settled_components(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    e = edges.where("a is not null and b is not null and a <> b")
    e = settled_table(e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = settled_table(nodes.where("node is not null").select("node").distinct().select("node", F.col("node").alias("up"), F.col("node").alias("top")))
    for _ in range(rounds):
        heard = e.join(state.select(F.col("node").alias("b"), "top"), "b").groupBy("a").agg(F.min("top").alias("low"))
        told = state.join(heard.withColumnRenamed("a", "node"), "node", "left").select("node", "up", "top", F.least("low", "top").alias("low"))
        hints = told.select("node", "low").unionByName(told.select(F.col("up").alias("node"), "low"))
        up = hints.groupBy("node").agg(F.min("low").alias("up"))
        after = settled_table(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("top")), "up").select("node", "up", "top"))
        still = after.join(state.select("node", F.col("top").alias("was")), "node").where("top <> was").isEmpty()
        state = after
        if still:
            return state.select("node", F.col("top").alias("lead"))
    raise RuntimeError("groups did not settle")


def packed(groups: DataFrame, n: int, seed: int) -> DataFrame:
    """(lead, size, fold) of groups(lead, size): folds whose totals differ by no more than the largest group.

    Sizes are taken from the largest down. The groups of one size go round all folds evenly, in keyed order, and those left over
    to the folds that have least so far, one each. The driver sees the number of groups of each size: no more sizes than the
    square root of twice the members. The order within a size is counted by bucket of the key, so that no task sorts all groups.
    """
    keyed = groups.select("lead", F.col("size").cast("long").alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.col("lead").cast("string"))).alias("key")).withColumn("bucket", F.substring("key", 1, 3))
    counts = settled_table(keyed.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("held")))
    loads, order = [0] * n, []
    for size, held in counts.groupBy("size").agg(F.sum("held")).orderBy(F.col("size").desc()).collect():
        least = sorted(range(n), key=lambda f: (loads[f], f))
        order.append((size, held, least))
        for place, f in enumerate(least):
            loads[f] += size * (held // n + (place < held % n))
    # one row a size: dealt by size, the many groups of one or two members would all meet it in one task
    table = F.broadcast(groups.sparkSession.createDataFrame(order, "size long, held_all long, least array<int>"))
    before = F.sum("held").over(Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("size", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    nth = F.col("before") + F.row_number().over(Window.partitionBy("size", "bucket").orderBy("key", "lead")) - 1
    placed = keyed.join(offsets, ["size", "bucket"]).join(table, "size").withColumn("nth", nth)
    even = F.col("held_all") - F.col("held_all") % n
    fold = F.when(F.col("nth") < even, F.col("nth") % n).otherwise(F.get("least", (F.col("nth") - even).cast("int")))
    return placed.select("lead", "size", fold.cast("int").alias("fold"))


def in_folds(leads: DataFrame, n: int, seed: int) -> DataFrame:
    """leads(…, lead) with each group's ``size`` and ``fold`` of ``packed``, settled."""
    with narrow_rows(leads.sparkSession, parts_for(leads, leads.count())):
        sizes = settled_table(leads.groupBy("lead").agg(F.count(F.lit(1)).alias("size")))
        return settled_table(leads.join(packed(sizes, n, seed), "lead"))
