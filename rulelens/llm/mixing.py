"""Mixing sources to target weights by hash-threshold histograms, in built-in column functions only.

A mix takes a budget of words: a share of all words of the corpus. Sources share the budget by weight; no source gives more
than ``repeats`` times its words, and what is above that is shared anew by weight among the others, until none is above.

Which documents of a source are taken is a matter of a hash of each. A source whose target is k times its words and a
remainder gives every document k times, and once more those whose hash lies below the source's threshold. The threshold is
found without sorting: words are summed by source and hash bucket, the bucket in which the remainder runs out is found from
the sums, and only that bucket is summed again by the next bits of the hash, until it holds a single hash. What is left there
is less than one document; its leading words are taken, so a source gives its target to the word.

Thresholds are nested: documents enter in the order of their hashes, so a larger share takes of every document what a smaller
one takes, or more. Several shares are found from the same sums.

Each level is one aggregation with partial sums, of at most ``2 ** bits`` rows a source; after the second level only the rows
of boundary buckets go on, about one in ``2 ** bits``. The rows that are dealt hold a key, a hash and a size, never a text.

Defined results: a null text has no words; a null source is a source of its own, the last in order; sources of no words have a
target of 0; documents that no hash tells apart (repeated rows) share what is left at the boundary equally, each the same whole
number of words, so that up to one word for each of them may lack; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Bits of the hash, and how many of them each level of histograms looks at.
HASH_BITS, LEVEL_BITS = 60, 10
#: Up to how many rows of one source and share a table is broadcast; a larger one is left to the planner.
BROADCAST_ROWS = 50_000

WORD = r"[^\x20\x09-\x0D]+"


def cyclic_weight(rank: Column) -> Column:
    """1, 2, 3, 1, ... by a source's place in code-point order, from 0."""
    return F.pmod(rank, F.lit(3)) + 1


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): a document's words and its hash, of its id and text, in HASH_BITS bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mark = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text))
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
    )


def ranked_sources(rows: DataFrame) -> DataFrame:
    """(source, source_size, rank): sums of sizes, and places in code-point order with null last; no task sorts all sources."""
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # ranges are settled before they are counted, so that a lost executor cannot move their bounds
    ranges = cut(sums.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return ranges.withColumn("own", own).join(F.broadcast(offsets), "part").select("source", "source_size", (F.col("offset") + F.col("own") - 1).alias("rank"))


def targets(sources: DataFrame, share: float, repeats: int, rounds: int = 10_000) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``, a double.

    A source at its limit has ``repeats`` times its words, the others what is left by weight. Each round is one aggregation and
    gives two whole numbers to the driver; a source that is at its limit stays there, so the rounds end.
    """
    limit = F.col("source_size") * repeats
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    budget = min(round(total * share), total * repeats)
    left, weights = budget, None
    for _ in range(rounds):
        level = F.lit(float(left)) * F.col("weight") / F.lit(float(weights)) if weights else F.lit(float("inf"))
        full = (limit <= level) if weights else F.lit(False)
        row = sources.agg(F.sum(F.when(full, limit).otherwise(0)).alias("taken"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("w")).first()
        state = (budget - (row["taken"] or 0), row["w"] or 0)
        if state == (left, weights):
            break
        left, weights = state
        if not weights:
            break
    else:
        raise RuntimeError("targets did not settle")
    level = F.lit(float(left)) * F.col("weight") / F.lit(float(weights)) if weights else F.lit(float("inf"))
    return sources.withColumn("target", F.least(limit.cast("double"), level))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def thresholds(rows: DataFrame, budgets: DataFrame, bits: int = LEVEL_BITS) -> DataFrame:
    """``budgets(source, share, rest)`` with low, high, left and tied; sources are equal where both are null.

    Rows of hashes below ``low`` have ``rest - left`` words in all. The ``tied`` rows of hashes from ``low`` and below ``high``,
    one or all of one hash, have more than ``left``. ``rest`` is less than the source's words, or the source is left out.
    """
    n = budgets.count()
    part, at = rows.select("source", "size", "h"), 0
    edges = budgets.select(F.col("source").alias("s"), "share", "rest", F.lit(0).cast("long").alias("prefix"))
    while True:
        step = min(bits, HASH_BITS - at)
        if at:
            # only rows of boundary buckets are summed again
            bounds = _small(edges.select("s", "prefix").distinct(), n)
            part = part.join(bounds, F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", HASH_BITS - at) == F.col("prefix")), "left_semi")
            part = cut(part) if at == bits else part
        at += step
        sums = part.groupBy("source", F.shiftright("h", HASH_BITS - at).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        met = sums.join(_small(edges, n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("b", step) == F.col("prefix")))
        running = Window.partitionBy("source", "share").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        beyond = met.withColumn("left", F.col("rest") - F.sum("words").over(running) + F.col("words")).where(F.col("left") < F.col("words"))
        # the first bucket that goes beyond the rest
        first = beyond.groupBy("source", "share").agg(F.min(F.struct("b", "left", "n")).alias("x"))
        edges = cut(first.select(F.col("source").alias("s"), "share", F.col("x.left").alias("rest"), F.col("x.b").alias("prefix"), F.col("x.n").alias("tied")))
        if at == HASH_BITS or edges.where("tied > 1").isEmpty():
            break
        edges = edges.drop("tied")
    low = F.shiftleft("prefix", HASH_BITS - at)
    return edges.select(F.col("s").alias("source"), "share", low.alias("low"), (low + (1 << (HASH_BITS - at))).alias("high"), F.col("rest").alias("left"), "tied")


def mix(docs: DataFrame, shares: Sequence[float] = (1.0,), repeats: int = 3, weigh: Callable[[Column], Column] = cyclic_weight) -> DataFrame:
    """doc_id, source, size, source_size, targets and taken of every row of docs(doc_id, text, source).

    ``targets`` and ``taken`` are arrays with an entry for each of ``shares``: the source's target, and how many words of the
    document the mix takes, repeats counted. ``weigh`` gives a source's weight, a whole number above 0, from its place in order.
    """
    rows = cut(measured(docs))
    sources = cut(ranked_sources(rows).select("source", "source_size", weigh(F.col("rank")).cast("long").alias("weight")))
    each = [targets(sources, share, repeats).select("source", "source_size", F.lit(i).alias("share"), "target") for i, share in enumerate(shares)]
    words, size = F.round("target").cast("long"), F.greatest("source_size", F.lit(1))
    budgets = cut(reduce(DataFrame.unionByName, each).select("*", F.expr("div(cast(round(target) as bigint), greatest(source_size, 1))").alias("whole"), F.pmod(words, size).alias("rest")))
    ends = thresholds(rows, budgets.where("source_size > 0").select("source", "share", "rest"))
    ends = ends.select(F.col("source").alias("s"), F.col("share").alias("q"), "low", "high", "left", "tied")
    plans = budgets.join(ends, F.col("source").eqNullSafe(F.col("s")) & (F.col("share") == F.col("q")), "left")
    plan = F.array_sort(F.collect_list(F.struct("share", "target", "whole", "low", "high", "left", "tied"))).alias("plan")  # one for each share
    plans = cut(plans.groupBy(F.col("source").alias("s"), "source_size").agg(plan))
    once = lambda p: F.when(F.col("h") < p["low"], F.col("size")).when(F.col("h") < p["high"], F.least(F.col("size"), F.floor(p["left"] / p["tied"]))).otherwise(0)
    return rows.join(_small(plans, sources.count()), F.col("source").eqNullSafe(F.col("s"))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        F.transform("plan", lambda p: p["target"]).alias("targets"),
        F.transform("plan", lambda p: F.col("size") * p["whole"] + once(p)).alias("taken"),
    )
