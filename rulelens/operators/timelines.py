"""Timelines of rules under any number of amendments (J18, DT10): versions, their checks, as-of joins and split periods.

A version is (rule_id, effective_date, params), the first of a rule having a null date: it always was in force. A period meets
the versions of its rule that overlap it. Both sides are dealt over stretches of time, so that a rule with very many periods
or versions is met in as many places as its time has stretches, and no two of its rows meet twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a stretch.
STRETCH = 64


def timeline(amendments: DataFrame) -> DataFrame:
    """``amendments(rule_id, effective_date, …)`` with ``valid_from``, ``valid_to`` (exclusive, null while in force) and ``version`` from 0."""
    by = Window.partitionBy("rule_id").orderBy(F.col("effective_date").asc_nulls_first())
    return amendments.withColumns({"valid_from": F.col("effective_date"), "valid_to": F.lead("effective_date").over(by), "version": F.row_number().over(by) - 1}).drop("effective_date")


def from_two(rules: DataFrame) -> DataFrame:
    """Rules with one amendment, (rule_id, effective_date, before, after), as versions."""
    side = lambda day, params: rules.select("rule_id", day.alias("effective_date"), F.col(params).alias("params"))
    return timeline(side(F.lit(None).cast("date"), "before").unionByName(side(F.col("effective_date"), "after")))


def problems(versions: DataFrame) -> DataFrame:
    """(rule_id, day, problem) of ``versions(rule_id, valid_from, valid_to)`` that overlap, leave a gap, are empty, or end for good."""
    by = Window.partitionBy("rule_id").orderBy(F.col("valid_from").asc_nulls_first(), F.col("valid_to").asc_nulls_last())
    # what was in force the longest before, so that a version inside another counts against it
    reach = F.max(F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    seen = versions.select("rule_id", "valid_from", "valid_to", reach.alias("reach"), F.row_number().over(by).alias("n"), F.count(F.lit(1)).over(Window.partitionBy("rule_id")).alias("all"))
    begins = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    found = F.array_compact(
        F.array(
            F.when(F.col("valid_to") <= F.col("valid_from"), "empty"),
            F.when(F.col("reach") > begins, "overlap"),
            F.when(F.col("reach") < begins, "gap"),
            F.when((F.col("n") == 1) & F.col("valid_from").isNotNull(), "no first version"),
            F.when((F.col("n") == F.col("all")) & (F.greatest("reach", F.coalesce("valid_to", F.lit("9999-12-31").cast("date"))) < F.lit("9999-12-31").cast("date")), "ends"),
        )
    )
    return seen.select("rule_id", F.col("valid_from").alias("day"), F.explode(found).alias("problem"))


def _stretches(first: Column, last: Column) -> Column:
    number = lambda d: F.floor(F.unix_date(d) / STRETCH).cast("int")
    return F.explode(F.sequence(number(first), number(last)))


def overlapping(periods: DataFrame, versions: DataFrame, on: list[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """Each period with each version of its key in force on some day of it, with ``from_day`` and ``to_day``, both counting.

    Periods with a null end, or that end before they begin, meet none. A pair meets in the stretch of its first common day
    only. Open versions reach as far as the periods do, which are one row of two dates.
    """
    p = periods.where((F.col(first) <= F.col(last)))
    span = p.agg(F.min(first).alias("_least"), F.max(last).alias("_most"))
    v = versions.withColumnsRenamed({k: f"_{k}" for k in on}).join(F.broadcast(span))  # one row
    v = v.withColumns({"_begin": F.greatest(F.coalesce("valid_from", "_least"), F.col("_least")), "_end": F.least(F.coalesce(F.date_sub("valid_to", 1), F.col("_most")), F.col("_most"))})
    v = v.where("_begin <= _end").withColumn("_stretch", _stretches(F.col("_begin"), F.col("_end"))).drop("_least", "_most")
    p = p.withColumn("_slot", _stretches(F.col(first), F.col(last)))
    same = F.col("_slot") == F.col("_stretch")
    for k in on:
        same = same & (F.col(k) == F.col(f"_{k}"))
    begin, end = F.greatest(F.col(first), F.col("_begin")), F.least(F.col(last), F.col("_end"))
    met = p.join(v, same & (begin <= end) & (F.floor(F.unix_date(begin) / STRETCH) == F.col("_slot")))
    return met.withColumns({"from_day": begin, "to_day": end}).drop("_slot", "_stretch", "_begin", "_end", *[f"_{k}" for k in on])


def split(periods: DataFrame, versions: DataFrame, key: str, on: list[str], first: str = "first_day", last: str = "last_day") -> DataFrame:
    """DT10: the parts of each period, one for each version in force, with ``days`` and the ``total`` of the period.

    ``uncovered`` counts the days of a period on which no version, or more than one, was in force; with a sound timeline it is 0.
    """
    parts = overlapping(periods, versions, on, first, last).withColumn("days", (F.datediff("to_day", "from_day") + 1).cast("long"))
    total = (F.datediff(last, first) + 1).cast("long")
    whole = Window.partitionBy(key)
    return parts.withColumns({"total": total, "parts": F.count(F.lit(1)).over(whole), "uncovered": F.abs(total - F.sum("days").over(whole))})


def in_force(facts: DataFrame, versions: DataFrame, day: str, on: list[str]) -> DataFrame:
    """J18 over many versions: each fact with the version of its key in force on ``day``; facts without a day, or before any version, are left out."""
    return overlapping(facts, versions, on, day, day).drop("from_day", "to_day")


def apportioned(parts: DataFrame, key: str, amount: Column) -> DataFrame:
    """(key, apportioned, days): each part's amount by its share of the whole period's days."""
    return parts.groupBy(key).agg((F.sum(amount * F.col("days")) / F.max("total")).alias("apportioned"), F.sum("days").alias("days"))
