"""As-of rules (J18, H1-H5): which version of a rule is in force, and what it says.

Topics, rules and periods are tables; rules are ``(rule_id, topic, basis, effective_date, before, after)`` with parameter maps,
unfolded into versions of half-open validity, so that the choice is one range join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import crosses, date_context, effective_day
from ..functions.text import long_date, money

TODAY = r"(?i)\b(today|now|currently|at present)\b"
NEEDED = {
    "determination_date": "the date the determination was made",
    "change_date": "the date the change of circumstances occurred",
    "claim_period": "the start and end dates of the claim period",
}


def versions(rules: DataFrame) -> DataFrame:
    """Each rule's two versions with ``[valid_from, valid_to)``."""
    old = rules.select("rule_id", "topic", "basis", F.lit(None).cast("date").alias("valid_from"), F.col("effective_date").alias("valid_to"), F.col("before").alias("params"), F.lit("before").alias("version"))
    new = rules.select("rule_id", "topic", "basis", F.col("effective_date").alias("valid_from"), F.lit(None).cast("date").alias("valid_to"), F.col("after").alias("params"), F.lit("after").alias("version"))
    return old.unionByName(new)


def as_of(facts: DataFrame, versions_: DataFrame, day: str, on: list[str]) -> DataFrame:
    """Facts joined to the version in force on ``day``; equal keys meet first, then the interval decides."""
    v = versions_.withColumnsRenamed({k: f"v_{k}" for k in on})
    match = F.lit(True)
    for k in on:
        match = match & (F.col(k) == F.col(f"v_{k}"))
    inside = (F.col("valid_from").isNull() | (F.col(day) >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col(day) < F.col("valid_to")))
    return facts.join(v, match & inside).drop(*[f"v_{k}" for k in on])


def latest_before(left: DataFrame, right: DataFrame, by: list[str], at: str, value: list[str], stretch: Column | None = None) -> DataFrame:
    """The latest right row at or before each left row, by one union and two windows instead of a range join.

    Both sides are dealt once by key and ``stretch`` of time (by default the day, or a thousand of a number), and a window carries the last right row
    forward within a stretch; the last one of earlier stretches comes from a table of one row for each key and stretch. So
    a hot key is spread over its stretches, and no key's rows meet as a product. ``at`` names the time on both sides; right
    columns come out prefixed with ``last_``.
    """
    from pyspark.sql import Window

    if stretch is None:
        timed = left.schema[at].dataType.typeName() in ("timestamp", "timestamp_ntz", "date")
        stretch = F.date_trunc("day", F.col(at)) if timed else F.floor(F.col(at) / 1000)
    rows = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(at, *value)).schema[0].dataType).alias("_r"))
    tagged = right.select(*by, at, F.lit(0).alias("_side"), F.struct(at, *value).alias("_r"))
    both = rows.unionByName(tagged, allowMissingColumns=True).withColumn("_stretch", stretch)
    w = Window.partitionBy(*by, "_stretch").orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = both.withColumn("_last", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ends = both.groupBy(*by, "_stretch").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.col(at))).alias("_end"))
    earlier = Window.partitionBy(*by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*by, "_stretch", F.last("_end", ignorenulls=True).over(earlier).alias("_carried"))
    known = inside.alias("i").join(carried.alias("c"), [F.col(f"i.{k}").eqNullSafe(F.col(f"c.{k}")) for k in (*by, "_stretch")], "left")
    last = F.coalesce("_last", "_carried")
    return known.select(*[F.col(f"i.{c}") for c in left.columns], *[last[c].alias(f"last_{c}") for c in (at, *value)])


def topic_of(questions: DataFrame, topics: list[tuple[str, str]]) -> Column:
    """H1: the first topic whose pattern matches, in order of the list."""
    out = None
    for name, pattern in topics:
        hit = F.col("question").rlike(pattern)
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out if out is not None else F.lit(None).cast("string")


def date_for_basis(basis: Column, effective: Column, today: Column) -> Column:
    """H3: the role's date, else the only mention, else today if the question says so; null if dates are ambiguous."""
    role = F.when(basis == "determination_date", F.col("determination_date")).when(basis == "change_date", F.col("change_date")).otherwise(F.col("period_start"))
    sole = F.when(F.size("mentions") == 1, effective_day(F.col("mentions")[0], effective))
    now = F.when(F.col("question").rlike(TODAY), today)
    return F.when(~F.coalesce("ambiguous", F.lit(False)), F.coalesce(role, sole, now))


def resolve(questions: DataFrame, rules: DataFrame, topics: list[tuple[str, str]], today: str = "2026-06-01") -> DataFrame:
    """H2: (qid, topic, basis, status, day, version, params, message) of the questions that a versioned topic settles.

    ``status`` is resolved, missing_date or spanning; questions of no topic are absent, so they go on to retrieval.
    """
    q = date_context(questions).withColumn("topic", topic_of(questions, topics)).where("topic is not null")
    q = q.join(rules.select("topic", "rule_id", "basis", "effective_date"), "topic")
    q = q.withColumn("day", date_for_basis(F.col("basis"), F.col("effective_date"), F.lit(today).cast("date")))
    q = q.withColumn("span", crosses(F.col("period_start"), F.col("period_end"), F.col("effective_date")))
    v = versions(rules).select(F.col("rule_id").alias("v_rule"), "valid_from", "valid_to", "version", "params")
    inside = (F.col("valid_from").isNull() | (F.col("day") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    r = q.join(v, (F.col("rule_id") == F.col("v_rule")) & inside & ~F.col("span"), "left")
    status = F.when(F.col("span"), "spanning").when(F.col("day").isNull(), "missing_date").otherwise("resolved")
    names = F.create_map(*[F.lit(x) for kv in NEEDED.items() for x in kv])
    message = (
        F.when(F.col("span"), F.concat(F.lit("The period crosses "), long_date(F.col("effective_date")), F.lit(" and is apportioned by day.")))
        .when(F.col("day").isNull(), F.concat(F.lit("Please provide "), F.element_at(names, F.col("basis")), F.lit(".")))
        .otherwise(F.concat(F.lit("On "), long_date(F.col("day")), F.lit(" the version "), F.col("version"), F.lit(" "), long_date(F.col("effective_date")), F.lit(" applies.")))
    )
    return r.select("qid", "question", "topic", "rule_id", "basis", status.alias("status"), "day", "version", "params", message.alias("message"), "date_error")


def validate_rules(rules: DataFrame, chunks: DataFrame, effective: str) -> DataFrame:
    """H4: (rule_id, problem) of rules whose date, paragraphs, targets or number of replacements do not fit the sources."""
    day = F.lit(effective).cast("date")
    known = chunks.select(F.explode(F.array("clause_id", "source_locator")).alias("target")).where("target is not null").distinct()
    need = rules.select("rule_id", F.explode(F.concat("target_clause_ids", F.array("amendment_paragraph_id", "transition_paragraph_id"))).alias("target")).where("target is not null")
    lost = need.join(known, "target", "left_anti").select("rule_id", F.concat(F.lit("unknown target "), "target").alias("problem"))
    dates = rules.where(F.col("effective_date") != day).select("rule_id", F.lit("effective date differs from the amendment's").alias("problem"))
    paragraphs = chunks.select(F.col("source_locator").alias("amendment_paragraph_id"), F.size(F.regexp_extract_all("text", F.lit(r"(?i)\bsubstitut"), F.lit(0))).alias("n"))
    counts = rules.where("expected_replacement_count is not null").join(paragraphs, "amendment_paragraph_id")
    counts = counts.where("n <> expected_replacement_count").select("rule_id", F.lit("number of replacements differs").alias("problem"))
    return lost.unionByName(dates).unionByName(counts)


def countable(earnings: Column, disregard: Column) -> Column:
    """H5: earnings beyond a disregard."""
    return F.greatest(F.lit(0.0), earnings - disregard)


def threshold(params: Column, size: Column) -> Column:
    """H5: a household's threshold: by size to five, then so much for each further member."""
    five = F.element_at(params, F.lit("5")).cast("double")
    more = F.element_at(params, F.lit("additional")).cast("double")
    return F.when(size <= 5, F.element_at(params, size.cast("string")).cast("double")).otherwise(five + (size - 5) * more)


def prorate(start: Column, end: Column, effective: Column, before: Column, after: Column) -> Column:
    """The spanning rule: each version's amount by its share of the period's days, both ends counting."""
    days = (F.date_diff(end, start) + 1).cast("double")
    old = F.least(F.greatest(F.date_diff(effective, start), F.lit(0)), F.date_diff(end, start) + 1).cast("double")
    return (before * old + after * (days - old)) / days


def spell_amount(amount: Column, day: Column) -> Column:
    return F.concat(F.lit("From "), long_date(day), F.lit(" the amount is "), money(amount), F.lit("."))
