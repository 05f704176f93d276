"""Answers by rules that change with time (H1-H3, H5): one evaluator over a table of cases.

A rule has versions, each a map of parameters; a case says for which questions of a topic it stands, which form of arithmetic it
takes, and how its answer and reason read. Nothing of any one programme is in code: topics, cases and versions are tables.

The forms, each giving ``result`` from the version in force:

========== ======================================================================================
amount     the parameter
beyond     what an amount in the question has above the parameter, 0 if nothing
table      the parameter of the household's size; above the last, that and ``additional`` for each further member
deadline   the parameter's number of days after the later of change and awareness, as a date in ``due``
rate       the parameter's percentage of an amount in the question, if there is one
in_force   1 or 0: whether the rule is in force
apportion  over a period, each version's parameter by its share of the days
========== ======================================================================================

A case of form ``apportion`` stands for questions whose period crosses a change of the rule, and for no others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import date_context, effective_day
from ..functions.text import extract_all, household_size, long_date, money
from . import timelines
from .temporal import topic_of

FORMS = ["amount", "beyond", "table", "deadline", "rate", "in_force", "apportion"]
CASES = (
    "topic string, rule_id string, seq int, form string, basis string, parameter string, asks string, needs array<string>, version int, decision string, answer string, reason string"
)
#: What a date is called where it is missing, by the basis that needs it (fixed values).
NEEDED = {
    "determination_date": "the date the determination was made",
    "change_date": "the date the change of circumstances occurred",
    "claim_period": "the start and end dates of the claim period",
}
#: Words that mean the day of asking (a fixed value).
TODAY = r"(?i)\b(today|currently|current\s+rule|as\s+of\s+now)\b"
AMOUNT = r"\$([0-9][0-9,]*(?:\.[0-9]{1,2})?)"


def rendered(template: Column, values: Column) -> Column:
    """T21 over a column of templates: each {name} replaced from a map; a name the map lacks is left out, and values are never looked at again."""
    pieces = F.split(template, r"[{}]", -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.element_at(values, p), F.lit(""))).otherwise(p)), "")


def facts_of(questions: DataFrame) -> DataFrame:
    """``date_context`` of questions(qid, question), with ``size`` of the household and ``amount``, the first sum of money."""
    found = extract_all(F.col("question"), AMOUNT, 1)
    return date_context(questions).withColumns({"size": household_size(F.col("question")), "amount": F.replace(F.get(found, F.lit(0)), F.lit(","), F.lit("")).cast("double")})


def _day(basis: Column, today: Column) -> Column:
    """H3: the date of the case's basis, else the only one mentioned, else today if the question says so; null if dates are ambiguous."""
    role = F.when(basis == "change_date", F.col("change_date")).otherwise(F.col("determination_date"))
    sole = F.when(F.size("mentions") == 1, F.col("mentions")[0]["value"])
    return F.when(~F.coalesce("ambiguous", F.lit(False)), F.coalesce(role, sole, F.when(F.col("question").rlike(TODAY), today)))


def _number(params: Column, name: Column) -> Column:
    return F.element_at(params, name).try_cast("double")


def _table(params: Column, size: Column) -> Column:
    sizes = F.filter(F.map_keys(params), lambda k: k.rlike("^[0-9]+$"))
    last = F.array_max(F.transform(sizes, lambda k: k.cast("int")))
    return F.when(size <= last, _number(params, size.cast("string"))).otherwise(_number(params, last.cast("string")) + (size - last) * _number(params, F.lit("additional")))


def result_of(form: Column, params: Column, parameter: Column) -> Column:
    """H5: the number that a form gives, from columns ``amount``, ``size`` and ``apportioned``; null where a fact is missing."""
    value = _number(params, parameter)
    return (
        F.when(form == "amount", value)
        .when(form == "beyond", F.when(F.col("amount").isNotNull(), F.greatest(F.lit(0.0), F.col("amount") - value)))
        .when(form == "table", _table(params, F.col("size")))
        .when(form == "deadline", value)
        .when(form == "rate", F.col("amount") * value / 100)
        .when(form == "in_force", F.element_at(params, parameter).isin("true", "1").cast("double"))
        .when(form == "apportion", F.col("apportioned"))
    )


def evaluate(questions: DataFrame, topics: list[tuple[str, str]], cases: DataFrame, versions: DataFrame, today: str = "2026-06-01") -> DataFrame:
    """H2: the answers of questions(qid, question[, dates given]) that a topic settles; the rest are absent.

    Columns: qid, question, topic, rule_id, form, status (resolved, missing_fact, date_error), decision, day, version, result,
    due, answer, reason. Of a topic's ``cases`` the first one stands whose pattern matches (a null one always does), whose needed facts
    are there and whose version, if it names one, is in force. A question whose topic needs a date that is not there is refused
    with what to provide; one whose given dates contradict it, with the contradiction.
    """
    f = facts_of(questions).withColumn("topic", topic_of(questions, topics)).where("topic is not null")
    boundaries = versions.where("valid_from is not null").select(F.col("rule_id").alias("b_rule"), "valid_from")
    wanted = cases.withColumnsRenamed({"topic": "c_topic", "rule_id": "c_rule"})
    open_ = f.join(wanted, F.col("topic") == F.col("c_topic")).where(F.col("asks").isNull() | F.regexp_like("question", F.coalesce("asks", F.lit(""))))
    have = F.filter(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in ("size", "amount", "awareness_date")]), lambda x: x.isNotNull())
    open_ = open_.where(F.size(F.array_except(F.coalesce("needs", F.array().cast("array<string>")), have)) == 0)
    # DT10: a change of the case's rule inside the period
    periods = open_.where("period_start is not null").select("qid", "c_rule", "period_start", "period_end").distinct()
    crossed = periods.join(boundaries, (F.col("c_rule") == F.col("b_rule")) & (F.col("period_start") < F.col("valid_from")) & (F.col("valid_from") <= F.col("period_end")))
    crossed = crossed.select("qid", "c_rule").distinct().withColumn("crossing", F.lit(True))
    open_ = open_.join(crossed, ["qid", "c_rule"], "left").where((F.col("form") == "apportion") == F.coalesce("crossing", F.lit(False)))

    open_ = open_.withColumn("day", _day(F.col("basis"), F.lit(today).cast("date")))
    v = versions.select(F.col("rule_id").alias("v_rule"), "valid_from", "valid_to", F.col("version").alias("v_version"), "params")
    # "before" the very day of a change means the day before, whichever change it is
    changes = versions.where("valid_from is not null").groupBy(F.col("rule_id").alias("c_rule")).agg(F.collect_set("valid_from").alias("changes"))
    open_ = open_.join(changes, "c_rule", "left")
    edge = (F.size("mentions") == 1) & F.array_contains("changes", F.col("day")) & (F.col("mentions")[0]["value"] == F.col("day"))
    open_ = open_.withColumn("day", F.when(F.coalesce(edge, F.lit(False)), effective_day(F.col("mentions")[0], F.col("day"))).otherwise(F.col("day"))).drop("changes")
    at = F.when(F.col("form") == "apportion", F.col("period_start")).otherwise(F.col("day"))
    dated = open_.withColumn("at", at).withColumnRenamed("version", "c_version")
    inside = (F.col("valid_from").isNull() | (F.col("at") >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (F.col("at") < F.col("valid_to")))
    dated = dated.join(v, (F.col("c_rule") == F.col("v_rule")) & inside, "left")
    stands = F.col("c_version").isNull() | F.col("v_version").isNull() | (F.col("c_version") == F.col("v_version"))
    chosen = dated.where(stands).groupBy("qid").agg(F.min_by(F.struct(*[c for c in dated.columns if c != "qid"]), "seq").alias("x")).select("qid", "x.*")

    spanning = chosen.where("form = 'apportion'").select("qid", F.col("c_rule").alias("rule_id"), "parameter", "period_start", "period_end")
    parts = timelines.split(spanning, versions, "qid", ["rule_id"], "period_start", "period_end")
    shares = timelines.apportioned(parts, "qid", _number(F.col("params"), F.col("parameter"))).select("qid", "apportioned")
    r = chosen.join(shares, "qid", "left")

    anchor = F.greatest(F.coalesce("change_date", "day"), F.coalesce("awareness_date", "change_date", "day"))
    r = r.withColumns({"anchor": anchor, "result": result_of(F.col("form"), F.col("params"), F.col("parameter"))})
    r = r.withColumn("due", F.when(F.col("form") == "deadline", F.date_add("anchor", F.col("result").cast("int"))))
    names = F.create_map(*[F.lit(x) for pair in NEEDED.items() for x in pair])
    needed = F.when(F.col("form") == "apportion", F.lit(None).cast("string")).when(F.col("day").isNull(), F.element_at(names, F.col("basis")))
    status = F.when(F.col("date_error").isNotNull(), "date_error").when(needed.isNotNull(), "missing_fact").otherwise("resolved")
    said = lambda name, value: [F.lit(name), value]
    values = F.create_map(
        *said("day", long_date(F.col("day"))), *said("from", long_date(F.col("valid_from"))), *said("until", long_date(F.col("valid_to"))), *said("anchor", long_date(F.col("anchor"))), *said("due", long_date(F.col("due"))),
        *said("period_start", long_date(F.col("period_start"))), *said("period_end", long_date(F.col("period_end"))), *said("size", F.col("size").cast("string")), *said("amount", money(F.col("amount"))),
        *said("result", F.col("result").cast("decimal(30,2)").cast("string")), *said("money", money(F.col("result"))), *said("number", F.col("result").cast("long").cast("string")),
    )
    priced = F.transform_keys(F.transform_values(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, x: F.coalesce(money(x.try_cast("double")), x)), lambda k, x: F.concat(F.lit("$"), k))
    values = F.map_concat(values, priced, F.transform_keys(F.coalesce("params", F.create_map().cast("map<string,string>")), lambda k, x: F.concat(F.lit("="), k)))
    answer = (
        F.when(F.col("status") == "date_error", F.concat(F.lit("The dates cannot be used: "), "date_error", F.lit(".")))
        .when(F.col("status") == "missing_fact", F.concat(F.lit("Please provide "), "needed", F.lit("; which version of the rule applies depends on it.")))
        .otherwise(rendered(F.col("answer"), F.col("values")))
    )
    reason = F.when(F.col("status") == "resolved", rendered(F.col("reason"), F.col("values"))).otherwise(F.concat(F.lit("The question does not settle "), F.coalesce("needed", F.lit("its dates")), F.lit(".")))
    r = r.withColumns({"needed": needed, "status": status, "values": values})
    return r.select(
        "qid", "question", "topic", F.col("c_rule").alias("rule_id"), "form", "status", F.when(F.col("status") == "resolved", F.col("decision")).otherwise("REFUSE").alias("decision"),
        "day", F.when(F.col("form") != "apportion", F.col("v_version")).alias("version"), F.when(F.col("status") == "resolved", F.col("result")).alias("result"), F.when(F.col("status") == "resolved", F.col("due")).alias("due"), answer.alias("answer"), reason.alias("reason"), "date_error",
    )
