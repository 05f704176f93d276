"""Timelines of many versions against day-by-day counting, and the rule evaluator's odd cases."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from rulelens.operators import rules, timelines
from rulelens.plans import ask as plan
from rulelens.plans import rule_queries
from rulelens.sources import companions

from . import fixture_corpus as fx

START = date(2020, 1, 1)


def day(n):
    return START + timedelta(days=n)


def test_periods_are_split_day_by_day(spark):
    rng = random.Random(12)
    cuts = {r: [None, *sorted(rng.sample(range(700), n))] for r, n in (("a", 0), ("b", 1), ("c", 40), ("d", 3))}
    rows = [(r, None if c is None else day(c), float(i + 1)) for r, cs in cuts.items() for i, c in enumerate(cs)]
    versions = timelines.timeline(spark.createDataFrame(rows, "rule_id string, effective_date date, value double"))
    periods = [(i, rng.choice("abcd"), (s := rng.randrange(-100, 800)), s + rng.choice([0, 1, 30, 400, -1])) for i in range(300)]
    df = spark.createDataFrame([*((i, r, day(s), day(e)) for i, r, s, e in periods), (998, "a", None, day(3)), (999, "none", day(1), day(2))], "pid int, rule_id string, first_day date, last_day date")
    parts = timelines.split(df, versions, "pid", ["rule_id"]).cache()
    value = lambda r, n: max(i + 1 for i, c in enumerate(cuts[r]) if c is None or c <= n)
    want = {}
    for i, r, s, e in periods:
        for n in range(s, e + 1):
            want[i, value(r, n)] = want.get((i, value(r, n)), 0) + 1
    assert {(r.pid, r.value): r.days for r in parts.collect()} == want
    assert {r.uncovered for r in parts.collect()} == {0}
    whole = {r.pid: r.apportioned for r in timelines.apportioned(parts, "pid", F.col("value")).collect()}
    for i, r, s, e in periods:
        if e >= s:
            assert whole[i] == pytest.approx(sum(value(r, n) for n in range(s, e + 1)) / (e - s + 1))
    once = {r.pid: r.value for r in timelines.in_force(df, versions, "first_day", ["rule_id"]).collect()}
    assert once == {i: value(r, s) for i, r, s, _ in periods}


def test_faulty_timelines_are_named(spark):
    rows = [("sound", None, day(5)), ("sound", day(5), None), ("gap", None, day(5)), ("gap", day(7), None), ("twice", None, day(9)), ("twice", day(5), None), ("inside", None, None), ("inside", day(2), day(3)), ("late", day(1), None), ("ends", None, day(1)), ("empty", None, day(4)), ("empty", day(4), day(4)), ("empty", day(4), None)]
    got = {(r.rule_id, r.problem) for r in timelines.problems(spark.createDataFrame(rows, "rule_id string, valid_from date, valid_to date")).collect()}
    assert got == {("gap", "gap"), ("twice", "overlap"), ("inside", "overlap"), ("late", "no first version"), ("ends", "ends"), ("empty", "empty")}


@pytest.fixture(scope="module")
def tables(spark):
    versions = timelines.timeline(spark.createDataFrame(rule_queries.VERSIONS, "rule_id string, effective_date string, params map<string,string>").withColumn("effective_date", F.to_date("effective_date")))
    return spark.createDataFrame(rule_queries.CASES, rules.CASES).cache(), versions.cache()


def test_answers_and_what_they_lack(spark, tables):
    asked = [
        ("before", "What is the fee before 1 January 2016?"), ("on", "What is the fee on 1 January 2016?"), ("two", "What is the fee on 03/04/2019?"), ("now", "What is the fee currently?"), ("none", "What is the fee?"),
        ("size", "What is the income limit for a household of six, determined on 2 May 2019?"), ("list", "What is the income limit, determined on 2 May 2019?"), ("guard", "Is there a late report rule? Determined 3 March 2015."),
        ("span", "What is the fee for the period from 31 December 2015 through 2016-01-03?"), ("same", "What is the fee for the period from 2 January 2016 through 2016-01-03? A good many other things were said that have no bearing on it. It was determined 9 May 2017."), ("other", "Who keeps the list?"),
    ]
    q = spark.createDataFrame([(*r, None) for r in asked] + [("given", "What is the fee for a determination made on 2 May 2019?", date(2015, 1, 1)), ("told", "What is the fee?", date(2015, 1, 1))], "qid string, question string, given_determination date")
    got = {r.qid: r for r in rules.evaluate(q, rule_queries.TOPICS, *tables).collect()}
    assert {k: (r.status, r.decision, r.version, r.result) for k, r in got.items()} == {
        "before": ("resolved", "ANSWER", 0, 120.0), "on": ("resolved", "ANSWER", 1, 175.0), "two": ("missing_fact", "REFUSE", None, None), "now": ("resolved", "ANSWER", 3, 210.0), "none": ("missing_fact", "REFUSE", None, None),
        "size": ("resolved", "ANSWER", 2, 3550.0), "list": ("resolved", "ANSWER", 2, 450.0), "guard": ("resolved", "REFUSE", 0, 0.0), "span": ("resolved", "ANSWER", None, (120 + 3 * 175) / 4), "same": ("resolved", "ANSWER", 1, 175.0),
        "given": ("date_error", "REFUSE", 0, None), "told": ("resolved", "ANSWER", 0, 120.0),
    }
    assert got["list"].answer == "1: $1,300; 2: $1,700; 3: $2,200; then $450 each." and got["before"].answer == "On 31 December 2015 the fee is $120."
    assert got["none"].answer.startswith("Please provide the date the determination was made") and "contradicts" in got["given"].answer
    assert rules.evaluate(q.limit(0), rule_queries.TOPICS, *tables).count() == 0


def test_templates_are_filled_once(spark):
    row = spark.createDataFrame([("{a}{b} and {c}, {a", {"a": "{b}", "b": "B", "c": None})], "t string, v map<string,string>")
    assert row.select(rules.rendered(F.col("t"), F.col("v")).alias("x")).first().x == "{b}B and , {b}"


def test_ask_takes_cases(spark, tmp_path):
    files = fx.write(tmp_path)
    index = str(tmp_path / "index")
    plan.ingest(spark, files["rules.md"], [files["amendment-1.md"]], index, companions.Settings(dimension=64), ["1.1", "1.2", "5.1"])
    corpus = plan.load_corpus(spark, index, files["findings.json"], files["contacts.json"], files["timeline.json"], fx.TOPICS)
    corpus.cases = spark.createDataFrame([("rent", "rent", 1, "amount", "determination_date", "yearly", None, None, None, "ANSWER", "The rent is {$yearly} on {day}.", "In force from {from}.")], rules.CASES)
    q = spark.createDataFrame([("a", "How much is the rent for a determination made on 5 March 2026?"), ("b", "How much is the rent?"), ("c", "Who keeps the waiting list?")], "qid string, question string")
    got = {r.qid: r for r in plan.ask(q, corpus, companions.Settings(dimension=64)).collect()}
    assert got["a"].answer == "The rent is $150 on 5 March 2026." and got["a"].decision == "ANSWER" and len(got["a"].citations) == 3
    assert got["b"].decision == "REFUSE" and got["b"].next_step.startswith("Please provide") and got["c"].path == "evidence"
