"""Registered queries of rules that change with time (DT2-DT10, H1-H3, H5, J18), each beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import rules, timelines
from .catalog import query, table
from .engine_queries import _made, _sql

# --- mentions in whole texts ---------------------------------------------------------------------------

#: Each document with dates of its own before and after its text.
DATED = """SELECT doc_id, concat('Made on ', CAST(2000 + doc_id % 90 AS STRING), '-0', CAST(1 + doc_id % 9 AS STRING), '-', CAST(10 + doc_id % 25 AS STRING), '. ', coalesce(text, ''), ' Ended before ', CAST(1 + doc_id % 31 AS STRING), ' ',
CASE doc_id % 3 WHEN 0 THEN 'February' WHEN 1 THEN 'June' ELSE 'Dec.' END, ' ', CAST(2000 + doc_id % 40 AS STRING), '.') AS text FROM {documents}"""
_DAY, _ISO = r"\b([0-9]{1,2}) (February|June|Dec\.) (20[0-9]{2})\b", r"\b(20[0-9]{2})-([0-9]{2})-([0-9]{2})\b"


def _spans_sql(pattern: str, name: str) -> str:
    """(doc_id, found, start) of a pattern's matches, from the pieces between them."""
    return f"""{name}0 AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS f, regexp_split_to_array(text, '{pattern}') AS g FROM d), {name}1 AS (SELECT doc_id, unnest(f) AS found, unnest(g[1:len(f)]) AS gap, generate_subscripts(f, 1) AS i FROM {name}0),
{name} AS (SELECT doc_id, found, (sum(length(gap) + length(found)) OVER (PARTITION BY doc_id ORDER BY i))::INT - length(found) AS start FROM {name}1)"""


@query(
    f"""WITH d AS ({_sql(DATED)}), {_spans_sql(_ISO, 'i')}, {_spans_sql(_DAY, 'n')},
b AS (SELECT doc_id, start, start + length(found) AS "end", try_strptime(found, '%Y-%m-%d')::DATE AS v FROM i UNION ALL SELECT doc_id, start, start + length(found), coalesce(try_strptime(replace(found, 'Dec.', 'December'), '%d %B %Y'), NULL)::DATE FROM n),
m AS (SELECT doc_id, start + 0 AS start, "end" + 0 AS "end", strftime(v, '%Y-%m-%d') AS value, 'day' AS precision FROM b WHERE v IS NOT NULL UNION ALL
  SELECT doc_id, start + strpos(found, ' '), start + length(found), strftime(strptime('1 ' || replace(substr(found, strpos(found, ' ') + 1), 'Dec.', 'December'), '%d %B %Y'), '%Y-%m-%d'), 'month' FROM n WHERE try_strptime(replace(found, 'Dec.', 'December'), '%d %B %Y') IS NULL)
SELECT doc_id, start, "end", value, precision, CASE WHEN regexp_matches(d.text[greatest(1, start - 17):start], '(?i)\\bbefore\\s*$') THEN 'before' WHEN regexp_matches(d.text[greatest(1, start - 17):start], '(?i)\\b(on|from)\\s*$') THEN 'on' END AS relation FROM m JOIN d USING (doc_id)"""
)
def date_mentions(spark, sf_dir):
    """DT2, DT4: the dates of every whole text."""
    m = dates.with_mentions(_made(spark, sf_dir, DATED), "text").select("doc_id", F.explode("mentions").alias("m"))
    return m.select("doc_id", "m.start", "m.end", F.date_format("m.value", "yyyy-MM-dd").alias("value"), "m.precision", "m.relation")


# --- versions over time ----------------------------------------------------------------------------------

#: Each user and kind of event has a version from every day on which there was such an event, at the day's greatest value.
AMENDED = "SELECT concat(event_type, CAST(user_id % 20 AS STRING)) AS rule_id, CAST(ts AS DATE) AS effective_date, max(value) AS amount FROM {events} GROUP BY 1, 2"
#: Each event asks about a period of up to 29 days about its own.
ASKED = "SELECT event_id, concat(event_type, CAST(user_id % 20 AS STRING)) AS rule_id, CAST(ts AS DATE) AS last_day, CAST(event_id % 29 AS INT) AS back FROM {events}"
_VERSIONS = """a AS (SELECT event_type || (user_id % 20) AS rule_id, ts::DATE AS day, max(value) AS amount FROM events GROUP BY ALL),
v AS (SELECT rule_id, day AS valid_from, lead(day) OVER (PARTITION BY rule_id ORDER BY day) AS valid_to, amount, row_number() OVER (PARTITION BY rule_id ORDER BY day) - 1 AS version FROM a),
p AS (SELECT event_id, event_type || (user_id % 20) AS rule_id, ts::DATE AS last_day, (ts::DATE - (event_id % 29)::INT) AS first_day FROM events)"""


def _amended(spark, sf_dir):
    return timelines.timeline(spark.sql(AMENDED, events=table(spark, sf_dir, "events")))


def _periods(spark, sf_dir):
    return spark.sql(ASKED, events=table(spark, sf_dir, "events")).withColumn("first_day", F.date_sub("last_day", F.col("back"))).drop("back")


@query(f"WITH {_VERSIONS} SELECT event_id, version, amount FROM p JOIN v ON v.rule_id = p.rule_id AND valid_from <= first_day AND (valid_to IS NULL OR valid_to > first_day)")
def version_in_force(spark, sf_dir):
    """J18, over as many versions as there were days."""
    return timelines.in_force(_periods(spark, sf_dir), _amended(spark, sf_dir), "first_day", ["rule_id"]).select("event_id", "version", "amount")


@query(
    f"""WITH {_VERSIONS}, o AS (SELECT event_id, greatest(first_day, valid_from) AS f, least(last_day, coalesce(valid_to - 1, last_day)) AS t, last_day - first_day + 1 AS total, amount FROM p JOIN v ON v.rule_id = p.rule_id AND valid_from <= last_day AND (valid_to IS NULL OR valid_to > first_day))
SELECT event_id, count(*) AS parts, max(total) - sum(t - f + 1)::BIGINT AS uncovered, round(sum(amount * (t - f + 1)) / max(total), 6) AS apportioned FROM o GROUP BY event_id"""
)
def split_periods(spark, sf_dir):
    """DT10: periods cut at every change of their rule, and a value by days."""
    parts = timelines.split(_periods(spark, sf_dir), _amended(spark, sf_dir), "event_id", ["rule_id"])
    checks = parts.groupBy("event_id").agg(F.max("parts").alias("parts"), F.max("uncovered").alias("uncovered"))
    return checks.join(timelines.apportioned(parts, "event_id", F.col("amount")), "event_id").select("event_id", "parts", "uncovered", F.round("apportioned", 6).alias("apportioned"))


@query(
    """WITH a AS (SELECT event_type || (user_id % 20) AS rule_id, ts::DATE AS f, CASE WHEN min(event_id) % 7 = 0 THEN NULL ELSE ts::DATE + (min(event_id) % 3)::INT END AS t FROM events GROUP BY event_type || (user_id % 20), ts::DATE),
s AS (SELECT *, max(coalesce(t, DATE '9999-12-31')) OVER (PARTITION BY rule_id ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r, row_number() OVER (PARTITION BY rule_id ORDER BY f) AS n, count(*) OVER (PARTITION BY rule_id) AS c FROM a)
SELECT rule_id, f AS day, 'empty' AS problem FROM s WHERE t <= f UNION ALL SELECT rule_id, f, 'overlap' FROM s WHERE r > f UNION ALL SELECT rule_id, f, 'gap' FROM s WHERE r < f UNION ALL SELECT rule_id, f, 'no first version' FROM s WHERE n = 1
UNION ALL SELECT rule_id, f, 'ends' FROM s WHERE n = c AND greatest(coalesce(r, DATE '0001-01-01'), coalesce(t, DATE '9999-12-31')) < DATE '9999-12-31'"""
)
def timeline_problems(spark, sf_dir):
    """What is wrong with versions that each say when they end."""
    e = table(spark, sf_dir, "events").groupBy(F.concat("event_type", (F.col("user_id") % 20).cast("string")).alias("rule_id"), F.to_date("ts").alias("valid_from")).agg(F.min("event_id").alias("e"))
    return timelines.problems(e.withColumn("valid_to", F.when(F.col("e") % 7 != 0, F.date_add("valid_from", (F.col("e") % 3).cast("int")))))


# --- answers ------------------------------------------------------------------------------------------------

TOPICS = [("fee", r"(?i)\bfee\b"), ("earnings", r"(?i)\bearnings\b"), ("limit", r"(?i)\bincome limit\b"), ("report", r"(?i)\breport(?:ed|ing)? a change\b"), ("cut", r"(?i)\bcut\b"), ("guard", r"(?i)\blate report\b")]
#: rule, and of each of four versions the day it came in and its parameters.
VERSIONS = [
    (rule, day, params)
    for rule, maps in {
        "fee": [{"monthly": m} for m in ("120", "175", "180", "210")],
        "earnings": [{"disregard": d} for d in ("10000", "20000", "35000", "50000")],
        "limit": [{"1": str(a), "2": str(a + 400), "3": str(a + 900), "additional": str(b)} for a, b in ((1180, 410), (1225, 425), (1300, 450), (1400, 500))],
        "report": [{"days": d} for d in ("10", "14", "21", "30")],
        "cut": [{"percent": p} for p in ("20", "15", "12", "10")],
        "guard": [{"there": x} for x in ("false", "true", "true", "false")],
    }.items()
    for day, params in zip((None, "2016-01-01", "2018-03-01", "2020-07-01"), maps, strict=True)
]
CASES = [
    ("fee", "fee", 1, "apportion", "claim_period", "monthly", None, None, None, "ANSWER", "From {period_start} to {period_end} the fee is {money} a month on average.", "By days."),
    ("fee", "fee", 2, "amount", "determination_date", "monthly", None, None, None, "ANSWER", "On {day} the fee is {$monthly}.", "In force from {from}."),
    ("earnings", "earnings", 1, "beyond", "determination_date", "disregard", r"(?i)\bcountable\b", ["amount"], None, "ANSWER", "Of {amount}, {money} counts beyond {$disregard}.", "Determined {day}."),
    ("earnings", "earnings", 2, "amount", "determination_date", "disregard", None, None, None, "ANSWER", "The first {$disregard} is disregarded.", "Determined {day}."),
    ("limit", "limit", 1, "table", "determination_date", "additional", None, ["size"], None, "ANSWER", "For {size}: {money}.", "Determined {day}."),
    ("limit", "limit", 2, "amount", "determination_date", "additional", None, None, None, "ANSWER", "1: {$1}; 2: {$2}; 3: {$3}; then {$additional} each.", "Determined {day}."),
    ("report", "report", 1, "deadline", "change_date", "days", None, ["awareness_date"], None, "ANSWER", "Within {=days} days of {anchor}, so by {due}.", "Changed {day}."),
    ("report", "report", 2, "deadline", "change_date", "days", None, None, None, "ANSWER", "Within {=days} days, so by {due}.", "Changed {day}."),
    ("cut", "cut", 1, "rate", "determination_date", "percent", None, None, None, "ANSWER", "A cut of {=percent}%.", "Determined {day}."),
    ("guard", "guard", 1, "in_force", "determination_date", "there", None, None, 0, "REFUSE", "There was no such rule on {day}.", "It came later."),
    ("guard", "guard", 2, "in_force", "determination_date", "there", None, None, None, "ANSWER", "The rule says {=there}.", "Determined {day}."),
]
#: A question for each order, dated by it, twenty years on.
_D = "date_format(add_months(o_orderdate, 240), '{0}')"
_ISO_D, _LONG_D = _D.format("yyyy-MM-dd"), _D.format("d MMMM yyyy")
QUESTIONS = f"""SELECT o_orderkey AS qid, CASE o_orderkey % 10 WHEN 0 THEN concat('What is the fee for a determination made on ', {_LONG_D}, '?') WHEN 1 THEN concat('Of $', CAST(CAST(floor(o_totalprice) AS INT) AS STRING), ' in earnings, what is countable? Determined ', {_ISO_D}, '.')
WHEN 2 THEN concat('What is the income limit for a household of ', CAST(1 + o_custkey % 7 AS STRING), ', determined on ', {_LONG_D}, '?') WHEN 3 THEN concat('When must a holder report a change? The change occurred on ', {_ISO_D}, '. It is not known whether any notice of it was given by anybody at all in that time. They became aware of it on ', date_format(date_add(add_months(o_orderdate, 240), CAST(o_custkey % 9 AS INT) - 3), 'yyyy-MM-dd'), '.')
WHEN 4 THEN concat('How large is the cut of $', CAST(CAST(floor(o_totalprice) AS INT) AS STRING), ' for a determination of ', {_ISO_D}, '?') WHEN 5 THEN concat('Does the late report rule hold? It was determined on ', {_LONG_D}, '.')
WHEN 6 THEN concat('What is the fee for the period from ', {_ISO_D}, ' through ', date_format(date_add(add_months(o_orderdate, 240), CAST(o_custkey % 900 AS INT) + 1), 'yyyy-MM-dd'), '?') WHEN 7 THEN 'What is the fee?' WHEN 8 THEN concat('Is the income limit known for a determination on ', {_ISO_D}, '?') ELSE 'Who keeps the list?' END AS question FROM orders"""


def _money_sql(x: str) -> str:
    return f"(CASE WHEN {x} = floor({x}) THEN '$' || format('{{:,}}', ({x})::BIGINT) ELSE '$' || format('{{:,.2f}}', ({x})::DOUBLE) END)"


def _long(x: str) -> str:
    return f"strftime({x}, '%-d %B %Y')"


_VALUES = ", ".join(f"('{r}', {i % 4}, {'NULL' if d is None else f'DATE {d!r}'}, {'NULL' if i % 4 == 3 else f'DATE {VERSIONS[i + 1][1]!r}'}, MAP {{{', '.join(f'{k!r}: {v!r}' for k, v in m.items())}}})" for i, (r, d, m) in enumerate(VERSIONS))
_O = f"""v AS (SELECT * FROM (VALUES {_VALUES}) x(rule, version, f, t, m)), o AS (SELECT o_orderkey AS qid, o_orderkey % 10 AS kind, (o_orderdate + INTERVAL 20 YEAR)::DATE AS d, floor(o_totalprice)::BIGINT AS price, o_custkey AS c FROM orders),
r AS (SELECT *, (CASE kind WHEN 0 THEN 'fee' WHEN 1 THEN 'earnings' WHEN 2 THEN 'limit' WHEN 3 THEN 'report' WHEN 4 THEN 'cut' WHEN 5 THEN 'guard' WHEN 6 THEN 'fee' WHEN 7 THEN 'fee' WHEN 8 THEN 'limit' END) AS topic, (d + (c % 9)::INT - 3)::DATE AS e, (d + (c % 900)::INT + 1)::DATE AS p FROM o WHERE kind < 9),
x AS (SELECT r.*, version, f, t, m, kind = 6 AND EXISTS (SELECT 1 FROM v b WHERE b.rule = 'fee' AND b.f > r.d AND b.f <= r.p) AS spans FROM r LEFT JOIN v ON rule = topic AND kind <> 7 AND (f IS NULL OR f <= d) AND (t IS NULL OR t > d)),
s AS (SELECT qid, sum((m['monthly'])::DOUBLE * n) / sum(n) AS a FROM (SELECT x.qid, v.m, least(x.p, coalesce(v.t - 1, x.p)) - greatest(x.d, coalesce(v.f, x.d)) + 1 AS n FROM x JOIN v ON v.rule = 'fee' AND spans AND (v.f IS NULL OR v.f <= x.p) AND (v.t IS NULL OR v.t > x.d)) GROUP BY qid),
z AS (SELECT x.*, a, CASE kind WHEN 0 THEN (m['monthly'])::DOUBLE WHEN 1 THEN greatest(0e0, price - (m['disregard'])::DOUBLE) WHEN 2 THEN CASE WHEN 1 + c % 7 <= 3 THEN (m[(1 + c % 7)::VARCHAR])::DOUBLE ELSE (m['3'])::DOUBLE + (1 + c % 7 - 3) * (m['additional'])::DOUBLE END WHEN 3 THEN (m['days'])::DOUBLE WHEN 4 THEN price * (m['percent'])::DOUBLE / 100
  WHEN 5 THEN (m['there'] = 'true')::INT::DOUBLE WHEN 6 THEN a WHEN 8 THEN (m['additional'])::DOUBLE END AS result, greatest(d, e) AS anchor FROM x LEFT JOIN s USING (qid))"""
_MISSING = "'Please provide the date the determination was made; which version of the rule applies depends on it.'"
_SAID = f"""CASE WHEN kind = 6 AND spans THEN 'From ' || {_long('d')} || ' to ' || {_long('p')} || ' the fee is ' || {_money_sql('result')} || ' a month on average.' WHEN kind IN (6, 7) THEN {_MISSING} WHEN kind = 0 THEN 'On ' || {_long('d')} || ' the fee is ' || {_money_sql('result')} || '.'
WHEN kind = 1 THEN 'Of ' || {_money_sql('price')} || ', ' || {_money_sql('result')} || ' counts beyond ' || {_money_sql("(m['disregard'])::DOUBLE")} || '.' WHEN kind = 2 THEN 'For ' || (1 + c % 7) || ': ' || {_money_sql('result')} || '.' WHEN kind = 3 THEN 'Within ' || m['days'] || ' days of ' || {_long('anchor')} || ', so by ' || {_long("(anchor + (m['days'])::INT)")} || '.'
WHEN kind = 4 THEN 'A cut of ' || m['percent'] || '%.' WHEN kind = 5 THEN CASE WHEN version = 0 THEN 'There was no such rule on ' || {_long('d')} || '.' ELSE 'The rule says ' || m['there'] || '.' END
ELSE '1: ' || {_money_sql("(m['1'])::DOUBLE")} || '; 2: ' || {_money_sql("(m['2'])::DOUBLE")} || '; 3: ' || {_money_sql("(m['3'])::DOUBLE")} || '; then ' || {_money_sql("(m['additional'])::DOUBLE")} || ' each.' END"""


@query(
    f"""WITH {_O} SELECT qid, topic, CASE WHEN kind = 7 OR (kind = 6 AND NOT spans) THEN 'missing_fact' ELSE 'resolved' END AS status, CASE WHEN kind = 7 OR (kind = 6 AND NOT spans) OR (kind = 5 AND version = 0) THEN 'REFUSE' ELSE 'ANSWER' END AS decision,
round(result, 6) AS result, CASE WHEN kind = 3 THEN strftime(anchor + (m['days'])::INT, '%Y-%m-%d') END AS due, {_SAID} AS answer FROM z"""
)
def rule_answers(spark, sf_dir):
    """H1-H3, H5, DT5-DT10, T19: an answer for every order's question, by all forms."""
    made = spark.sql(QUESTIONS.replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))
    versions = timelines.timeline(spark.createDataFrame(VERSIONS, "rule_id string, effective_date string, params map<string,string>").withColumn("effective_date", F.to_date("effective_date")))
    out = rules.evaluate(made, TOPICS, spark.createDataFrame(CASES, rules.CASES), versions)
    return out.select("qid", "topic", "status", "decision", F.round("result", 6).alias("result"), F.date_format("due", "yyyy-MM-dd").alias("due"), "answer")
