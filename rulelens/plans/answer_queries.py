"""Registered queries of how answers are put together and timed (W13, W14, M8), each beside SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.lexicon import DEFAULT
from ..operators import answers, evaluation, groups
from .catalog import _list, query, table
from .engine_queries import _made, _sql, _terms_sql

#: Five direct clauses for each order, their sections, terms, references and scores by arithmetic on its key.
DIRECT = """SELECT o_orderkey AS qid, CAST(k AS INT) AS pos, concat('c', CAST(k AS STRING)) AS chunk_id, concat(CAST(1 + (o_orderkey + k) % 3 AS STRING), '.1') AS section_id, concat(CAST(1 + (o_orderkey + k) % 3 AS STRING), '.1.', CAST(k AS STRING)) AS clause_id,
CASE (o_orderkey + 2 * k) % 4 WHEN 0 THEN ARR('2.1') WHEN 1 THEN ARR('1.1.4'; '3.1.2') ELSE ARR() END AS cross_references, CAST((o_orderkey * 7 + k * 5) % 11 AS INT) AS source_order, CAST(50 + (o_custkey * k + o_orderkey) % 45 AS DOUBLE) / 100e0 AS score, CAST((o_custkey + k * k) % 7 AS DOUBLE) / 10e0 AS ranking_score,
CASE (o_orderkey + o_custkey + k) % 5 WHEN 0 THEN ARR('rent'; 'water') WHEN 1 THEN ARR('plot'; 'day') WHEN 2 THEN ARR('water'; 'list'; 'plot') WHEN 3 THEN ARR('garden') ELSE ARR() END AS doc_terms, (o_custkey + k) % 3 = 0 AS numeric FROM {orders} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) x(k)"""
FIRST, SECOND = "How many days of water", "the plot list"
PARTS = f"""SELECT o_orderkey AS qid, CASE WHEN o_orderkey % 13 = 0 THEN 'Show clause 2.1.3' WHEN o_orderkey % 4 = 0 THEN 'Which exception applies?' ELSE 'What applies?' END AS question,
CASE o_custkey % 3 WHEN 0 THEN ARR('{FIRST}'; '{SECOND}') WHEN 1 THEN ARR('{SECOND}') ELSE ARR() END AS aspects FROM {{orders}}"""


def _fit(terms: str) -> str:
    wide, own = f"len(list_intersect({terms}, doc_terms)) / greatest(1, len({terms}))::DOUBLE", f"list_filter({terms}, lambda z: NOT list_contains({_list(DEFAULT.intent)}, z))"
    return f"CASE WHEN len({own}) > 0 THEN 0.70e0 * len(list_intersect({own}, doc_terms)) / len({own}) + 0.30e0 * {wide} ELSE {wide} END"


_A, _B = (f"(SELECT {x} FROM w)" for x in ("a", "b"))


@query(
    f"""WITH d AS ({_sql(DIRECT)}), p AS ({_sql(PARTS)}), w AS MATERIALIZED (SELECT {_terms_sql(f"'{FIRST}'")} AS a, {_terms_sql(f"'{SECOND}'")} AS b),
f AS (SELECT d.*, question, aspects, {_fit('w.a')} AS fa, {_fit('w.b')} AS fb FROM d JOIN p USING (qid) CROSS JOIN w),
s1 AS (SELECT qid, max(struct_pack(g := fa + 0.04e0 + numeric::INT * 0.28e0, s := score, r := ranking_score, l := -pos, fit := fa, section := section_id)) AS x FROM f WHERE len(aspects) = 2 GROUP BY qid),
t1 AS (SELECT f.*, CASE WHEN x.fit > 0 THEN -x.l END AS p1, CASE WHEN x.fit > 0 THEN x.section END AS c1 FROM f LEFT JOIN s1 USING (qid)),
s2 AS (SELECT qid, max(struct_pack(g := fb + CASE WHEN section_id = c1 THEN 0.30e0 ELSE 0 END + CASE WHEN pos IS DISTINCT FROM p1 THEN 0.04e0 ELSE 0 END, s := score, r := ranking_score, l := -pos, fit := fb)) AS x FROM t1 WHERE len(aspects) > 0 GROUP BY qid),
s3 AS (SELECT qid, max(struct_pack(s := score, r := ranking_score, l := -pos)) AS x FROM f GROUP BY qid), s4 AS (SELECT qid, max(struct_pack(s := score, l := -pos)) AS x FROM f GROUP BY qid),
q AS (SELECT t1.qid, any_value(question) AS question, list_distinct(list_filter(CASE WHEN any_value(len(aspects)) = 0 THEN [-any_value(s3.x.l)] ELSE [any_value(p1), CASE WHEN any_value(s2.x.fit) > 0 THEN -any_value(s2.x.l) END] END, lambda z: z IS NOT NULL)) AS u,
  CASE WHEN any_value(len(aspects)) > 0 AND any_value(p1) IS NOT NULL THEN any_value(p1) END AS head, -any_value(s4.x.l) AS last FROM t1 LEFT JOIN s2 USING (qid) JOIN s3 USING (qid) JOIN s4 USING (qid) GROUP BY t1.qid),
a AS (SELECT qid, question, last, u, head, (SELECT list(DISTINCT d.section_id) FROM d WHERE d.qid = q.qid AND list_contains(u, d.pos)) AS sections FROM q),
e AS (SELECT f.qid, f.pos, f.score, f.clause_id, f.section_id, f.cross_references, last, CASE WHEN list_contains(u, f.pos) THEN CASE WHEN len(u) = 2 AND f.pos IS DISTINCT FROM head THEN 1 ELSE 0 END WHEN contains(lower(a.question), 'exception') AND score >= 0.58e0 AND list_contains(sections, section_id) THEN 2 END AS step FROM f JOIN a USING (qid)),
n AS (SELECT qid, list_distinct(flatten(list(cross_references))) AS refs FROM e WHERE step IS NOT NULL GROUP BY qid),
h AS (SELECT e.*, coalesce(step, CASE WHEN score >= 0.58e0 AND (list_contains(refs, clause_id) OR list_contains(refs, section_id)) THEN 3 END) AS due FROM e LEFT JOIN n USING (qid)),
k AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY due, pos) AS pick FROM h WHERE due IS NOT NULL UNION ALL SELECT DISTINCT qid, last, 1 FROM h WHERE qid NOT IN (SELECT qid FROM h WHERE due IS NOT NULL)),
g AS (SELECT qid, pos, row_number() OVER (PARTITION BY qid ORDER BY source_order, pos) AS pick FROM f WHERE question LIKE 'Show%' AND clause_id = '2.1.3')
SELECT qid, 'c' || pos AS chunk_id, pick FROM k WHERE pick <= 6 AND qid NOT IN (SELECT qid FROM g) UNION ALL SELECT qid, 'c' || pos, pick FROM g"""
)
def source_picks(spark, sf_dir):
    """The clauses that each answer cites, one pick after the other."""
    out = answers.sources_by_aspect(_made(spark, sf_dir, DIRECT), _made(spark, sf_dir, PARTS))
    return out.select("qid", "chunk_id", F.col("pick").cast("long").alias("pick"))


@query(
    """WITH g AS (SELECT event_type, value * (1 + user_id % 7) AS x FROM events), p AS (SELECT * FROM (VALUES (0e0), (0.01e0), (0.5e0), (0.95e0), (1e0)) v(quantile)), r AS (SELECT event_type, x, row_number() OVER (PARTITION BY event_type ORDER BY x) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM g WHERE x IS NOT NULL)
SELECT event_type, quantile, n, round(x, 6) AS value FROM r JOIN p ON k = greatest(1, ceil(quantile * n))"""
)
def exact_percentiles(spark, sf_dir):
    """M8 without a buffer of values."""
    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") * (1 + F.col("user_id") % 7)).alias("x"))
    return evaluation.nearest_ranks(e, ["event_type"], "x", [0.0, 0.01, 0.5, 0.95, 1.0]).withColumn("value", F.round("value", 6))


_FOLD_ORDER = "list_transform(list_sort(list_transform(range(1, 6), lambda i: struct_pack(l := loads[i], f := i - 1))), lambda z: z.f)"


@query(
    f"""WITH RECURSIVE g AS MATERIALIZED (SELECT DISTINCT l_orderkey AS case_id, l_partkey || '/' || floor(date_diff('day', DATE '1990-01-01', l_shipdate::DATE) / 7e0)::BIGINT AS clause FROM lineitem),
e AS MATERIALIZED (SELECT DISTINCT x.case_id AS a, y.case_id AS b FROM g x JOIN g y USING (clause) WHERE x.case_id <> y.case_id),
r AS (SELECT DISTINCT case_id, case_id AS lead FROM g UNION SELECT e.b, r.lead FROM r JOIN e ON e.a = r.case_id),
m AS MATERIALIZED (SELECT case_id, min(lead) AS lead FROM r GROUP BY case_id),
s AS MATERIALIZED (SELECT lead, count(*) AS size, md5('42:' || lead) AS key FROM m GROUP BY lead),
k AS MATERIALIZED (SELECT size, count(*) AS held, row_number() OVER (ORDER BY size DESC) AS step FROM s GROUP BY size),
p AS (SELECT 0::BIGINT AS step, [0, 0, 0, 0, 0]::BIGINT[] AS loads, []::BIGINT[] AS due UNION ALL
  SELECT k.step, list_transform(range(1, 6), lambda i: (loads[i] + size * (held // 5 + CASE WHEN list_position({_FOLD_ORDER}, i - 1) <= held % 5 THEN 1 ELSE 0 END))::BIGINT), {_FOLD_ORDER} FROM p JOIN k ON k.step = p.step + 1),
n AS (SELECT s.*, held, due, row_number() OVER (PARTITION BY size ORDER BY key, lead) - 1 AS nth FROM s JOIN k USING (size) JOIN p USING (step))
SELECT case_id, lead, size, CASE WHEN nth < held - held % 5 THEN nth % 5 ELSE due[nth - (held - held % 5) + 1] END AS fold FROM m JOIN n USING (lead)"""
)
def clause_disjoint_folds(spark, sf_dir):
    """Orders as cases, whose clauses are parts by week of shipping, in five evenly full folds that share no clause."""
    week = F.floor(F.datediff("l_shipdate", F.lit("1990-01-01").cast("date")) / 7).cast("string")
    gold = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat_ws("/", F.col("l_partkey").cast("string"), week).alias("clause"))
    return groups.in_folds(evaluation.case_groups(gold), 5, 42).select("case_id", "lead", "size", F.col("fold").cast("long").alias("fold"))
