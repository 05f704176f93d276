"""Registered queries that run the engine's own operators, each beside SQL of its own.

Their clauses, questions and gradings are made from the driver's tables by plain SQL that both engines read: a clause for each
part, a question for each nation, and so on. Arrays are the one thing that the two spell differently, hence ``_both``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import text as T
from ..functions import vectors as V
from ..functions.lexicon import DEFAULT
from ..operators import answers, evaluation, evidence, expansion, reports, temporal
from ..sources import companions, documents
from .catalog import _bare_sql, _list, query, raw_sql, stem_sql, table, tokens_sql

_TABLES = ("part", "nation", "region", "orders", "supplier", "labels", "documents", "benchmark")


def _both(sql: str, spark: bool) -> str:
    """ARR(a; b) as each engine's array of strings."""
    out, rest = "", sql
    while (at := rest.find("ARR(")) >= 0:
        depth, end = 1, at + 4
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        items = [x.strip() for x in rest[at + 4 : end - 1].split(";") if x.strip()]
        body = ", ".join(items)
        made = (f"CAST(array({body}) AS array<string>)" if spark else f"[{body}]::VARCHAR[]")
        out, rest = out + rest[:at] + made, rest[end:]
    return out + rest


def _made(spark, sf_dir, sql: str):
    """The rows of a statement over the driver's tables."""
    args = {t: table(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql}
    return spark.sql(_both(sql, True), **args)


def _sql(sql: str) -> str:
    """The same statement for the other engine."""
    for t in _TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return _both(sql, False)


def _ident(n: str) -> str:
    return f"concat(CAST(CAST(floor(({n}) / 100e0) AS INT) AS STRING), '.', CAST(CAST(floor(({n}) / 10e0) AS INT) % 10 AS STRING))"


_N = "(p_partkey - 1)"
#: A clause for each part: its number gives part, section and place, its size the wording and the references.
CHUNKS = f"""SELECT concat('c', CAST(p_partkey AS STRING)) AS chunk_id, CAST(p_partkey AS INT) AS source_order, concat({_ident(_N)}, '.', CAST({_N} % 10 AS STRING)) AS clause_id,
{_ident(_N)} AS section_id, CAST(CAST(floor({_N} / 100e0) AS INT) AS STRING) AS part_id, CAST(p_partkey % 3 AS INT) AS document_index,
concat('manual:', CAST({_N} % 150 AS STRING)) AS source_locator,
CASE CAST(floor({_N} / 10e0) AS INT) % 5 WHEN 0 THEN 'Rent' WHEN 1 THEN 'Right of appeal' WHEN 2 THEN 'Resources' WHEN 3 THEN 'The award' ELSE 'Water' END AS section_title,
CASE p_size % 6 WHEN 0 THEN concat('A holder must pay rent within ', CAST(10 + p_size AS STRING), ' calendar days of the invoice.')
WHEN 1 THEN concat('A person is eligible for assistance where income is below $', CAST(100 * p_size AS STRING), '; the following conditions are checked.')
WHEN 2 THEN 'A person is not eligible for assistance unless the clerk agrees to the invoice.'
WHEN 3 THEN concat('The review period is ', CAST(p_size AS STRING), ' weeks, except where extended to ', CAST(1 + p_size % 3 AS STRING), ' months.')
WHEN 4 THEN 'Hoses must not be used at night, and rent may be refused.' ELSE 'The following evidence is accepted: (a) a lease; (b) an invoice for rent paid within 30 calendar days.' END AS text,
CASE p_size % 4 WHEN 0 THEN ARR(concat({_ident(f'({_N} + 7)')}, '.', CAST(({_N} + 7) % 10 AS STRING)); '99.9') WHEN 1 THEN ARR({_ident(f'({_N} + 20)')}) ELSE ARR() END AS cross_references FROM {{part}}"""
QUESTIONS = """SELECT n_nationkey AS qid, CASE n_nationkey % 10 WHEN 0 THEN 'How many days may a holder pay the rent invoice, including exceptions?' WHEN 1 THEN 'Is a person eligible for assistance?'
WHEN 2 THEN 'What evidence is accepted, and how long is the review period?' WHEN 3 THEN 'Will I be eligible for assistance with rent?' WHEN 4 THEN 'Is it allowed?' WHEN 5 THEN 'Show clause 0.3.2' WHEN 6 THEN 'Which exception applies to hoses at night, and to rent?'
WHEN 7 THEN 'How do I apply for assistance?' WHEN 8 THEN 'Where can I get help with rent?' ELSE 'What is the status of my appeal?' END AS question FROM {nation}"""
#: Six retrieved clauses of each question, with scores that differ.
PRIMARY = """SELECT n_nationkey AS qid, concat('c', CAST(p_partkey AS STRING)) AS chunk_id, CAST(p.pos AS INT) AS pos, 1e0 / (p.pos + 1) + n_nationkey / 1000e0 AS ranking_score, CAST(NULL AS STRING) AS neighbor_of
FROM {nation} CROSS JOIN (VALUES (1), (2), (3), (4), (5), (6)) p(pos) JOIN {part} ON p_partkey = 1 + (n_nationkey * 37 + p.pos * p.pos * 3) % 190"""
_WITH = f"WITH c AS ({_sql(CHUNKS)}), q AS ({_sql(QUESTIONS)}), s AS ({_sql(PRIMARY)})"


def _chunks(spark, sf_dir):
    return _made(spark, sf_dir, CHUNKS).withColumns({"raw_text": F.col("text"), "normalized_text": T.normalized_text(F.col("text")), "part_title": F.lit("Rules"), "inserts_clause_ids": F.array().cast("array<string>")})


def _terms_sql(x: str) -> str:
    """The expanded stems of a text as a list, by the lexicon's synonyms and phrases."""
    syn = "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in sorted(DEFAULT.synonyms.items())) + "}"
    pairs = f"list_transform(list_transform({raw_sql(x)}, lambda t: struct_pack(r := t, b := {_bare_sql('t')})), lambda p: struct_pack(r := p.r, s := {stem_sql('p.b')}))"
    stop = _list(DEFAULT.stop_words)
    kept = f"list_filter({pairs}, lambda p: NOT list_contains({stop}, p.r) AND NOT list_contains({stop}, p.s))"
    more = f"flatten(list_transform({kept}, lambda p: list_concat(coalesce({syn}[p.r], []), coalesce({syn}[p.s], []))))"
    said = "list_concat(" + ", ".join(["[]::VARCHAR[]"] + [f"CASE WHEN contains(lower({x}), '{k}') THEN {_list(v)} ELSE [] END" for k, v in DEFAULT.phrases.items()]) + ")"
    return f"list_distinct(list_concat(list_transform({kept}, lambda p: p.s), list_transform(list_concat({more}, {said}), lambda t: {stem_sql('t')})))"


# --- context expansion (J4-J9, R2, W11, W12) ----------------------------------------------------------

_PARENTS = "p AS (SELECT s.*, c.section_id, c.source_order, c.cross_references, q.question FROM s JOIN c USING (chunk_id) JOIN q USING (qid) WHERE pos <= 4)"


def _parents(spark, sf_dir):
    c = _chunks(spark, sf_dir)
    facts = c.select("chunk_id", "section_id", "source_order", "cross_references")
    return _made(spark, sf_dir, PRIMARY).where("pos <= 4").join(facts, "chunk_id").join(_made(spark, sf_dir, QUESTIONS), "qid"), c


_EDGES = """e AS (SELECT p.qid, o.chunk_id AS "to", p.ranking_score, p.chunk_id AS reason, 1 AS step, p.pos FROM p JOIN c o ON o.section_id = p.section_id AND abs(o.source_order - p.source_order) = 1
UNION ALL SELECT DISTINCT p.qid, o.chunk_id, p.ranking_score, p.chunk_id, 2, p.pos FROM p JOIN c o ON list_contains(p.cross_references, o.clause_id) OR list_contains(p.cross_references, o.section_id)
UNION ALL SELECT p.qid, o.chunk_id, p.ranking_score, 'exception:' || p.chunk_id, 3, p.pos FROM p JOIN c o ON o.section_id = p.section_id WHERE contains(lower(p.question), 'exception')"""


@query(f"""{_WITH}, {_PARENTS}, {_EDGES}) SELECT qid, "to" AS chunk_id, round(ranking_score, 6) AS score, reason, step FROM e""")
def context_edges(spark, sf_dir):
    """What the first clauses bring in."""
    p, c = _parents(spark, sf_dir)
    edges = expansion.neighbours(p, c).unionByName(expansion.references(p, c)).unionByName(expansion.exception_siblings(p, c))
    return edges.select("qid", F.col("to").alias("chunk_id"), F.round("ranking_score", 6).alias("score"), "reason", "step")


_TITLED = _list(expansion.PERSONAL_SECTIONS)
_OPERATIVE = f"""op AS (SELECT section_id, arg_max(chunk_id, struct_pack(k := (contains(lower(text), 'following') OR contains(lower(text), 'threshold') OR contains(lower(text), 'figure') OR contains(lower(text), 'conditions are'))::INT, o := -source_order)) AS "to"
FROM c WHERE list_contains({_TITLED}, lower(section_title)) GROUP BY section_id)"""


@query(f"""{_WITH}, {_OPERATIVE} SELECT section_id, "to" AS chunk_id FROM op""")
def clauses_of_intent(spark, sf_dir):
    return expansion.operative_clauses(_chunks(spark, sf_dir)).select("section_id", F.col("to").alias("chunk_id"))


_FINDING = {"id": "rent", "clause_ids": ["0.0.1", "0.0.5"], "context_clause_ids": ["0.1.3"], "topic_terms": ["rent invoice"], "trigger_patterns": ["rent invoice"]}


@query(
    f"""{_WITH}, {_PARENTS}, {_OPERATIVE}, {_EDGES} UNION ALL SELECT q.qid, op."to", s.ranking_score, 'intent:' || op.section_id, 4, 1 FROM q JOIN s ON s.qid = q.qid AND s.pos = 1 CROSS JOIN op WHERE regexp_matches(q.question, '{I.PERSONAL}')),
g AS (SELECT qid, "to" AS chunk_id, max(ranking_score * 0.92e0) AS inherited, arg_min(reason, struct_pack(step, pos, reason)) AS first_reason, arg_max(reason, struct_pack(step, pos, reason)) FILTER (WHERE reason LIKE 'intent:%') AS strong, min(struct_pack(step, pos, reason)) AS seen FROM e GROUP BY ALL),
a AS (SELECT coalesce(s.qid, g.qid) AS qid, coalesce(s.chunk_id, g.chunk_id) AS chunk_id, greatest(coalesce(s.ranking_score, 0), coalesce(inherited, 0)) AS score, coalesce(strong, CASE WHEN s.qid IS NULL THEN first_reason END) AS neighbor_of,
  coalesce(CASE WHEN s.qid IS NOT NULL THEN struct_pack(step := 0, pos := s.pos, reason := '') END, struct_pack(step := seen.step + 10, pos := seen.pos, reason := seen.reason)) AS seen FROM s FULL JOIN g ON s.qid = g.qid AND s.chunk_id = g.chunk_id),
f AS (SELECT chunk_id FROM c WHERE list_contains({_list(_FINDING['clause_ids'] + _FINDING['context_clause_ids'])}, clause_id)),
seed AS (SELECT qid, arg_min(score, seen) * 0.92e0 AS score FROM a SEMI JOIN f USING (chunk_id) SEMI JOIN (SELECT qid FROM q WHERE len(list_intersect({_terms_sql('question')}, {_terms_sql("'rent invoice'")})) >= CASE WHEN len({_terms_sql("'rent invoice'")}) <= 2 THEN 1 WHEN len({_terms_sql("'rent invoice'")}) <= 5 THEN 2 ELSE 3 END OR regexp_matches(question, '(?i)rent invoice')) USING (qid) GROUP BY qid),
b AS (SELECT coalesce(a.qid, x.qid) AS qid, coalesce(a.chunk_id, x.chunk_id) AS chunk_id, greatest(coalesce(a.score, 0), coalesce(x.score, 0)) AS score, CASE WHEN x.qid IS NOT NULL THEN 'finding:rent' ELSE a.neighbor_of END AS neighbor_of
  FROM a FULL JOIN (SELECT qid, chunk_id, score FROM seed CROSS JOIN f) x ON a.qid = x.qid AND a.chunk_id = x.chunk_id),
o AS (SELECT b.*, c.source_order, coalesce(regexp_matches(neighbor_of, '^(finding|intent):'), false) AS pinned FROM b JOIN c USING (chunk_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, pinned ORDER BY score DESC, source_order) AS nth, least(sum(pinned::INT) OVER (PARTITION BY qid), 12) AS pins FROM o),
k AS (SELECT * FROM n WHERE CASE WHEN pinned THEN nth <= 12 ELSE nth <= 12 - pins END)
SELECT qid, chunk_id, round(score, 6) AS score, neighbor_of, row_number() OVER (PARTITION BY qid ORDER BY score DESC, source_order) AS pos FROM k"""
)
def context_expand(spark, sf_dir):
    """R2 whole: edges, operative clauses, a finding, and the cut to the best with its pins."""
    q, s = _made(spark, sf_dir, QUESTIONS), _made(spark, sf_dir, PRIMARY)
    out = expansion.expand(q, s, s, _chunks(spark, sf_dir), [_FINDING])
    return out.select("qid", "chunk_id", F.round("score", 6).alias("score"), "neighbor_of", "pos")


# --- evidence (E2, F2-F7, G9-G12, C1-C3, J10-J13, W17, Z1, G22) ----------------------------------------

_FLAGS = {
    "numeric_question": I.NUMERIC_QUESTION, "list_question": I.LIST_QUESTION, "numeric_intent": I.NUMERIC_INTENT, "boolean_question": I.BOOLEAN_QUESTION, "classification_question": I.CLASSIFICATION_QUESTION,
    "exception_question": I.EXCEPTION_QUESTION, "continuation_question": I.CONTINUATION_QUESTION, "method_question": I.METHOD_QUESTION, "access_question": I.ACCESS_QUESTION, "access_topic": I.ACCESS_TOPIC, "compound": I.COMPOUND,
    "personal": I.PERSONAL, "follow_up": I.PRONOUN_FOLLOW_UP,
}
_PASSAGES = {
    "numeric_passage": I.NUMERIC_PASSAGE, "classification_passage": I.CLASSIFICATION_PASSAGE, "exception_passage": I.EXCEPTION_PASSAGE, "exception_scope": I.EXCEPTION_SCOPE, "continuation_passage": I.CONTINUATION_PASSAGE,
    "method_passage": I.METHOD_PASSAGE, "access_passage": I.ACCESS_PASSAGE, "ineligible": I.INELIGIBLE, "eligible": I.ELIGIBLE,
}


def _match(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern.replace(chr(39), chr(39) * 2)}')"


@query(f"{_WITH} SELECT qid, {', '.join(f'{_match('question', p)} AS {k}' for k, p in _FLAGS.items())}, {_match('question', I.INDIVIDUAL_DETERMINATION)} OR {_match('question', I.CASE_RECORD)} AS case_facts FROM q")
def question_flags(spark, sf_dir):
    """F2, F6."""
    q = _made(spark, sf_dir, QUESTIONS)
    return q.select("qid", *[F.col("question").rlike(p).alias(k) for k, p in _FLAGS.items()], I.needs_case_facts(F.col("question")).alias("case_facts"))


@query(f"{_WITH} SELECT chunk_id, {', '.join(f'{_match('text', p)} AS {k}' for k, p in _PASSAGES.items())} FROM c")
def clause_flags(spark, sf_dir):
    """F3."""
    return _chunks(spark, sf_dir).select("chunk_id", *[F.col("text").rlike(p).alias(k) for k, p in _PASSAGES.items()])


def _alignment_sql(q: str, t: str) -> str:
    m = _match
    listed = f"(contains({t}, '(a)') OR contains({t}, '|') OR {m(t, r'(?i)\bfollowing\b|\bmay be made\b')})"
    excepted = f"({m(q, I.EXCEPTION_QUESTION)} AND {m(t, I.EXCEPTION_PASSAGE)})"
    return f"""CASE WHEN {m(q, I.NUMERIC_QUESTION)} THEN CASE WHEN {m(t, I.NUMERIC_PASSAGE)} THEN 1e0 WHEN {excepted} THEN 0.9e0 WHEN {m(q, I.COMPOUND)} AND {m(t, I.MODALITY)} THEN 0.75e0 ELSE 0.2e0 END
WHEN {m(q, I.LIST_QUESTION)} THEN CASE WHEN {listed} THEN 1e0 ELSE 0.35e0 END WHEN {m(q, I.CLASSIFICATION_QUESTION)} AND NOT {m(q, I.COMPOUND)} THEN CASE WHEN {m(t, I.CLASSIFICATION_PASSAGE)} THEN 1e0 ELSE 0.25e0 END
WHEN {m(q, I.METHOD_QUESTION)} THEN CASE WHEN {m(t, I.METHOD_PASSAGE)} THEN 1e0 ELSE 0.2e0 END WHEN {m(q, I.ACCESS_QUESTION)} AND {m(q, I.ACCESS_TOPIC)} THEN CASE WHEN {m(t, I.ACCESS_PASSAGE)} THEN 1e0 ELSE 0.2e0 END
WHEN {m(q, I.CONTINUATION_QUESTION)} THEN CASE WHEN {m(t, I.CONTINUATION_PASSAGE)} THEN 1e0 ELSE 0.25e0 END WHEN {m(q, I.BOOLEAN_QUESTION)} THEN CASE WHEN {m(t, I.MODALITY)} THEN 1e0 ELSE 0.35e0 END
WHEN {excepted} THEN 0.95e0 WHEN {m(t, I.MODALITY)} OR {m(t, r'(?i)\bis\b|\bare\b')} THEN 0.8e0 ELSE 0.55e0 END"""


@query(f"{_WITH} SELECT qid, chunk_id, {_alignment_sql('question', 'text')} AS alignment FROM s JOIN q USING (qid) JOIN c USING (chunk_id)")
def answer_alignments(spark, sf_dir):
    """E2."""
    p = _made(spark, sf_dir, PRIMARY).join(_made(spark, sf_dir, QUESTIONS), "qid").join(_chunks(spark, sf_dir), "chunk_id")
    return p.select("qid", "chunk_id", I.answer_alignment(F.col("question"), F.col("text"), F.col("raw_text")).alias("alignment"))


@query(f"{_WITH} SELECT DISTINCT unnest({tokens_sql("section_title || ' ' || text")}) AS tok FROM c")
def clause_vocabulary(spark, sf_dir):
    """G9."""
    return evidence.vocabulary(_chunks(spark, sf_dir))


_PARTS_SQL = r"regexp_split_to_array(question, '(?i)\s*,\s*|\s+and\s+|\s+including\s+')"


@query(
    f"""{_WITH}, a AS (SELECT qid, question, unnest(list_transform({_PARTS_SQL}, lambda p: regexp_replace(trim(p, ' '), '(?i)^(?:and|including)\\s+', ''))) AS part FROM q WHERE {_match('question', T.ASPECT_HINT)}),
t AS (SELECT qid, list_filter({_terms_sql('part')}, lambda x: NOT list_contains({_list(DEFAULT.generic)}, x)) AS wide, len(list_filter(list_distinct({tokens_sql('part')}), lambda x: NOT list_contains({_list(DEFAULT.generic)}, x))) AS n FROM a),
m AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY qid) AS parts FROM t WHERE n > 0) WHERE parts > 1),
d AS (SELECT qid, chunk_id, list_distinct({tokens_sql("section_title || ' ' || text")}) AS terms FROM s JOIN c USING (chunk_id))
SELECT qid, chunk_id, round(max(CASE WHEN n IS NOT NULL THEN least(1e0, len(list_intersect(wide, terms)) / n::DOUBLE) END), 6) AS coverage FROM d LEFT JOIN m USING (qid) GROUP BY ALL"""
)
def aspect_coverages(spark, sf_dir):
    """G10."""
    p = _made(spark, sf_dir, PRIMARY).join(_made(spark, sf_dir, QUESTIONS), "qid").join(_chunks(spark, sf_dir), "chunk_id")
    terms = T.term_set(F.concat_ws(" ", "section_title", "text"))
    return p.withColumn("terms", terms).select("qid", "chunk_id", F.round(evidence.aspect_coverage(F.col("question"), F.col("terms")), 6).alias("coverage"))


_GROUPS = "SELECT n_nationkey AS qid, CAST(g AS INT) AS segment, CASE g WHEN 0 THEN ARR('rent'; 'invoice') WHEN 1 THEN ARR('eligible') ELSE ARR('review'; 'week') END AS concept FROM {nation} CROSS JOIN (VALUES (0), (1), (1), (2)) x(g) WHERE n_nationkey % 3 <> g"


@query(
    f"""{_WITH}, g AS ({_sql(_GROUPS)}), m AS (SELECT s.qid, s.chunk_id, g.segment, list_has_any(g.concept, list_distinct({tokens_sql('c.text')}))::INT AS hit FROM s JOIN c USING (chunk_id) JOIN g ON g.qid = s.qid),
e AS (SELECT qid, chunk_id, segment, sum(hit) / count(*)::DOUBLE AS share, max(hit) AS hit FROM m GROUP BY ALL) SELECT qid, chunk_id, round(max(share), 6) AS concept, max(hit) > 0 AS any_concept FROM e GROUP BY ALL"""
)
def concept_coverages(spark, sf_dir):
    """G11, over groups with as many rows as terms."""
    p = _made(spark, sf_dir, PRIMARY).join(_chunks(spark, sf_dir), "chunk_id").withColumn("doc_terms", T.term_set(F.col("text")))
    out = evidence.concept_coverage(p, _made(spark, sf_dir, _GROUPS))
    return out.select("qid", "chunk_id", F.round("concept", 6).alias("concept"), "any_concept")


#: Graded clauses of each question, as E1 gives them.
GRADED = """SELECT qid, chunk_id, CASE WHEN (qid + pos) % 4 = 0 THEN 'DIRECT' WHEN (qid + pos) % 4 = 1 THEN 'PARTIAL' WHEN qid % 7 = 6 THEN 'NONE' ELSE 'RELATED_ONLY' END AS support, ranking_score AS score FROM ({0}) z""".replace("{0}", PRIMARY)


@query(
    f"""{_WITH}, v AS ({_sql(GRADED)}), pt AS (SELECT qid, regexp_replace(trim(question, ' '), '{T.LEADING_INSTRUCTION.replace('(?=', '(?:')}', '') AS fq, question FROM q),
a AS (SELECT qid, list_filter(list_transform(regexp_split_to_array(fq, '{T.ASPECT_CUT}'), lambda p: regexp_replace(regexp_replace(p, '^[ ?.!]+|[ ?.!]+$', '', 'g'), '(?i)^(?:and|including)\\s+', '')), lambda p: p <> '' AND len({_terms_sql('p')}) > 0) AS x, question FROM pt),
w AS (SELECT qid, CASE WHEN {_match('question', T.ASPECT_HINT)} AND len(x) > 1 THEN x ELSE [] END AS aspects FROM a),
d AS (SELECT v.qid, list_distinct({tokens_sql("c.section_title || ' ' || c.text")}) AS terms FROM v JOIN c USING (chunk_id) WHERE support = 'DIRECT'),
b AS (SELECT u.qid, k, aspect, max(len(list_intersect({_terms_sql('aspect')}, terms)) / len({_terms_sql('aspect')})::DOUBLE) AS best FROM (SELECT qid, unnest(aspects) AS aspect, generate_subscripts(aspects, 1) AS k FROM w) u LEFT JOIN d ON d.qid = u.qid GROUP BY ALL)
SELECT w.qid, array_to_string(aspects, '|') AS aspects, coalesce((SELECT string_agg(aspect, '|' ORDER BY k) FROM b WHERE b.qid = w.qid AND coalesce(best, 0) < 0.20e0), '') AS missing FROM w"""
)
def missing_aspects(spark, sf_dir):
    """G12, T11, T13."""
    out = evidence.missing_aspects(_made(spark, sf_dir, QUESTIONS), _made(spark, sf_dir, GRADED), _chunks(spark, sf_dir))
    return out.select("qid", F.array_join("aspects", "|").alias("aspects"), F.array_join("missing", "|").alias("missing"))


CLASHES = "SELECT n_nationkey AS qid, concat('f', CAST(k AS STRING)) AS finding_id, CAST(10 - k AS INT) AS seq FROM {nation} CROSS JOIN (VALUES (1), (2)) x(k) WHERE n_nationkey % 5 = k"
GAPS = "SELECT n_nationkey AS qid, k AS seq, concat('gap ', CAST(k AS STRING)) AS explanation FROM {nation} CROSS JOIN (VALUES (3), (4)) x(k) WHERE n_nationkey % 6 = 5"
ASPECTS = "SELECT n_nationkey AS qid, ARR('a'; 'b') AS aspects, CASE WHEN n_nationkey % 8 = 2 THEN ARR('b') ELSE ARR() END AS missing FROM {nation}"


@query(
    f"""{_WITH}, v AS ({_sql(GRADED)}), e AS (SELECT qid, max(score) FILTER (WHERE support = 'DIRECT') AS best, bool_or(support IN ('PARTIAL', 'RELATED_ONLY')) AS related FROM v GROUP BY qid), k AS (SELECT DISTINCT qid FROM ({_sql(CLASHES)})),
g AS (SELECT qid, arg_min(explanation, seq) AS gap FROM ({_sql(GAPS)}) GROUP BY qid), m AS ({_sql(ASPECTS)}), r AS (SELECT q.qid, CASE WHEN {_match('question', I.PRONOUN_FOLLOW_UP)} OR (len({tokens_sql('question')}) > 0 AND len(list_filter({tokens_sql('question')}, lambda x: NOT list_contains({_list(DEFAULT.non_topical)}, x))) = 0 AND NOT {_match('question', I.LOOKUP)}) THEN 'underspecified'
WHEN k.qid IS NOT NULL THEN 'conflict' WHEN gap IS NOT NULL THEN 'gap' WHEN {_match('question', I.INDIVIDUAL_DETERMINATION)} OR {_match('question', I.CASE_RECORD)} THEN 'case_facts' WHEN best IS NULL THEN CASE WHEN related THEN 'related_only' ELSE 'no_support' END
WHEN len(missing) > 0 THEN 'partial' WHEN best < 0.58e0 THEN 'below_threshold' ELSE 'answer' END AS rule, best, gap FROM q LEFT JOIN e USING (qid) LEFT JOIN k USING (qid) LEFT JOIN g USING (qid) LEFT JOIN m USING (qid))
SELECT qid, CASE rule WHEN 'conflict' THEN 'CONFLICT' WHEN 'answer' THEN 'ANSWER' ELSE 'REFUSE' END AS decision, rule, round(best, 6) AS best_score, CASE WHEN rule = 'gap' THEN gap END AS gap FROM r"""
)
def decisions(spark, sf_dir):
    """Z1, the whole cascade."""
    out = evidence.decide(*(_made(spark, sf_dir, x) for x in (QUESTIONS, GRADED, CLASHES, GAPS, ASPECTS)))
    return out.select("qid", "decision", "rule", F.round("best_score", 6).alias("best_score"), F.when(F.col("rule") == "gap", F.col("reason")).alias("gap"))


@query(f"{_WITH}, v AS ({_sql(GRADED)}) SELECT qid, CASE WHEN min(score) >= 0.72e0 THEN 'HIGH' ELSE 'MEDIUM' END AS level FROM v WHERE support = 'DIRECT' GROUP BY qid")
def evidence_levels(spark, sf_dir):
    """G22."""
    return evidence.evidence_level(_made(spark, sf_dir, GRADED).where("support = 'DIRECT'"))


@query(f"SELECT qid, arg_min(finding_id, seq) AS finding_id FROM ({_sql(CLASHES)}) GROUP BY qid")
def first_conflicts(spark, sf_dir):
    """The conflict that an answer explains."""
    return evidence.first_conflict(_made(spark, sf_dir, CLASHES)).select("qid", "finding_id")


_QTY = "(?i)(\\$?[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?)\\s*(calendar\\s+days?|working\\s+days?|days?|weeks?|months?|years?|per\\s+cent|percent|%)"
_UNIT = "CASE WHEN lower(u) LIKE '%day%' THEN 'days' WHEN lower(u) LIKE '%week%' THEN 'weeks' WHEN lower(u) LIKE '%month%' THEN 'months' WHEN lower(u) LIKE '%year%' THEN 'years' ELSE 'percent' END"
KNOWN = "SELECT n_nationkey AS qid, ARR('c1'; 'c4') AS pair FROM {nation}"
MUTED = "SELECT '0.0.1' AS lo, '0.0.4' AS hi, '(?i)deadline' AS unless_pattern"


def _acts(x: str, negative: bool) -> str:
    if negative:
        return f"regexp_extract_all({x}, '(?i)\\b(?:must not|shall not|may not)\\s+(?:be\\s+)?([a-z]+)', 1)"
    return f"regexp_extract_all(regexp_replace({x}, '(?i)\\b(must|shall|may)\\s+not\\b', '-', 'g'), '(?i)\\b(?:must|shall|may)\\s+(?:be\\s+)?([a-z]+)', 1)"


@query(
    f"""{_WITH}, x AS (SELECT s.qid, s.pos, c.* FROM s JOIN c USING (chunk_id) WHERE pos <= 12), u AS (SELECT chunk_id, unit, list_sort(list(DISTINCT value)) AS vals FROM (SELECT chunk_id, {_UNIT} AS unit, replace(replace(v, '$', ''), ',', '') AS value FROM (SELECT chunk_id, unnest(regexp_extract_all(text, '{_QTY}', 1)) AS v, unnest(regexp_extract_all(text, '{_QTY}', 2)) AS u FROM c)) GROUP BY ALL),
p AS (SELECT a.qid, a.chunk_id AS ac, b.chunk_id AS bc, a.clause_id AS al, b.clause_id AS bl, a.text AS ta, b.text AS tb, a.section_id = b.section_id AS same, list_contains(a.cross_references, b.clause_id) OR list_contains(a.cross_references, b.section_id) OR list_contains(b.cross_references, a.clause_id) OR list_contains(b.cross_references, a.section_id) AS linked,
  list_filter(list_intersect(list_intersect(list_distinct({tokens_sql('a.text')}), list_distinct({tokens_sql('b.text')})), {_terms_sql('q.question')}), lambda t: true) AS shared, {_match('a.text', I.EXCEPTION_SCOPE)} OR {_match('b.text', I.EXCEPTION_SCOPE)} AS scoped, q.question, a.pos AS ap, b.pos AS bp
  FROM x a JOIN x b ON a.qid = b.qid AND a.pos < b.pos JOIN q ON q.qid = a.qid WHERE list_sort([a.chunk_id, b.chunk_id]) <> ['c1', 'c4']),
k AS (SELECT p.qid, ac, bc, min(x.unit) AS unit FROM p JOIN u x ON x.chunk_id = ac JOIN u y ON y.chunk_id = bc AND y.unit = x.unit AND y.vals <> x.vals GROUP BY ALL),
r AS (SELECT p.*, k.unit, {_match('question', I.NUMERIC_INTENT)} AND NOT (list_sort([al, bl]) = ['0.0.1', '0.0.4'] AND NOT {_match('question', '(?i)deadline')}) AND k.unit IS NOT NULL AND (linked OR len(list_filter(shared, lambda t: NOT list_contains({_list('day week month year period must may'.split())}, t))) >= 2) AND NOT (same AND scoped) AS numeric,
  ({_match('ta', I.INELIGIBLE)} AND {_match('tb', I.ELIGIBLE)} OR {_match('tb', I.INELIGIBLE)} AND {_match('ta', I.ELIGIBLE)} OR list_has_any(list_transform({_acts('ta', True)}, lambda z: lower(z)), list_transform({_acts('tb', False)}, lambda z: lower(z))) OR list_has_any(list_transform({_acts('tb', True)}, lambda z: lower(z)), list_transform({_acts('ta', False)}, lambda z: lower(z))))
  AND NOT scoped AND len(list_filter(shared, lambda t: NOT list_contains({_list('eligible eligibility ineligible must may not person applicant recipient household program assistance'.split())}, t))) > 0 AS polar FROM p LEFT JOIN k ON k.qid = p.qid AND k.ac = p.ac AND k.bc = p.bc)
SELECT qid, CASE WHEN numeric THEN 'numeric_' ELSE 'polarity_' END || substr(sha256(ac || '|' || bc || '|' || CASE WHEN numeric THEN unit ELSE 'polarity' END), 1, 10) AS finding_id, ac || ',' || bc AS chunk_ids, al || ',' || bl AS clause_ids, CASE WHEN numeric THEN 'NUMERIC' ELSE 'POLARITY' END AS basis,
CASE WHEN NOT numeric THEN 0.86e0 WHEN linked THEN 0.92e0 ELSE 0.82e0 END AS confidence FROM r WHERE numeric OR polar"""
)
def detected_conflicts(spark, sf_dir):
    """C1-C3, J10-J12, over the first clauses of each question."""
    out = evidence.detected_conflicts(*(_made(spark, sf_dir, x) for x in (QUESTIONS, PRIMARY)), _chunks(spark, sf_dir), _made(spark, sf_dir, KNOWN), _made(spark, sf_dir, MUTED))
    return out.select("qid", "finding_id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.array_join("clause_ids", ",").alias("clause_ids"), "basis", "confidence")


FINDINGS = """SELECT concat('k', CAST(r_regionkey AS STRING)) AS id, r_regionkey AS seq, 'Two rules clash.' AS explanation, CASE r_regionkey % 2 WHEN 0 THEN ARR('rent') ELSE ARR() END AS trigger_patterns, ARR('rent invoice'; 'eligible person') AS topic_terms,
ARR(concat('0.', CAST(r_regionkey AS STRING), '.3'); concat('0.', CAST(r_regionkey + 1 AS STRING), '.2')) AS clause_ids FROM {region}"""
#: What is retrieved for each question: every fifth clause of the first hundred, and all of the first twenty.
HAVE = "SELECT n_nationkey AS qid, concat('c', CAST(p_partkey AS STRING)) AS chunk_id FROM {nation} JOIN {part} ON p_partkey <= 60 AND (p_partkey + n_nationkey) % 3 <> 0"


def _plain(x: str) -> str:
    return f"regexp_replace(lower({x}), '[-–—]', ' ', 'g')"


_TOPIC = f"list_distinct(list_concat({_terms_sql(_plain("'rent invoice'"))}, {_terms_sql(_plain("'eligible person'"))}))"
_FINDS = f"""CASE WHEN len(f.trigger_patterns) > 0 THEN regexp_matches({_plain('q.question')}, '(?i)rent') ELSE contains({_plain('q.question')}, 'rent invoice') OR contains({_plain('q.question')}, 'eligible person')
OR len(list_intersect({_terms_sql(_plain('q.question'))}, {_TOPIC})) >= CASE WHEN len({_TOPIC}) <= 2 THEN 1 WHEN len({_TOPIC}) <= 5 THEN 2 ELSE 3 END END"""


@query(
    f"""{_WITH}, f AS ({_sql(FINDINGS)}), h AS ({_sql(HAVE)}), m AS (SELECT DISTINCT h.qid, f.id, x.clause FROM f CROSS JOIN q JOIN h ON h.qid = q.qid JOIN c ON c.chunk_id = h.chunk_id CROSS JOIN unnest(f.clause_ids) x(clause) WHERE c.clause_id = x.clause AND {_FINDS})
SELECT qid, id AS finding_id, array_to_string(f.clause_ids, ',') AS clause_ids FROM (SELECT qid, id, count(*) AS n FROM m GROUP BY ALL) JOIN f USING (id) WHERE n = 2"""
)
def curated_conflicts(spark, sf_dir):
    """Reviewed conflicts of which every side was retrieved."""
    out = evidence.curated_conflicts(_made(spark, sf_dir, QUESTIONS), _made(spark, sf_dir, HAVE), _chunks(spark, sf_dir), _made(spark, sf_dir, FINDINGS))
    return out.select("qid", "finding_id", F.array_join("clause_ids", ",").alias("clause_ids"))


# --- answers (J15, P9, U4, X1-X3, F9) -------------------------------------------------------------------


@query(f"{_WITH}, v AS ({_sql(GRADED)}) SELECT h.qid, h.chunk_id FROM ({_sql(HAVE)}) h ANTI JOIN v ON v.qid = h.qid AND v.chunk_id = h.chunk_id")
def unretrieved_sources(spark, sf_dir):
    """J15."""
    return answers.unretrieved(_made(spark, sf_dir, HAVE), _made(spark, sf_dir, GRADED))


DECIDED = """SELECT qid, question, CASE qid % 4 WHEN 0 THEN 'ANSWER' WHEN 1 THEN 'CONFLICT' ELSE 'REFUSE' END AS decision, 'no rule' AS reason, 'r' AS rule FROM ({0}) z""".replace("{0}", QUESTIONS)
CITED = "SELECT qid, pos AS pick, chunk_id, concat('note ', CAST(pos AS STRING)) AS explanation FROM ({0}) z WHERE pos <= qid % 3".replace("{0}", PRIMARY)
CONTACTS = "SELECT route, concat('Ask the ', route, ' desk.') AS next_step FROM (VALUES ('default'), ('eligibility'), ('appeals')) x(route)"


@query(
    f"""{_WITH}, d AS ({_sql(DECIDED)}), t AS (SELECT z.qid, string_agg('§' || c.clause_id || ': ' || c.text, chr(10) ORDER BY pick) AS body, count(*) AS n, arg_min(explanation, pick) AS note FROM ({_sql(CITED)}) z JOIN c USING (chunk_id) GROUP BY z.qid),
e AS (SELECT d.*, coalesce(n, 0) AS n, body, note, CASE WHEN decision = 'ANSWER' AND coalesce(n, 0) < 1 THEN 'no citation' WHEN decision = 'CONFLICT' AND coalesce(n, 0) < 2 THEN 'fewer than two sides' END AS error FROM d LEFT JOIN t USING (qid)),
g AS (SELECT *, CASE WHEN error IS NOT NULL THEN 'REFUSE' ELSE decision END AS final FROM e),
h AS (SELECT *, CASE WHEN final = 'CONFLICT' THEN 'conflict' WHEN regexp_matches(lower(question), '\\b(appeal|review|challenge|den(?:y|ied|ial)|refus)') THEN 'appeals' WHEN regexp_matches(lower(question), '\\b(eligib|qualif|apply|application|income|resource)') THEN 'eligibility' ELSE 'default' END AS route FROM g)
SELECT qid, final AS decision, CASE final WHEN 'ANSWER' THEN body WHEN 'CONFLICT' THEN note || chr(10) || body ELSE '{answers.UNKNOWN.replace(chr(39), chr(39) * 2)} ' || reason END AS answer, n AS citations, CASE WHEN final <> 'ANSWER' THEN 'Ask the ' || CASE route WHEN 'conflict' THEN 'default' ELSE route END || ' desk.' END AS next_step, error FROM h"""
)
def built_answers(spark, sf_dir):
    """X1, X3, F9, P9."""
    c = _chunks(spark, sf_dir)
    for name in answers.CITED:
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast("string"))
    cited = _made(spark, sf_dir, CITED).join(c.select("chunk_id", answers.citation().alias("citation")), "chunk_id").drop("chunk_id")
    out = answers.build(_made(spark, sf_dir, DECIDED), cited, _made(spark, sf_dir, CONTACTS))
    return out.select("qid", "decision", "answer", F.size("citations").cast("long").alias("citations"), "next_step", "error")


PROSE = """SELECT p_partkey AS qid, CASE p_partkey % 5 WHEN 0 THEN text WHEN 1 THEN concat(text, ' It costs $77.') WHEN 2 THEN concat(text, ' See §8.8.8.') WHEN 3 THEN 'Whales sing songs under cold northern lights.' ELSE 'Rent must be paid.' END AS prose, text AS source
FROM ({0}) z JOIN {part} ON chunk_id = concat('c', CAST(p_partkey AS STRING))""".replace("{0}", CHUNKS)
_NUMS = "list_transform(regexp_extract_all(regexp_replace({0}, '§[0-9]+\\.[0-9]+(?:\\.[0-9]+[A-Z]?)?', '', 'g'), '" + T.NUMBER + "'), lambda z: replace(z, ',', ''))"


@query(
    f"""WITH p AS ({_sql(PROSE)}) SELECT qid, CASE WHEN len(list_filter({_NUMS.replace('{0}', 'prose')}, lambda n: NOT list_contains({_NUMS.replace('{0}', 'source')}, n))) > 0 THEN 'invented number'
WHEN len(list_filter(regexp_extract_all(prose, '{T.SECTION_REF}', 1), lambda n: NOT list_contains(regexp_extract_all(source, '{T.SECTION_REF}', 1), n))) > 0 THEN 'invented clause'
WHEN len(list_intersect(list_distinct({tokens_sql('prose')}), list_distinct({tokens_sql('source')}))) / greatest(1, len(list_distinct({tokens_sql('prose')})))::DOUBLE < 0.55e0 THEN 'unsupported wording' END AS problem FROM p"""
)
def prose_problems(spark, sf_dir):
    """X2, U4."""
    return answers.validate_prose(_made(spark, sf_dir, PROSE)).select("qid", "problem")


# --- reports and sources (G5, G6, G8, J16, J17, S1, S12, S19, P1, P2, P5, P7) ------------------------------


@query(
    f"""{_WITH} SELECT document_index, count(*) AS chunks, count(DISTINCT part_id) AS parts, count(DISTINCT section_id) AS sections, count(DISTINCT clause_id) AS clauses, round(avg(length(text)), 6) AS mean_length, max(length(text)) AS max_length,
count(*) FILTER (WHERE len(cross_references) > 0) AS with_references FROM c GROUP BY ROLLUP (document_index)"""
)
def chunk_report(spark, sf_dir):
    """G5, G7."""
    return reports.corpus_report(_chunks(spark, sf_dir))


@query(f"{_WITH}, g AS (SELECT text, min(chunk_id) AS representative, count(*) AS n FROM c GROUP BY text HAVING count(*) > 1) SELECT chunk_id, representative, n FROM c JOIN g USING (text)")
def duplicate_members(spark, sf_dir):
    """G6 as rows."""
    return reports.duplicate_members(_chunks(spark, sf_dir))


@query(f"{_WITH} SELECT source_locator, count(*) AS n FROM c GROUP BY source_locator HAVING count(*) > 1")
def duplicate_locators(spark, sf_dir):
    """G8."""
    return reports.duplicate_locators(_chunks(spark, sf_dir))


@query(f"{_WITH}, r AS (SELECT chunk_id, unnest(cross_references) AS ref FROM c) SELECT chunk_id, ref FROM r WHERE ref NOT IN (SELECT clause_id FROM c) AND ref NOT IN (SELECT section_id FROM c)")
def unresolved_references(spark, sf_dir):
    """J16."""
    return reports.unresolved_references(_chunks(spark, sf_dir))


CASES = """SELECT CAST(p_partkey AS STRING) AS id, CASE WHEN p_partkey % 50 = 7 THEN ' ' WHEN p_partkey % 40 = 3 THEN 'The  same Question' ELSE concat('Question ', CAST(p_partkey AS STRING)) END AS question, CASE WHEN p_partkey % 30 = 4 THEN 'MAYBE' WHEN p_partkey % 2 = 0 THEN 'ANSWER' ELSE 'REFUSE' END AS expected_decision,
CASE WHEN p_partkey % 2 = 0 THEN ARR(concat('0.', CAST(p_size % 12 AS STRING), '.3')) ELSE ARR() END AS expected_clause_ids, CASE WHEN p_partkey % 9 = 0 THEN ARR('0.0.0') ELSE ARR(concat('0.', CAST(p_size % 12 AS STRING), '.3'); '0.1.1') END AS expected_evidence_clause_ids,
ARR() AS expected_source_locators, CASE WHEN p_partkey % 11 = 0 THEN ARR('manual:7'; 'manual:700') ELSE ARR() END AS expected_evidence_source_locators, ARR('rent'; 'RENT  invoice') AS expected_facts, ARR('free') AS forbidden_claims FROM {part}"""


@query(
    f"""WITH k AS ({_sql(CASES)}), own AS (SELECT id, CASE WHEN trim(id) = '' OR trim(question) = '' THEN 'blank id or question' WHEN expected_decision NOT IN ('ANSWER', 'CONFLICT', 'REFUSE') THEN 'unknown decision'
WHEN len(list_filter(expected_clause_ids, lambda x: NOT list_contains(expected_evidence_clause_ids, x))) > 0 THEN 'citation beyond the evidence' WHEN expected_decision <> 'REFUSE' AND len(expected_clause_ids) = 0 THEN 'no citation expected' END AS problem FROM k)
SELECT id, problem FROM own WHERE problem IS NOT NULL UNION ALL SELECT min(id), 'repeated' FROM k GROUP BY lower(regexp_replace(trim(question), '\\s+', ' ', 'g')) HAVING count(*) > 1"""
)
def case_problems(spark, sf_dir):
    """S12."""
    return companions.question_problems(_made(spark, sf_dir, CASES))


@query(f"""{_WITH}, k AS ({_sql(CASES)}), l AS (SELECT DISTINCT id, unnest(list_concat(list_concat(expected_clause_ids, expected_evidence_clause_ids), expected_evidence_source_locators)) AS label FROM k)
SELECT id, label FROM l WHERE label NOT IN (SELECT clause_id FROM c) AND label NOT IN (SELECT source_locator FROM c)""")
def unknown_labels(spark, sf_dir):
    """J17, U3."""
    return companions.unknown_labels(_made(spark, sf_dir, CASES), _chunks(spark, sf_dir))


# --- evaluation (V1-V3, U5, U6, G13, G20, G21, J19-J22, L1, L2, M10, N1, N3, P11, W15, W16) ---------------------

RESULTS = """SELECT CAST(p_partkey AS STRING) AS id, CASE p_size % 3 WHEN 0 THEN 'ANSWER' WHEN 1 THEN 'REFUSE' ELSE 'CONFLICT' END AS decision, CASE WHEN p_size % 3 = 1 THEN 'I don''t know.' ELSE concat('Pay the Rent   invoice of $', CAST(p_size AS STRING), CASE WHEN p_size % 7 = 0 THEN ' for free' ELSE '' END) END AS answer,
CASE WHEN p_size % 4 = 0 THEN '' ELSE 'Ask.' END AS next_step, CASE WHEN p_size % 13 = 0 THEN 'ANSWER' ELSE CASE p_size % 3 WHEN 0 THEN 'ANSWER' WHEN 1 THEN 'REFUSE' ELSE 'CONFLICT' END END AS trace_decision, ARR(concat('0.', CAST(p_size % 12 AS STRING), '.3'); '0.1.1') AS retrieved,
CASE WHEN p_size % 3 = 1 THEN ARR() WHEN p_size % 5 = 0 THEN ARR('9.9.9') ELSE ARR(concat('0.', CAST(p_size % 12 AS STRING), '.3'); '0.1.1') END AS cited, CASE WHEN p_size % 3 = 1 THEN ARR() ELSE ARR(concat('RENT invoice of $', CAST(CASE WHEN p_size % 6 = 0 THEN 1 ELSE p_size END AS STRING))) END AS excerpts,
ARR('manual:7'; 'manual:700') AS retrieved_locators, ARR() AS cited_locators, p_retailprice AS elapsed_ms FROM {part} WHERE p_partkey % 17 <> 5"""
_FOLD = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'), ' ')"
_SCORED = f"""k AS ({_sql(CASES)}), z AS ({_sql(RESULTS)}), j AS (SELECT k.*, z.* EXCLUDE (id), coalesce({_FOLD.replace('{0}', 'answer')}, '') AS ans, array_to_string(coalesce(excerpts, []), ' ') AS src FROM k LEFT JOIN z USING (id)),
f AS (SELECT *, list_filter(list_distinct(expected_evidence_clause_ids), lambda x: NOT list_contains(coalesce(retrieved, []), x)) AS me, list_filter(list_distinct(expected_clause_ids), lambda x: NOT list_contains(coalesce(cited, []), x)) AS mc,
  list_filter(expected_evidence_source_locators, lambda x: NOT list_contains(coalesce(retrieved_locators, []), x)) AS ml, list_filter(expected_facts, lambda x: NOT contains(ans, {_FOLD.replace('{0}', 'x')})) AS mf, list_filter(forbidden_claims, lambda x: contains(ans, x)) AS fb FROM j),
h AS (SELECT *, decision = 'REFUSE' OR (len(cited) > 0 AND len(list_filter(excerpts, lambda x: NOT contains(ans, {_FOLD.replace('{0}', 'x')}))) = 0 AND len(list_filter({_NUMS.replace('{0}', 'answer')}, lambda n: NOT list_contains({_NUMS.replace('{0}', 'src')}, n))) = 0) AS grounded FROM f),
v AS (SELECT *, decision IS NOT NULL AND trace_decision = decision AS c_trace, coalesce(decision = expected_decision, false) AS c_decision, decision IS NOT NULL AND len(me) = 0 AND len(ml) = 0 AS c_retrieval, decision IS NOT NULL AND len(mc) = 0 AS c_recall,
  decision IS NOT NULL AND len(cited) >= CASE decision WHEN 'ANSWER' THEN 1 WHEN 'CONFLICT' THEN 2 ELSE 0 END AND len(list_distinct(cited)) = len(cited) AND len(list_filter(cited, lambda x: NOT list_contains(retrieved, x))) = 0 AS c_intact, decision IS NOT NULL AND len(mf) = 0 AS c_facts, decision IS NOT NULL AND len(fb) = 0 AS c_forbidden,
  coalesce(grounded, false) AS c_grounded, decision IS NOT NULL AND (decision <> 'REFUSE' OR (contains(ans, 'i don''t know') AND next_step <> '')) AS c_contract, decision IS NOT NULL AND len(fb) = 0 AND grounded AND NOT (expected_decision <> 'ANSWER' AND decision = 'ANSWER') AS c_safe FROM h),
w AS (SELECT *, c_trace AND c_decision AND c_retrieval AND c_recall AND c_intact AND c_facts AND c_forbidden AND c_grounded AND c_contract AND c_safe AS overall, coalesce(decision, 'ERROR') AS actual FROM v)"""


def _scored(spark, sf_dir):
    return evaluation.score_cases(_made(spark, sf_dir, CASES), _made(spark, sf_dir, RESULTS))


@query(
    f"""WITH {_SCORED} SELECT id, expected_decision, actual AS actual_decision, overall AS overall_pass, CASE WHEN actual = 'ERROR' THEN 'PIPELINE_ERROR' ELSE array_to_string(list_filter([CASE WHEN NOT c_decision AND expected_decision = 'CONFLICT' THEN 'MISSED_CONFLICT' END, CASE WHEN NOT c_decision AND actual = 'CONFLICT' THEN 'FALSE_CONFLICT' END,
CASE WHEN NOT c_decision AND actual = 'ANSWER' THEN 'FALSE_ANSWER' END, CASE WHEN NOT c_decision AND actual = 'REFUSE' AND expected_decision = 'ANSWER' THEN 'FALSE_REFUSAL' END, CASE WHEN NOT c_retrieval THEN 'RETRIEVAL_MISS' END, CASE WHEN NOT (c_recall AND c_intact) THEN 'BAD_CITATION' END,
CASE WHEN NOT c_facts THEN 'INCOMPLETE_ANSWER' END, CASE WHEN NOT (c_forbidden AND c_grounded AND c_safe) THEN 'UNSUPPORTED_CLAIM' END, CASE WHEN NOT (c_trace AND c_contract) THEN 'CONTRACT_ERROR' END], lambda x: x IS NOT NULL), ',') END AS failures,
array_to_string(list_sort(me), ',') AS missing_evidence, array_to_string(list_sort(mc), ',') AS missing_citations, array_to_string(ml, ',') AS missing_locators, array_to_string(list_sort(mf), ',') AS missing_facts FROM w"""
)
def case_scores(spark, sf_dir):
    """V1-V3, U5, U6, F8, P11."""
    s = evaluation.audit_rows(_scored(spark, sf_dir))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return s.select(
        "id", "expected_decision", "actual_decision", "overall_pass", F.array_join("failure_types", ",").alias("failures"), joined("missing_evidence").alias("missing_evidence"), joined("missing_citations").alias("missing_citations"),
        joined("missing_evidence_locators").alias("missing_locators"), joined("missing_facts").alias("missing_facts"),
    )


_TOTALS = """count(*) AS cases, sum(overall::INT) AS passes, sum(c_decision::INT) AS decisions, sum(c_safe::INT) AS safe, sum((expected_decision <> 'ANSWER' AND actual = 'ANSWER')::INT) AS false_answers, sum((expected_decision <> 'ANSWER')::INT) AS not_answerable,
sum((expected_decision = 'CONFLICT')::INT) AS conflict_cases, sum((expected_decision = 'CONFLICT' AND actual = 'CONFLICT')::INT) AS conflict_hits, sum((expected_decision <> 'CONFLICT' AND actual = 'CONFLICT')::INT) AS false_conflicts, sum(len(list_distinct(expected_evidence_clause_ids))) AS evidence_total, sum(len(me)) AS evidence_missing"""
_RATE = "coalesce(round({0} / nullif({1}, 0)::DOUBLE, 4), 0)"


@query(
    f"""WITH {_SCORED}, t AS (SELECT {_TOTALS}, percentile_disc(0.95) WITHIN GROUP (ORDER BY elapsed_ms) AS p95 FROM w)
SELECT cases, passes, safe, false_answers, conflict_hits, false_conflicts, evidence_total, evidence_missing, p95, {_RATE.format('passes', 'cases')} AS strict_pass_rate, {_RATE.format('false_answers', 'not_answerable')} AS false_answer_rate, {_RATE.format('(evidence_total - evidence_missing)', 'evidence_total')} AS evidence_recall FROM t"""
)
def case_totals(spark, sf_dir):
    """G13, G17, M7."""
    return evaluation.totals(_scored(spark, sf_dir)).select("cases", "passes", "safe", "false_answers", "conflict_hits", "false_conflicts", "evidence_total", "evidence_missing", "p95", "strict_pass_rate", "false_answer_rate", "evidence_recall")


@query(f"WITH {_SCORED} SELECT actual AS actual_decision, count(*) AS cases FROM w GROUP BY actual")
def decision_counts(spark, sf_dir):
    """G20."""
    s = _scored(spark, sf_dir).select(F.array("actual_decision").alias("failure_types"))
    return evaluation.failures(s).withColumnRenamed("failure_type", "actual_decision")


_GRID = "(VALUES (0.42e0), (0.48e0), (0.53e0), (0.58e0), (0.63e0), (0.68e0), (0.74e0)) a(refusal) CROSS JOIN (VALUES (0.24e0), (0.29e0), (0.34e0), (0.40e0)) b(coverage)"


@query(
    f"""WITH {_SCORED}, g AS (SELECT w.* REPLACE (overall AND refusal <= 0.63e0 AND coverage >= 0.29e0 AS overall), refusal, coverage FROM w CROSS JOIN {_GRID}), t AS (SELECT refusal, coverage, {_TOTALS} FROM g GROUP BY refusal, coverage),
o AS (SELECT *, {_RATE.format('passes', 'cases')} + 0.25e0 * {_RATE.format('decisions', 'cases')} + 0.50e0 * {_RATE.format('safe', 'cases')} + 0.25e0 * {_RATE.format('conflict_hits', 'conflict_cases')} - 2e0 * {_RATE.format('false_answers', 'not_answerable')} AS objective FROM t)
SELECT refusal, coverage, passes, round(objective, 6) AS objective FROM o ORDER BY false_answers, conflict_cases - conflict_hits, passes DESC, decisions DESC, safe DESC, false_conflicts, objective DESC, abs(refusal - 0.58e0) + abs(coverage - 0.34e0), refusal, coverage LIMIT 1"""
)
def calibration(spark, sf_dir):
    """The chosen pair of thresholds, where two of the rates depend on them."""

    def evaluate(grid):
        s = _scored(spark, sf_dir).crossJoin(F.broadcast(grid))  # a grid of 28 rows
        return s.withColumn("overall_pass", F.col("overall_pass") & (F.col("refusal") <= 0.63) & (F.col("coverage") >= 0.29))

    return evaluation.calibrate(evaluate, spark)[1].select("refusal", "coverage", "passes", F.round("objective", 6).alias("objective"))


@query("SELECT o_orderpriority AS metric, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS stdev FROM orders GROUP BY ALL")
def seed_summary(spark, sf_dir):
    """G21, M10."""
    runs = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("metric"), F.col("o_totalprice").alias("value"))
    return evaluation.seed_summary(runs).select("metric", F.round("mean", 4).alias("mean"), F.round("stdev", 4).alias("stdev"))


SECOND = "SELECT n_nationkey AS case_id, concat('c', CAST(p_partkey AS STRING)) AS chunk_id, CAST(p.pos AS INT) AS rank FROM {nation} CROSS JOIN (VALUES (1), (2), (3), (4), (5)) p(pos) JOIN {part} ON p_partkey = 1 + (n_nationkey * 37 + p.pos * 12) % 190"
FIRST = "SELECT qid AS case_id, chunk_id, pos AS rank FROM ({0}) z".replace("{0}", PRIMARY)


@query(f"WITH u AS ({_sql(FIRST)} UNION ALL {_sql(SECOND)}), r AS (SELECT case_id, chunk_id, round(sum(1e0 / (60 + rank)), 12) AS rrf FROM u GROUP BY ALL) SELECT case_id, chunk_id, round(rrf, 9) AS rrf, row_number() OVER (PARTITION BY case_id ORDER BY rrf DESC, chunk_id) AS rank FROM r")
def rank_fusion(spark, sf_dir):
    """W15."""
    return evaluation.reciprocal_ranks(_made(spark, sf_dir, FIRST), _made(spark, sf_dir, SECOND)).select("case_id", "chunk_id", F.round("rrf", 9).alias("rrf"), "rank")


_GUARDED = """p AS (SELECT a.case_id, c.* FROM a JOIN c USING (chunk_id)), g AS (SELECT DISTINCT p.case_id, o.chunk_id FROM p JOIN c o ON o.section_id = p.section_id OR abs(o.source_order - p.source_order) <= 1 OR list_contains(p.cross_references, o.clause_id) OR list_contains(o.cross_references, p.clause_id))"""
_POSITIVES = f"a AS (SELECT case_id, chunk_id FROM ({_sql(SECOND)}) WHERE rank = 1)"


@query(f"{_WITH}, {_POSITIVES}, {_GUARDED} SELECT case_id, chunk_id FROM g")
def guarded_negatives(spark, sf_dir):
    """J19."""
    return evaluation.guarded(_made(spark, sf_dir, SECOND).where("rank = 1"), _chunks(spark, sf_dir))


_NEGATIVES = f"{_POSITIVES}, {_GUARDED}, n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, chunk_id) AS nth FROM (SELECT * FROM ({_sql(FIRST)}) f ANTI JOIN g ON g.case_id = f.case_id AND g.chunk_id = f.chunk_id))"


@query(f"{_WITH}, {_NEGATIVES} SELECT n.case_id, q.question AS anchor, x.text AS positive, y.text AS negative, x.clause_id AS positive_clause_id, y.clause_id AS negative_clause_id FROM n JOIN q ON q.qid = n.case_id JOIN a ON a.case_id = n.case_id JOIN c x ON x.chunk_id = a.chunk_id JOIN c y ON y.chunk_id = n.chunk_id WHERE nth <= 2")
def training_triplets(spark, sf_dir):
    """J20, J21."""
    c = _chunks(spark, sf_dir).withColumn("index_text", F.col("text"))
    pos = _made(spark, sf_dir, SECOND).where("rank = 1")
    neg = evaluation.hard_negatives(_made(spark, sf_dir, FIRST), pos, c, 2)
    return evaluation.triplets(_made(spark, sf_dir, QUESTIONS).withColumnRenamed("qid", "case_id"), pos, neg, c).select("case_id", "anchor", "positive", "negative", "positive_clause_id", "negative_clause_id")


@query(f"{_WITH}, {_NEGATIVES}, b AS (SELECT case_id, chunk_id, 1e0 AS label FROM a UNION ALL SELECT case_id, chunk_id, 0e0 FROM n WHERE nth <= 2) SELECT b.case_id, q.question AS query, c.text AS passage, label, c.clause_id FROM b JOIN q ON q.qid = b.case_id JOIN c USING (chunk_id)")
def labelled_pairs(spark, sf_dir):
    """N1."""
    c = _chunks(spark, sf_dir).withColumn("index_text", F.col("text"))
    pos = _made(spark, sf_dir, SECOND).where("rank = 1")
    neg = evaluation.hard_negatives(_made(spark, sf_dir, FIRST), pos, c, 2)
    return evaluation.labelled_pairs(_made(spark, sf_dir, QUESTIONS).withColumnRenamed("qid", "case_id"), pos, neg, c).select("case_id", "query", "passage", "label", "clause_id")


@query(f"{_WITH}, {_NEGATIVES} SELECT q.qid AS case_id, count(n.case_id) AS n FROM q LEFT JOIN n ON n.case_id = q.qid AND nth <= 6 GROUP BY q.qid HAVING count(n.case_id) < 6")
def short_of_negatives(spark, sf_dir):
    """Cases that cannot be trained on."""
    pos = _made(spark, sf_dir, SECOND).where("rank = 1")
    neg = evaluation.hard_negatives(_made(spark, sf_dir, FIRST), pos, _chunks(spark, sf_dir), 6)
    return evaluation.short_of_negatives(neg, _made(spark, sf_dir, QUESTIONS).withColumnRenamed("qid", "case_id"), 6)


_CASE_GOLD = "SELECT id AS case_id, expected_evidence_clause_ids FROM ({0}) z".replace("{0}", CASES)


@query(f"WITH k AS ({_sql(_CASE_GOLD)}), x AS (SELECT case_id, unnest(expected_evidence_clause_ids) AS id FROM k) SELECT DISTINCT 'clause' AS kind, a.id FROM x a JOIN x b USING (id) WHERE length(a.case_id) = 1 AND length(b.case_id) = 2")
def fold_overlaps(spark, sf_dir):
    """Gold clauses on both sides of a split."""
    k = _made(spark, sf_dir, _CASE_GOLD)
    return evaluation.fold_overlap(k.where("length(case_id) = 1"), k.where("length(case_id) = 2"))


METRICS = "SELECT CASE WHEN p_partkey % 2 = 0 THEN 'baseline' ELSE 'candidate' END AS side, CASE CAST(floor(p_partkey / 2e0) AS INT) % 3 WHEN 0 THEN 'recall_at_6' WHEN 1 THEN 'roc_auc' ELSE 'mrr' END AS metric, p_retailprice / 10000e0 AS value FROM {part}"


@query(
    f"""WITH m AS ({_sql(METRICS)}), g AS (SELECT metric, round(avg(value) FILTER (WHERE side = 'candidate') - avg(value) FILTER (WHERE side = 'baseline'), 6) AS gain FROM m GROUP BY metric),
r AS (SELECT (SELECT gain FROM g WHERE metric = 'recall_at_6') AS recall, (SELECT gain FROM g WHERE metric = 'roc_auc') AS auc) SELECT CASE WHEN recall > 0 AND auc >= 0 THEN 'ELIGIBLE_FOR_BLIND_VALIDATION' ELSE 'KEEP_PRETRAINED_BASELINE' END AS decision, recall AS recall_gain, auc AS auc_gain FROM r"""
)
def release_assessment(spark, sf_dir):
    """N3."""
    suites = spark.createDataFrame([("core", 0), ("adversarial", 0)], "suite string, failures int")
    out = evaluation.release_assessment(_made(spark, sf_dir, METRICS), suites)
    return out.select("decision", F.element_at("gains", F.lit("recall_at_6")).alias("recall_gain"), F.element_at("gains", F.lit("roc_auc")).alias("auc_gain"))


# --- text and numbers (P1, P2, P5, P7, T10, T12, T18, T20, T21, M6, H5) --------------------------------------


@query(
    f"""{_WITH}, d AS (SELECT chunk_id, clause_id, section_title, text, '**' || section_title || '**  `' || text || '` See §1.2.3, §' || clause_id || ' and §1.2.3.' AS raw FROM c)
SELECT chunk_id, trim(replace(replace(raw, '**', ''), '`', ''), ' ') AS display, trim(regexp_replace(replace(replace(raw, '**', ''), '`', ''), '\\s+', ' ', 'g'), ' ') AS normalized, array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '{T.SECTION_REF}', 1))), ',') AS refs,
'Hi ' || text || ' {{x}}' AS filled, replace(raw, '|', '\\|') AS cell FROM d"""
)
def text_forms(spark, sf_dir):
    """P1, P2, P5, T20, T21."""
    raw = F.concat(F.lit("**"), "section_title", F.lit("**  `"), "text", F.lit("` See §1.2.3, §"), "clause_id", F.lit(" and §1.2.3."))
    c = _made(spark, sf_dir, CHUNKS).withColumn("raw", raw)
    r = F.col("raw")
    return c.select("chunk_id", T.display_text(r).alias("display"), T.normalized_text(r).alias("normalized"), F.array_join(T.section_refs(r), ",").alias("refs"), T.fill_template("Hi {name} {x}", name=F.col("text")).alias("filled"), T.markdown_cell(r).alias("cell"))


@query(
    f"""{_WITH} SELECT chunk_id, concat_ws(' | ', 'Part ' || part_id || ': Rules', 'Section ' || section_id || ': ' || section_title, 'Clause ' || clause_id, text) AS index_text FROM c"""
)
def index_texts(spark, sf_dir):
    """P7."""
    return documents.index_text(_chunks(spark, sf_dir)).select("chunk_id", "index_text")


_W = "regexp_extract_all(lower(text), '[a-z0-9]+(?:\\.[0-9]+)*')"


@query(f"SELECT item_id, f, count(*) AS n FROM (SELECT item_id, unnest(list_concat({_W}, list_transform(range(1, len({_W})), lambda i: {_W}[i] || '::' || {_W}[i + 1]))) AS f FROM benchmark) GROUP BY ALL")
def feature_words(spark, sf_dir):
    """T10."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.feature_words(F.col("text"))).alias("f"))
    return b.groupBy("item_id", "f").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_orderkey, '$' || CASE WHEN v = floor(v) THEN format('{:,.0f}', v) ELSE format('{:,.2f}', v) END AS money, strftime(o_orderdate, '%-d %B %Y') AS day FROM (SELECT *, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice) ELSE round(o_totalprice, 2) END AS v FROM orders)")
def money_and_dates(spark, sf_dir):
    """T18."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_orderkey") % 2 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.round("o_totalprice", 2)))
    return o.select("o_orderkey", T.money(F.col("v")).alias("money"), T.long_date(F.to_date("o_orderdate")).alias("day"))


@query("SELECT event_id, round(1 / (1 + exp(-greatest(-20e0, least(20e0, value - 50)))), 6) AS p FROM events")
def logistic_squash(spark, sf_dir):
    """M6."""
    return table(spark, sf_dir, "events").select("event_id", F.round(V.squash(F.col("value") - 50), 6).alias("p"))


@query(
    """SELECT p_partkey, greatest(0e0, p_retailprice - 1000) AS countable, CASE WHEN 1 + p_size % 9 <= 5 THEN 100e0 * (1 + p_size % 9) ELSE 500e0 + (1 + p_size % 9 - 5) * 60e0 END AS threshold, 1 + p_size % 9 AS size FROM part"""
)
def rule_amounts(spark, sf_dir):
    """H5, T19."""
    params = F.create_map(*[F.lit(x) for k, v in [*((str(i), str(100 * i)) for i in range(1, 6)), ("additional", "60")] for x in (k, v)])
    said = F.concat(F.lit("a household of "), (1 + F.col("p_size") % 9).cast("string"))
    p = table(spark, sf_dir, "part").withColumn("size", T.household_size(said))
    return p.select("p_partkey", temporal.countable(F.col("p_retailprice"), F.lit(1000.0)).alias("countable"), temporal.threshold(params, F.col("size")).alias("threshold"), "size")
