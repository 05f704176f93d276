"""Registered queries of retrieval as a whole, and of the models behind it (R1, J8, W5-W10, X10, X11), each beside SQL.

Their models are deterministic and local, with a limit on what they take, as hosted ones have: what is beyond it becomes an error
of its row. So batches, halving, optional reranking and the order that follows from it are compared with SQL in full.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions import text as T
from ..functions import vectors as V
from ..functions.lexicon import DEFAULT
from ..operators import models, retrieval
from .ask import settled_table
from .catalog import _TOKENS, _bare_sql, query, stem_sql, table, tokens_sql
from .engine_queries import _made, _match, _sql, _terms_sql

#: The longest text that the local encoder takes, and the longest question of the local scorer.
LONGEST_TEXT, LONGEST_QUESTION = 20_000, 420


class Letters(models.Backend):
    """An encoder of four dimensions: how often a blank, an a, an e and a t stand in a text."""

    name, dimension = "letters", 4

    def open(self, kind: str):
        def call(texts: list[str]) -> list[list[int]]:
            if max(map(len, texts)) > LONGEST_TEXT:
                raise ValueError("too long")
            return [[t.count(c) for c in " aet"] for t in texts]

        return call


class PassageLength(models.Scorer):
    """A scorer whose logit follows a passage's length."""

    name = "passage length"

    def open(self):
        def call(pairs: list[tuple[str, str]]) -> list[float]:
            if max(len(q) for q, _ in pairs) > LONGEST_QUESTION:
                raise ValueError("too long")
            return [len(p) % 41 / 10 - 2 for _, p in pairs]

        return call


_COUNTED = ", ".join(f"(length(text) - length(replace(text, '{c}', '')))::DOUBLE" for c in " aet")


@query(
    f"""WITH n AS (SELECT doc_id, CASE WHEN NOT coalesce(regexp_matches(text, '\\S'), false) THEN 'blank' WHEN length(text) > {LONGEST_TEXT} THEN 'ValueError' END AS error, [{_COUNTED}] AS x FROM documents),
u AS (SELECT doc_id, error, CASE WHEN error IS NULL THEN CASE WHEN list_sum(x) > 0 THEN list_transform(x, lambda v: (v / sqrt(list_inner_product(x, x)))::FLOAT::DOUBLE) ELSE x END END AS v FROM n)
SELECT doc_id, error, round(v[1], 5) AS blanks, round(v[2], 5) AS a, round(v[3], 5) AS e, round(v[4], 5) AS t FROM u"""
)
def model_embeddings(spark, sf_dir):
    """Whole texts through a backend."""
    out = models.embedded(table(spark, sf_dir, "documents").select("doc_id", "text"), F.col("text"), Letters())
    part = lambda i: F.round(F.col("embedding")[i].cast("double"), 5)
    return out.select("doc_id", F.col("embedding_error").alias("error"), part(0).alias("blanks"), part(1).alias("a"), part(2).alias("e"), part(3).alias("t"))


#: A clause for each document, under numbers and titles of its own.
CLAUSES = """SELECT doc_id AS chunk_id, doc_id AS source_order, text, text AS raw_text, text AS index_text, concat('7.', CAST(doc_id % 90 AS STRING)) AS section_id, concat('7.', CAST(doc_id % 90 AS STRING), '.', CAST(CAST(floor(doc_id / 90e0) AS BIGINT) AS STRING)) AS clause_id,
CASE doc_id % 4 WHEN 0 THEN 'Right of appeal' WHEN 1 THEN 'Income and resources' WHEN 2 THEN 'Days of notice' END AS section_title FROM {documents}"""
#: A question for each benchmark item: its words after an opening that an intent knows.
ASKED = """SELECT item_id AS qid, concat(CASE item_id % 5 WHEN 0 THEN 'How many days may I apeal? ' WHEN 1 THEN 'What documents are listed? ' WHEN 2 THEN 'May I appeal under §7.5.2 or §7.61? ' WHEN 3 THEN 'What is the income limit? ' ELSE 'Tell me more: ' END, text) AS question FROM {benchmark}"""
_DENSE = """u AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings), many AS (SELECT count(*) AS m FROM embeddings),
qv AS (SELECT qid, v FROM q, many, u WHERE vec_id = qid * 7 % m), cv AS (SELECT chunk_id, v FROM c, many, u WHERE vec_id = chunk_id % m),
dr AS (SELECT qid, chunk_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM (SELECT qid, chunk_id, round(list_inner_product(qv.v, cv.v), 9) AS score FROM qv CROSS JOIN cv)),
dn AS (SELECT qid, chunk_id, greatest(0e0, least(1e0, score)) AS vector_score, rank AS vector_rank FROM dr WHERE rank <= 18)"""
_LEXICAL = f"""d AS MATERIALIZED ({_TOKENS}), dl AS (SELECT doc_id, len(toks) AS dl FROM d), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
p AS MATERIALIZED (SELECT doc_id, tok, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS tok FROM d) GROUP BY ALL), f AS MATERIALIZED (SELECT tok, count(*) AS df FROM p GROUP BY tok),
t0 AS MATERIALIZED (SELECT DISTINCT qid, unnest(terms) AS tok FROM qt), rt AS (SELECT tok, {stem_sql('b')} AS root FROM (SELECT DISTINCT tok, {_bare_sql('tok')} AS b FROM t0)),
lost AS (SELECT * FROM rt WHERE length(root) >= 5 AND NOT regexp_matches(replace(root, '.', ''), '^[0-9]+$') AND root NOT IN (SELECT tok FROM f)),
fix AS (SELECT lost.tok, min(f.tok) AS word FROM lost JOIN f ON substr(f.tok, 1, 1) = substr(root, 1, 1) AND abs(length(f.tok) - length(root)) <= 1
  WHERE levenshtein(f.tok, root) = 1 OR (length(f.tok) = length(root) AND f.tok <> root AND len(list_filter(range(1, length(root)), lambda i: substr(root, 1, i - 1) || substr(root, i + 1, 1) || substr(root, i, 1) || substr(root, i + 2) = f.tok)) > 0) GROUP BY lost.tok HAVING count(DISTINCT f.tok) = 1),
tm AS (SELECT qid, tok FROM t0 UNION SELECT qid, word FROM t0 JOIN fix USING (tok)),
sc AS (SELECT qid, p.doc_id AS chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1e0)))), 9) AS score FROM tm JOIN p USING (tok) JOIN f USING (tok) JOIN dl ON dl.doc_id = p.doc_id CROSS JOIN st GROUP BY qid, p.doc_id),
lx AS (SELECT qid, chunk_id, score / top AS lexical_score, rank AS lexical_rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank, max(score) OVER (PARTITION BY qid) AS top FROM sc WHERE score > 0) WHERE rank <= 18)"""
_BOOST = f"""(CASE WHEN list_contains(refs, clause_id) OR list_contains(refs, section_id) THEN 0.35e0 ELSE 0 END + CASE WHEN {_match('question', I.NUMERIC_QUESTION)} AND {_match('text', I.NUMERIC_PASSAGE)} THEN 0.08e0 ELSE 0 END
+ CASE WHEN {_match('question', I.LIST_QUESTION)} AND (contains(text, '(a)') OR contains(text, '|')) THEN 0.06e0 ELSE 0 END + least(0.16e0, 0.08e0 * len(list_intersect(terms, list_distinct({tokens_sql("coalesce(section_title, '')")}))))
+ CASE WHEN list_contains(terms, 'appeal') AND lower(section_title) = 'right of appeal' THEN 0.18e0 ELSE 0 END)"""
_FUSED = f"""c AS ({_sql(CLAUSES)}), q AS ({_sql(ASKED)}), qt AS MATERIALIZED (SELECT qid, question, {_terms_sql('question')} AS terms, list_distinct(regexp_extract_all(question, '{T.POLICY_ID}', 1)) AS refs FROM q), {_DENSE}, {_LEXICAL},
b AS (SELECT *, round((coalesce(1e0 / (60 + vector_rank), 0) + coalesce(1e0 / (60 + lexical_rank), 0)) / (2e0 / 61), 9) AS rrf FROM dn FULL JOIN lx USING (qid, chunk_id)),
fu AS (SELECT b.*, question, text, section_title, round(least(1e0, 0.84e0 * coalesce(lexical_score, 0) + 0.10e0 * coalesce(vector_score, 0) + 0.06e0 * rrf + {_BOOST}), 9) AS fused FROM b JOIN qt USING (qid) JOIN c USING (chunk_id)),
hd AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, vector_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS head FROM fu),
rr AS (SELECT *, CASE WHEN head <= 8 AND length(question) <= {LONGEST_QUESTION} THEN 0.65e0 / (1 + exp(-(length(coalesce(section_title, 'None') || '. ' || text) % 41 / 10e0 - 2))) + 0.35e0 * fused END AS reranked FROM hd)"""


def _sides(spark, sf_dir):
    clauses = _made(spark, sf_dir, CLAUSES)
    e = table(spark, sf_dir, "embeddings").select("vec_id", V.normalized(F.col("embedding")).alias("embedding"))
    many = e.count()
    asked = _made(spark, sf_dir, ASKED)
    with_vector = lambda df, at: df.withColumn("vec_id", at % many).join(e, "vec_id").drop("vec_id")
    return with_vector(asked, F.col("qid") * 7), clauses, with_vector(clauses.select("chunk_id"), F.col("chunk_id"))


def _hybrid(spark, sf_dir):
    questions, clauses, vectors = _sides(spark, sf_dir)
    return retrieval.hybrid(questions, clauses, scorer=PassageLength(), settle=settled_table, vectors=vectors)


@query(f"WITH {_FUSED} SELECT qid, chunk_id AS doc_id, vector_rank, lexical_rank, round(fused, 6) AS fused, round(reranked, 6) AS reranked FROM rr")
def hybrid_candidates(spark, sf_dir):
    """Every candidate, boosted, its head rescored where the scorer takes the question."""
    every, _ = _hybrid(spark, sf_dir)
    return every.select("qid", F.col("chunk_id").alias("doc_id"), "vector_rank", "lexical_rank", F.round("fused_score", 6).alias("fused"), F.round("reranker_score", 6).alias("reranked"))


@query(
    f"""WITH {_FUSED}, po AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY coalesce(reranked, fused) DESC, vector_rank NULLS LAST, lexical_rank NULLS LAST, chunk_id) AS pos FROM rr),
sl AS (SELECT *, CASE WHEN lexical_rank = 1 AND pos > 6 THEN 5.5e0 ELSE pos END AS slot FROM po), pn AS (SELECT qid, unnest(refs) AS clause_id, generate_subscripts(refs, 1) AS pin FROM qt),
px AS (SELECT qid, chunk_id, min(struct_pack(pin, clause_id)) AS x FROM pn JOIN c USING (clause_id) GROUP BY ALL), j AS (SELECT qid, chunk_id, x, slot, CASE WHEN x IS NULL THEN coalesce(reranked, fused) ELSE 1 END AS score FROM sl FULL JOIN px USING (qid, chunk_id)),
z AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY x.pin NULLS LAST, slot NULLS LAST, chunk_id) AS pos FROM j)
SELECT qid, chunk_id AS doc_id, pos, 'exact:' || x.clause_id AS neighbor_of, round(score, 6) AS score FROM z WHERE pos <= 6"""
)
def hybrid_selection(spark, sf_dir):
    """What each question keeps: exact references first, then the best, the lexical anchor among them."""
    _, final = _hybrid(spark, sf_dir)
    return final.select("qid", F.col("chunk_id").alias("doc_id"), "pos", "neighbor_of", F.round("ranking_score", 6).alias("score"))
