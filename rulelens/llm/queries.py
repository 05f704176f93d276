"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

import secrets
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, conversation_repair, decontamination, embedding_dedup, hard_negative_mining, license_scan, minhash_dedup, mixing, pii, quality
from . import secret_scan, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = "word_bpe_49k.json", folder: str | None = None) -> str:
    """The place of a public vocabulary file, in ``folder`` or where the files are installed; nothing is copied from it."""
    if folder is not None:
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def near_duplicate_scheme() -> minhash_dedup.Scheme:
    """The contract's: three-word shingles, linked at 85 hundredths."""
    return minhash_dedup.Scheme(shingle=3, numerator=85, denominator=100)


def op1_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_duplicate_scheme())


def op3_warc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.roundtrip(table(spark, sf_dir, "pages"))


#: Where a deployment puts its key; without one each run draws a key of its own, and its surrogates are good for that run.
KEY_SETTING = "spark.rulelens.surrogate.key"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with surrogates, under the key of the session's ``KEY_SETTING``."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return pii.anonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.stale_reply_pairs(table(spark, sf_dir, "conversations"))


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenize(table(spark, sf_dir, "documents"), vocabulary())


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_spans")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.damaged_and_repaired(table(spark, sf_dir, "conversations"))


def op12_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100, against all rows."""
    vectors = hard_negative_mining.relabelled(table(spark, sf_dir, "embeddings"))
    return hard_negative_mining.mine(vectors, F.col("vec_id") % 100 == 0)


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.col("targets")[0].alias("target"), F.col("taken")[0].alias("taken"))


def queries() -> dict:
    here = vars(sys.modules[__name__])
    found = {k: f for k, f in here.items() if k.startswith("op") and k[2:3].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Smallest node reachable over links(a, b) from each of nodes(id).
_COMPONENTS = """sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, c) AS (SELECT id, id FROM nodes UNION SELECT r.id, s.b FROM reach r JOIN sym s ON s.a = r.c), comp AS (SELECT id, min(c) AS component_id FROM reach GROUP BY id)"""
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{0}')"

_ORACLE = {
    "op1_embedding_near_dedup": f"""WITH RECURSIVE nodes AS (SELECT vec_id AS id FROM embeddings),
u AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id < y.vec_id AND x.n > 0 AND y.n > 0 WHERE list_inner_product(x.v, y.v) / x.n / y.n >= 0.93e0),
{_COMPONENTS} SELECT id AS vec_id, (SELECT count(*) FROM sym WHERE sym.a = id) AS n_links, component_id, id = component_id AS kept FROM comp""",
    "op2_minhash_near_dedup": f"""WITH RECURSIVE nodes AS (SELECT doc_id AS id FROM documents), w AS (SELECT doc_id, {_WORDS.format('[^\\x20\\x09-\\x0D]+')} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id HAVING 100 * count(*) >= 85 * ((SELECT n FROM n WHERE n.doc_id = x.doc_id) + (SELECT n FROM n WHERE n.doc_id = y.doc_id) - count(*))),
{_COMPONENTS} SELECT id AS doc_id, coalesce(n, 0) AS n_shingles, component_id, id = component_id AS kept FROM comp LEFT JOIN n ON n.doc_id = id""",
    "op8_decontamination": f"""WITH d AS (SELECT doc_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM documents), i AS (SELECT item_id, {_WORDS.format('[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')} AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS k, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda p: array_to_string(w[p:p + least(13, len(w)) - 1], ' '))) AS t FROM i WHERE len(w) > 0),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) AS t FROM d CROSS JOIN (SELECT DISTINCT k FROM iw) WHERE len(w) >= k),
m AS (SELECT dw.doc_id, dw.p, dw.k, iw.item_id FROM dw JOIN iw ON dw.t = iw.t AND dw.k = iw.k), h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + k)) AS q FROM m) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * n_hit >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op12_hard_negative_mining": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS alike, list_inner_product(a.x, r.x)::BIGINT AS score FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.x) = len(r.x)),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, (row_number() OVER w)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score FROM p JOIN s USING (anchor_id)
WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5""",
    "op13_source_mixing": r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS rest, (sum(w) OVER (b ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS ws,
  row_number() OVER b AS place FROM s WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST)),
l AS (SELECT rest, ws FROM o WHERE 3 * source_size > rest * w / ws ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, coalesce(least((3 * source_size)::DOUBLE, (SELECT rest FROM l) * w / (SELECT ws FROM l)), (3 * source_size)::DOUBLE) AS target FROM o),
b AS (SELECT *, round(target)::BIGINT // greatest(source_size, 1) AS whole, round(target)::BIGINT % greatest(source_size, 1) AS left_over FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS words, count(*) AS n FROM d GROUP BY source, h), c AS (SELECT *, (sum(words) OVER (PARTITION BY source ORDER BY h) - words)::BIGINT AS before FROM g)
SELECT doc_id, size, source_size, target, (size * whole + CASE WHEN before + words <= left_over THEN size WHEN before < left_over THEN least(size, (left_over - before) // n) ELSE 0 END)::BIGINT AS taken
FROM d JOIN b ON b.source IS NOT DISTINCT FROM d.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h""",
}


def oracle_sql() -> dict[str, str]:
    """SQL where it expresses a query; the others are tested against brute force in tests/llm."""
    return dict(_ORACLE)
