"""Questions to answers as one plan over tables (R1, R2, E1, Z1, X1, V4), and ingestion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.intents import NUMERIC_PASSAGE, finding_matches
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.settling import settled_table
from ..functions.text import term_set
from ..functions.vectors import hash_text
from ..operators import answers as A
from ..operators import evidence as E
from ..operators import expansion, models, retrieval, rules, temporal, timelines
from ..sources import companions, documents, indexes


@dataclass
class Corpus:
    """What questions are asked of; ``chunks`` have embeddings and index text."""

    chunks: DataFrame
    findings: DataFrame
    contacts: DataFrame
    rules: DataFrame | None = None
    topics: tuple = ()
    suppressed: DataFrame | None = None
    #: Cases of the rule evaluator (``rules.CASES``), and the versions of rules with more than one amendment.
    cases: DataFrame | None = None
    versions: DataFrame | None = None


def embed(df: DataFrame, column: str, dim: int = 768) -> DataFrame:
    """M1: with ``embedding``, hashed from words and pairs."""
    return df.withColumn("embedding", hash_text(F.col(column), dim))


def embed_index(chunks: DataFrame, dim: int, backend: models.Backend | None) -> DataFrame:
    """(chunk_id, embedding) of index texts; an index is whole or it is none, so a chunk without a vector is an error."""
    texts = chunks.select("chunk_id", "index_text")
    if backend is None:
        return embed(texts, "index_text", dim).select("chunk_id", "embedding")
    made = settled_table(models.embedded(texts, F.col("index_text"), backend).select("chunk_id", "embedding", "embedding_error"))
    lost = made.where("embedding is null").agg(F.count(F.lit(1)).alias("n"), F.min("embedding_error").alias("error")).first()
    if lost["n"]:
        raise models.ModelUnavailable(f"{backend.name}: {lost['n']} chunks without a vector ({lost['error']})")
    return made.select("chunk_id", "embedding")


def ingest(spark: SparkSession, manual: str, amendments: list[str], index: str, settings: companions.Settings = companions.Settings(), paragraphs: list[str] | None = None, backend: models.Backend | None = None) -> dict:
    """Parse, check, embed (by hashing, or by ``backend``) and save; the manifest of the index."""
    parts = [documents.parse_manual(documents.read_documents(spark, [manual]))]
    for k, a in enumerate(amendments, 1):
        one = documents.read_documents(spark, [a]).withColumn("document_index", F.lit(k))
        parts.append(documents.parse_amendment(one))
    chunks = documents.index_text(documents.checked(documents.combine(*parts), paragraphs))
    vectors = embed_index(chunks, settings.dimension, backend)
    return indexes.save_index(vectors, chunks, index, indexes.bundle_digest([manual, *amendments]))


def load_corpus(spark: SparkSession, index: str, findings: str, contacts: str, timeline: str | None = None, topics: tuple = (), sources: list[str] | None = None) -> Corpus:
    """A checked index with its companions."""
    vectors, chunks, _ = indexes.load_index(spark, index, indexes.bundle_digest(sources) if sources else None)
    rules = companions.load_timeline(spark, timeline) if timeline else None
    if rules is not None:
        in_force = chunks.where("source_kind = 'amendment'").agg(F.max("effective_date")).first()[0]
        bare = chunks.withColumn("source_locator", F.element_at(F.split("source_locator", ":"), -1))
        wrong = temporal.validate_rules(rules, bare, str(in_force)).limit(1).collect()
        if wrong:
            raise companions.CompanionError(f"timeline rule {wrong[0]['rule_id']}: {wrong[0]['problem']}")
    return Corpus(chunks.join(vectors, "chunk_id"), companions.load_findings(spark, findings), companions.load_contacts(spark, contacts), rules, tuple(topics))


def ask(questions: DataFrame, corpus: Corpus, settings: companions.Settings = companions.Settings(), lexicon: Lexicon = DEFAULT, trace: bool = False, provider: A.Provider | None = None, backend: models.Backend | None = None, scorer: models.Scorer | None = None, required: bool = False) -> DataFrame:
    """Answers to questions(qid, question[, given_change, given_determination]), all in one plan.

    ``backend`` embeds the questions, as it did the corpus; a question for which it fails is refused, with the error beside it.
    ``scorer`` rescores what is retrieved; where it fails a question keeps its order, or the job stops if it is ``required``.

    Questions that a versioned rule settles leave before retrieval; the rest are retrieved, expanded, graded and decided. A
    language model, if one is given, may veto an answer for lack of coverage, and its wording replaces the quotes only where
    it says nothing that the cited texts do not.
    """
    chunks = corpus.chunks
    spark = questions.sparkSession
    settled = None
    rest = questions
    if corpus.rules is not None and corpus.topics:
        today = settings.today or "2026-06-01"
        if corpus.cases is None:
            settled = temporal.resolve(questions, corpus.rules, list(corpus.topics), today)
        else:
            versions = corpus.versions if corpus.versions is not None else timelines.from_two(corpus.rules)
            settled = settled_table(rules.evaluate(questions, list(corpus.topics), corpus.cases, versions, today))
        rest = questions.join(settled.select("qid"), "qid", "left_anti")
    failed = None
    if backend is None:
        asked = settled_table(embed(rest.select("qid", "question"), "question", settings.dimension))
    else:
        made = settled_table(models.embedded(rest.select("qid", "question"), F.col("question"), backend, "query"))
        asked, failed = made.where("embedding is not null").select("qid", "question", "embedding"), made.where("embedding is null")
        rest = rest.join(asked.select("qid"), "qid", "left_semi")
    config = retrieval.RetrievalConfig(settings.dense_k, settings.lexical_k, settings.final_k, hashing=settings.hashing and (backend is None or isinstance(backend, models.Hashing)))
    candidates, primary = map(settled_table, retrieval.hybrid(asked, chunks, config, lexicon, scorer=scorer, required=required, settle=settled_table))
    found = companions.findings_list(corpus.findings)
    context = settled_table(expansion.expand(rest, primary, candidates, chunks, found, settings.final_k, lexicon))
    scores = candidates.select("qid", "chunk_id", "vector_score", "lexical_score", "vector_rank", "lexical_rank")
    # a clause's score in its context is what it was ranked by, so a reranked one is in it
    retrieved = context.join(scores, ["qid", "chunk_id"], "left").withColumn("fused_score", F.col("score")).withColumn("reranker_score", F.lit(None).cast("double")).drop("score")

    kinds = lambda k: corpus.findings.where(F.col("kind") == k)
    # reviewed findings are a handful by nature, so every question meets each of them
    gaps = rest.join(kinds("gap")).where(finding_matches(F.col("question"), F.col("trigger_patterns"), F.col("topic_terms"), lexicon))
    gap_clauses = gaps.select("qid", F.explode("clause_ids").alias("clause_id"))
    suppressed = corpus.suppressed if corpus.suppressed is not None else spark.createDataFrame([], "lo string, hi string, unless_pattern string")
    evidence = settled_table(E.grade(rest, retrieved, chunks, gap_clauses, settings.refusal, settings.coverage, lexicon))
    clashes = settled_table(E.conflicts(rest, retrieved, chunks, kinds("conflict"), suppressed, lexicon))
    missing = E.missing_aspects(rest, evidence, chunks, lexicon)
    decided = settled_table(E.decide(rest, evidence, clashes, gaps.select("qid", "seq", "explanation"), missing, settings.refusal, lexicon))

    if provider is not None:
        decided = settled_table(gated(decided, context, chunks, provider))

    title = F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text")
    facts = chunks.select("chunk_id", "clause_id", "section_id", "cross_references", "source_order", F.col("text").rlike(NUMERIC_PASSAGE).alias("numeric"), term_set(title, lexicon=lexicon).alias("doc_terms"))
    places = context.select("qid", "chunk_id", "pos", F.col("score").alias("ranking_score"))
    direct = evidence.where("support = 'DIRECT'").select("qid", "chunk_id", "score").join(places, ["qid", "chunk_id"]).join(facts, "chunk_id")
    picked = A.sources_by_aspect(direct, decided.select("qid", "question", "aspects"), lexicon)
    answered = picked.join(decided.where("decision = 'ANSWER'").select("qid"), "qid", "left_semi").select("qid", "chunk_id", "pick", F.lit(None).cast("string").alias("explanation"))
    sides = E.first_conflict(clashes).select("qid", F.posexplode("chunk_ids").alias("pick", "chunk_id"), "explanation")
    sides = sides.join(decided.where("decision = 'CONFLICT'").select("qid"), "qid", "left_semi").select("qid", "chunk_id", (F.col("pick") + 1).alias("pick"), "explanation")
    noted = gaps.select("qid", F.posexplode("clause_ids").alias("pick", "clause_id")).join(chunks.select("chunk_id", "clause_id"), "clause_id")
    noted = noted.join(decided.where("rule = 'gap'").select("qid"), "qid", "left_semi").select("qid", "chunk_id", (F.col("pick") + 1).alias("pick"), F.lit(None).cast("string").alias("explanation"))
    cited = answered.unionByName(sides).unionByName(noted).join(chunks.select("chunk_id", A.citation().alias("citation")), "chunk_id").drop("chunk_id")
    # what an answer rests on was retrieved, or it is no answer
    lost = A.unretrieved(answered.unionByName(sides).select("qid", "chunk_id"), context).select("qid").distinct().withColumn("lost", F.lit(True))
    decided = decided.join(lost, "qid", "left").withColumns({"decision": F.when(F.col("lost"), "REFUSE").otherwise(F.col("decision")), "rule": F.when(F.col("lost"), "unretrieved").otherwise(F.col("rule"))}).drop("lost")
    out = A.build(decided, cited, corpus.contacts).withColumn("path", F.lit("evidence"))
    if provider is not None:
        out = worded(out, context, chunks, provider, lexicon)
    if failed is not None:
        out = out.unionByName(unread(failed, cited.where("false"), corpus.contacts).select(*out.columns))
    if settled is not None:
        done = F.col("status") == "resolved"
        sources = corpus.rules.select("rule_id", F.explode(F.concat("target_clause_ids", F.array_compact(F.array("amendment_paragraph_id", "transition_paragraph_id")))).alias("ref"))
        refs = chunks.select(A.citation().alias("citation"), F.explode(F.array_compact(F.array("clause_id", F.split("source_locator", ":")[1]))).alias("ref"), "source_order")
        quotes = sources.join(refs, "ref").groupBy("rule_id").agg(F.transform(F.array_sort(F.collect_set(F.struct("source_order", "citation"))), lambda x: x["citation"]).alias("citations"))
        if corpus.cases is not None:
            worked = settled.select("*", F.when(F.col("status") != "resolved", F.concat(F.lit(A.UNKNOWN + " "), "answer")).otherwise(F.col("answer")).alias("said"))
            asks = F.when(F.col("status") == "missing_fact", F.col("answer"))
            told = [F.col("said").alias("answer"), "citations", "reason", F.concat(F.lit("temporal:"), "topic").alias("rule"), asks.alias("next_step"), F.col("date_error").alias("error"), F.lit("temporal").alias("path")]
            return _traced(out.unionByName(worked.join(quotes, "rule_id", "left").select("qid", "question", "decision", *told)), retrieved, chunks, trace)
        rule_answers = settled.join(quotes, "rule_id", "left").select(
            "qid",
            "question",
            F.when(done | (F.col("status") == "spanning"), "ANSWER").otherwise("REFUSE").alias("decision"),
            F.when(F.col("status") == "missing_date", F.concat(F.lit(A.UNKNOWN + " "), "message"))
            .when(done, F.concat(F.col("message"), F.lit(" "), F.to_json("params")))
            .otherwise(F.col("message"))
            .alias("answer"),
            "citations",
            F.col("status").alias("reason"),
            F.concat(F.lit("temporal:"), "topic").alias("rule"),
            F.when(F.col("status") == "missing_date", F.col("message")).alias("next_step"),
            F.col("date_error").alias("error"),
            F.lit("temporal").alias("path"),
        )
        out = out.unionByName(rule_answers)
    return _traced(out, retrieved, chunks, trace)


def _traced(out: DataFrame, retrieved: DataFrame, chunks: DataFrame, trace: bool) -> DataFrame:
    """Answers, with what was retrieved for each of them if it is asked for."""
    if not trace:
        return out
    seen = retrieved.join(chunks.select("chunk_id", "clause_id", "source_locator"), "chunk_id")
    seen = seen.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "chunk_id", "clause_id", "source_locator", "fused_score", "neighbor_of"))).alias("retrieved"))
    return out.join(seen, "qid", "left")


def unread(failed: DataFrame, cited: DataFrame, contacts: DataFrame) -> DataFrame:
    """Refusals, citing nothing, of questions(qid, question, embedding_error) that no model could read."""
    reason = F.lit("The question could not be read by the embedding model.")
    decided = failed.select("qid", "question", F.lit("REFUSE").alias("decision"), reason.alias("reason"), F.lit("embedding_unavailable").alias("rule"))
    out = A.build(decided, cited, contacts).drop("error")
    return out.join(failed.select("qid", F.col("embedding_error").alias("error")), "qid").withColumn("path", F.lit("evidence"))


def gated(decided: DataFrame, context: DataFrame, chunks: DataFrame, provider: A.Provider) -> DataFrame:
    """Decisions, answers that the model does not find covered, or on which it gives no proper reply, refused."""
    asked = decided.where("decision = 'ANSWER'").select("qid", "question").join(A.context_json(context, chunks), "qid")
    verdicts = A.coverage_gate(asked, provider).select("qid", "coverage")
    both = decided.join(verdicts, "qid", "left")
    veto = (F.col("decision") == "ANSWER") & ~F.coalesce("coverage.covered", F.lit(False))
    reason = F.coalesce(F.concat(F.lit("Not covered: "), "coverage.uncovered_aspect"), F.lit("The sources do not cover the question."))
    return both.withColumns(
        {"reason": F.when(veto, reason).otherwise(F.col("reason")), "rule": F.when(veto, "not_covered").otherwise(F.col("rule")), "decision": F.when(veto, "REFUSE").otherwise(F.col("decision"))}
    ).drop("coverage")


def worded(answers: DataFrame, context: DataFrame, chunks: DataFrame, provider: A.Provider, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Answers in the model's words where these pass the checks against the cited texts; the quotes stay otherwise."""
    asked = answers.where("decision = 'ANSWER'").select("qid", "question", F.array_join(F.transform("citations", lambda c: F.concat(F.lit("§"), F.coalesce(c["clause_id"], c["chunk_id"]), F.lit(" "), c["excerpt"])), " ").alias("source"))
    prose = A.generated(asked.join(A.context_json(context, chunks), "qid"), provider)
    checked = A.validate_prose(asked.join(prose, "qid"), lexicon).where("problem is null and trim(prose) <> ''").select("qid", "prose")
    return answers.join(checked, "qid", "left").withColumn("answer", F.coalesce("prose", "answer")).drop("prose")


def ask_one(spark: SparkSession, question: str, corpus: Corpus, **given) -> dict:
    """One question, as a table of one row."""
    if not question.strip():
        raise ValueError("an empty question")
    row = spark.createDataFrame([("q", question.strip(), given.get("change_date"), given.get("determination_date"))], "qid string, question string, given_change date, given_determination date")
    return ask(row, corpus, trace=True).first().asDict(recursive=True)
