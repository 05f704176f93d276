"""Answers, citations and their validation."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.intents import NUMERIC_QUESTION, lookup_ids, next_step_key
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import NUMBER, SECTION_REF, extract_all, let, term_set, words

CITED = "chunk_id document_id document_name document_version source_kind section_id section_title clause_id locator_kind source_locator page line_start line_end start_offset end_offset text".split()
SAFE_KEYS = "qid decision rule reason best_score n_retrieved n_cited version elapsed_ms".split()
UNKNOWN = "I don't know based on the current sources."
LIMIT = 6


def citation() -> Column:
    """The trusted projection of a chunk, the excerpt being its text."""
    return F.struct(*[F.col(c) for c in CITED if c != "text"], F.col("text").alias("excerpt"))


def unretrieved(selected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """selected(qid, chunk_id) that were never retrieved; an answer that has any is rejected."""
    return selected.join(retrieved.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")


#: What a chunk gains for an aspect beside its overlap (fixed values): a section already chosen, being new, a numeric passage for a numeric aspect.
SAME_SECTION, UNSEEN, NUMERIC_FIT = 0.30, 0.04, 0.28
#: Exceptions and references bring in direct chunks of this score or more (a fixed value).
CARRIED = 0.58


def _overlap(aspect: Column, held: Column) -> Column:
    """The share of an aspect's terms that a chunk has, those that are no question words counting 0.7."""
    share = lambda terms: F.size(F.array_intersect(terms, held)) / F.greatest(F.lit(1), F.size(terms))
    subject = 0.70 * F.size(F.array_intersect(aspect["subject"], held)) / F.greatest(F.lit(1), F.size(aspect["subject"]))
    return F.when(F.size(aspect["subject"]) > 0, subject + 0.30 * share(aspect["wide"])).otherwise(share(aspect["wide"]))


def _first_of(rows: Column, key, also=lambda r: []) -> Column:
    """Of the row whose key(row, number) is greatest, the first one of equals: its number ``i``, from 0, and what ``also`` says of it."""
    return F.array_max(F.transform(rows, lambda r, i: F.struct(*key(r, i), (-i).alias("least"), i.alias("i"), *also(r))))


def _best_for(rows: Column, picks: Column, aspect: Column) -> Column:
    """What an aspect adds to the picks: the row of most value for it, if it has any of its terms."""
    sections = F.transform(picks, lambda i: F.get(rows, i)["section_id"])
    plus = lambda cond, v: F.when(F.coalesce(cond, F.lit(False)), F.lit(v)).otherwise(F.lit(0.0))

    def key(r: Column, i: Column) -> list[Column]:
        fit = _overlap(aspect, r["doc_terms"])
        gain = fit + plus(F.exists(sections, lambda s: s.eqNullSafe(r["section_id"])), SAME_SECTION) + plus(~F.array_contains(picks, i), UNSEEN) + plus(aspect["numeric"] & r["numeric"], NUMERIC_FIT)
        return [gain.alias("gain"), r["score"].alias("score"), r["ranking_score"].alias("ranking")]

    best = _first_of(rows, key, lambda r: [_overlap(aspect, r["doc_terms"]).alias("fit")])
    return let(best, lambda x: F.when(x["fit"] > 0, F.array_union(picks, F.array(x["i"]))).otherwise(picks))


def _carried(rows: Column, picks: Column, cond) -> Column:
    """The picks, and after them the strong rows for which cond(row) holds."""
    strong = F.filter(F.transform(rows, lambda r, i: F.when((r["score"] >= CARRIED) & F.coalesce(cond(r), F.lit(False)), i)), lambda i: i.isNotNull())
    return F.array_union(picks, strong)


def chosen_rows(rows: Column, aspects: Column, lookups: Column, exception: Column) -> Column:
    """The numbers, from 0, of the rows that an answer cites; ``rows`` are the direct chunks of one question, in order.

    The state of the fold is the picks so far; an aspect's gain depends on them, so aspects come one after the other.
    """
    none = F.array().cast("array<int>")
    by_score = lambda r, i: [r["score"].alias("score"), r["ranking_score"].alias("ranking")]
    asked = F.transform(
        F.array_sort(F.filter(F.transform(rows, lambda r, i: F.struct(r["source_order"].alias("o"), i.alias("i"), F.array_contains(lookups, r["clause_id"]).alias("hit"))), lambda x: x["hit"])), lambda x: x["i"]
    )
    told = F.aggregate(aspects, none, lambda picks, a: _best_for(rows, picks, a))
    first = F.when(F.size(aspects) > 0, told).otherwise(F.array(_first_of(rows, by_score)["i"]))
    sections = lambda picks: F.transform(picks, lambda i: F.get(rows, i)["section_id"])
    widened = lambda picks: F.when(exception, _carried(rows, picks, lambda r: F.exists(sections(picks), lambda s: s.eqNullSafe(r["section_id"])))).otherwise(picks)
    named = lambda picks: F.flatten(F.transform(picks, lambda i: F.coalesce(F.get(rows, i)["cross_references"], F.array().cast("array<string>"))))
    followed = lambda picks: let(named(picks), lambda refs: _carried(rows, picks, lambda r: F.array_contains(refs, r["clause_id"]) | F.array_contains(refs, r["section_id"])))
    alone = lambda picks: F.when(F.size(picks) > 0, picks).otherwise(F.array(_first_of(rows, lambda r, i: [r["score"].alias("score")])["i"]))
    whole = let(let(first, widened), lambda picks: F.slice(alone(followed(picks)), F.lit(1), F.lit(LIMIT)))
    return let(asked, lambda found: F.when(F.size(found) > 0, found).otherwise(whole))


def sources_by_aspect(direct: DataFrame, parts: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(qid, chunk_id, pick) of the chunks that an answer cites.

    A clause that is merely looked up is the answer; else each aspect in turn picks the chunk of most value, exceptions bring
    in the chosen sections, and references of the chosen what they name, up to six. ``direct`` are (qid, chunk_id, clause_id,
    section_id, cross_references, source_order, pos, score, ranking_score, doc_terms, numeric), ``parts`` (qid, question,
    aspects). The rows of a question are gathered into one array, which its context bounds to a dozen.
    """
    wide = F.transform("aspects", lambda a: F.struct(term_set(a, True, lexicon).alias("wide"), a.rlike(NUMERIC_QUESTION).alias("numeric")))
    told = F.transform(wide, lambda a: F.struct(a["wide"].alias("wide"), F.array_except(a["wide"], words(lexicon.intent)).alias("subject"), a["numeric"].alias("numeric")))
    kind = "array<struct<wide:array<string>,subject:array<string>,numeric:boolean>>"
    asked = parts.select("qid", F.coalesce(told, F.array().cast(kind)).alias("told"), lookup_ids(F.col("question")).alias("lookups"), F.contains(F.lower("question"), F.lit("exception")).alias("exception"))
    row = F.struct("pos", "chunk_id", "clause_id", "section_id", "cross_references", "source_order", "score", "ranking_score", F.coalesce("doc_terms", F.array().cast("array<string>")).alias("doc_terms"), "numeric")
    gathered = direct.groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("rows")).join(asked, "qid", "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    chosen = chosen_rows(F.col("rows"), none("told", kind), none("lookups", "array<string>"), F.coalesce("exception", F.lit(False)))
    picked = gathered.select("qid", F.posexplode(F.transform(chosen, lambda i: F.get("rows", i)["chunk_id"])).alias("at", "chunk_id"))
    return picked.select("qid", "chunk_id", (F.col("at") + 1).alias("pick"))


def build(decisions: DataFrame, cited: DataFrame, contacts: DataFrame) -> DataFrame:
    """(qid, decision, answer, citations, reason, next_step, error).

    ``cited`` are (qid, pick, citation, explanation). ANSWER quotes verbatim, CONFLICT both sides, REFUSE says so. An answer
    without citation, or a conflict with one side, becomes a refusal with the error beside it, so a bad row stops no job.
    """
    c = cited.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pick", "citation"))).alias("s"), F.min_by("explanation", "pick").alias("explanation"))
    d = decisions.join(c, "qid", "left").withColumn("citations", F.transform(F.coalesce("s", F.array().cast(c.schema["s"].dataType)), lambda x: x["citation"]))
    n = F.size("citations")
    error = F.when((F.col("decision") == "ANSWER") & (n < 1), "no citation").when((F.col("decision") == "CONFLICT") & (n < 2), "fewer than two sides")
    d = d.withColumn("error", error).withColumn("decision", F.when(error.isNotNull(), "REFUSE").otherwise(F.col("decision")))
    quote = F.transform("citations", lambda x: F.concat(F.lit("§"), F.coalesce(x["clause_id"], x["source_locator"], x["chunk_id"]), F.lit(": "), x["excerpt"]))
    body = F.array_join(quote, "\n")
    answer = (
        F.when(F.col("decision") == "ANSWER", body)
        .when(F.col("decision") == "CONFLICT", F.concat_ws("\n", F.coalesce("explanation", F.lit("")), body))
        .otherwise(F.concat_ws(" ", F.lit(UNKNOWN), "reason"))
    )
    d = d.withColumn("answer", answer).withColumn("route", next_step_key(F.col("question"), F.col("decision")))
    # contact routes are a handful by nature
    fallback = contacts.where("route = 'default'").select(F.col("next_step").alias("default_step"))
    d = d.join(contacts.select("route", "next_step"), "route", "left").join(fallback)
    step = F.when(F.col("decision") != "ANSWER", F.coalesce("next_step", "default_step"))
    return d.select("qid", "question", "decision", "answer", "citations", "reason", "rule", step.alias("next_step"), "error")


def invented(answer: Column, source: Column, pattern: str, group: int = 0) -> Column:
    """U4: what an answer says and its sources do not, of numbers or references."""
    clean = lambda c: F.transform(extract_all(c, pattern, group), lambda x: F.replace(x, F.lit(","), F.lit("")))
    return F.array_except(clean(answer), clean(source))


def validate_prose(answers: DataFrame, lexicon: Lexicon = DEFAULT, support: float = 0.55) -> DataFrame:
    """answers(qid, prose, source) with ``problem``: invented numbers or clauses, or too little lexical support."""
    bare = lambda c: F.regexp_replace(c, SECTION_REF, "")
    said, known = term_set(F.col("prose"), lexicon=lexicon), term_set(F.col("source"), lexicon=lexicon)
    share = F.size(F.array_intersect(said, known)) / F.greatest(F.lit(1), F.size(said))
    problem = (
        F.when(F.size(invented(bare(F.col("prose")), bare(F.col("source")), NUMBER)) > 0, "invented number")
        .when(F.size(invented(F.col("prose"), F.col("source"), SECTION_REF, 1)) > 0, "invented clause")
        .when(share < support, "unsupported wording")
    )
    return answers.withColumn("problem", problem)


def context_json(retrieved: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, context): the retrieved clauses as ordered JSON records, for a prompt."""
    facts = retrieved.select("qid", "chunk_id", "pos").join(chunks.select("chunk_id", "clause_id", "section_title", "text"), "chunk_id")
    record = F.struct("pos", "chunk_id", "clause_id", "section_title", "text")
    return facts.groupBy("qid").agg(F.to_json(F.array_sort(F.collect_list(record))).alias("context"))


def safe_payload(payload: Column, keys: list[str] = SAFE_KEYS) -> Column:
    """P10: only allowed keys of a map reach a trace."""
    allowed = F.array(*map(F.lit, keys))
    return F.map_filter(payload, lambda k, v: F.array_contains(allowed, k) & v.isNotNull())


class Provider:
    """What a language model must offer; ``mapInPandas`` calls it on batches. The default one is deterministic."""

    def coverage(self, question: str, context: str) -> dict:
        return {"covered": bool(context and context != "[]"), "uncovered_aspect": None}

    def answer(self, question: str, context: str) -> str:
        return context


COVERAGE = "covered boolean, uncovered_aspect string"


def coverage_gate(questions: DataFrame, provider: Provider) -> DataFrame:
    """(qid, coverage) of questions(qid, question, context); replies that do not fit the schema are null."""
    import json

    kind = questions.schema["qid"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            replies = [json.dumps(provider.coverage(q, c)) for q, c in zip(pdf["question"], pdf["context"], strict=True)]
            yield pd.DataFrame({"qid": pdf["qid"], "reply": replies})

    raw = questions.select("qid", "question", "context").mapInPandas(run, f"qid {kind}, reply string")
    return raw.select("qid", F.from_json("reply", COVERAGE).alias("coverage")).withColumn("coverage", F.when(F.col("coverage.covered").isNotNull(), F.col("coverage")))


def generated(questions: DataFrame, provider: Provider) -> DataFrame:
    """(qid, prose) that the model makes of questions(qid, question, context); null where it fails, so that no row stops a job."""
    kind = questions.schema["qid"].dataType.simpleString()

    def one(question: str, context: str) -> str | None:
        try:
            return provider.answer(question, context)
        except Exception:  # a provider may fail in any way of its own; the quotes then stand
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"qid": pdf["qid"], "prose": [one(q, c) for q, c in zip(pdf["question"], pdf["context"], strict=True)]})

    return questions.select("qid", "question", "context").mapInPandas(run, f"qid {kind}, prose string")
