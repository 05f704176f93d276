"""Evidence grading, contradictions and the decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intents as I
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import ASPECT_CUT, ASPECT_HINT, actions, aspects, focus_question, quantities, term_set, tokenize, words
from .retrieval import corrections

EMPTY = "array<string>"


def vocabulary(chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """The distinct tokens of titles and texts."""
    text = F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text")
    return chunks.select(F.explode(tokenize(text, lexicon=lexicon)).alias("tok")).distinct()


def question_terms(questions: DataFrame, vocab: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(qid, question, terms, expanded, subject): expanded holds synonyms and unique corrections."""
    q = questions.select("qid", "question", term_set(F.col("question"), lexicon=lexicon).alias("terms"), term_set(F.col("question"), True, lexicon).alias("wide"))
    fixed = corrections(q.select("qid", F.explode("terms").alias("tok")), vocab).groupBy("qid").agg(F.collect_set("correction").alias("fixed"))
    q = q.join(fixed, "qid", "left")
    q = q.withColumn("expanded", F.array_union("wide", F.coalesce("fixed", F.array().cast(EMPTY))))
    return q.withColumn("subject", F.array_except("terms", words(lexicon.intent | lexicon.generic | lexicon.stop_words))).drop("wide", "fixed")


def concept_groups(questions: DataFrame, vocab: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(qid, segment, term, concept): for each part of a question, its material terms with their synonyms and correction."""
    focused = focus_question(F.col("question"))
    parts = F.when(focused.rlike(ASPECT_HINT), F.split(focused, ASPECT_CUT)).otherwise(F.array(focused))
    t = questions.select("qid", F.posexplode(parts).alias("segment", "part")).select("qid", "segment", F.explode(term_set(F.col("part"), lexicon=lexicon)).alias("tok"))
    plain = words(lexicon.non_subject | lexicon.roles)
    t = t.where(~F.array_contains(plain, F.col("tok")) & ~F.replace(F.col("tok"), F.lit("."), F.lit("")).rlike("^[0-9]+$"))
    common = lexicon.stop_words | lexicon.generic | lexicon.intent | lexicon.non_subject | lexicon.roles
    known = vocab.unionByName(vocab.sparkSession.createDataFrame([(w,) for w in sorted(common)], "tok string")).distinct()
    fixed = corrections(t.select("qid", "tok").distinct(), known)
    t = t.join(fixed, ["qid", "tok"], "left").where(F.col("correction").isNull() | ~F.array_contains(words(common), F.col("correction")))
    concept = F.array_union(F.array_union(F.array("tok"), term_set(F.col("tok"), True, lexicon)), F.array_compact(F.array("correction")))
    return t.select("qid", "segment", F.col("tok").alias("term"), concept.alias("concept"))


def concept_coverage(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """(qid, chunk_id, concept, any_concept): the best segment's share of concepts that the chunk's terms meet."""
    met = pairs.select("qid", "chunk_id", "doc_terms").join(groups, "qid").withColumn("hit", F.arrays_overlap("concept", "doc_terms").cast("int"))
    each = met.groupBy("qid", "chunk_id", "segment").agg((F.sum("hit") / F.count(F.lit(1))).alias("share"), F.max("hit").alias("hit"))
    return each.groupBy("qid", "chunk_id").agg(F.max("share").alias("concept"), (F.max("hit") > 0).alias("any_concept"))


def aspect_coverage(question: Column, doc_terms: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The best share of any part of a compound question that a chunk's terms cover; null for simple questions."""
    generic = words(lexicon.generic)
    parts = F.transform(F.split(question, ASPECT_CUT), lambda p: F.regexp_replace(F.trim(p), r"(?i)^(?:and|including)\s+", ""))
    sets = F.transform(
        parts,
        lambda p: F.struct(
            F.array_except(term_set(p, True, lexicon), generic).alias("wide"), F.size(F.array_except(term_set(p, lexicon=lexicon), generic)).alias("n")
        ),
    )
    sets = F.filter(sets, lambda s: s["n"] > 0)
    share = F.transform(sets, lambda s: F.least(F.lit(1.0), F.size(F.array_intersect(s["wide"], doc_terms)) / s["n"]))
    return F.when(question.rlike(ASPECT_HINT) & (F.size(sets) > 1), F.array_max(share))


def grade(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, gaps: DataFrame, refusal: float = 0.58, direct: float = 0.34, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """One assessed row for each question and retrieved chunk.

    ``retrieved`` has lexical_score, fused_score and reranker_score; ``gaps`` are (qid, clause_id) of matching reviewed gaps.
    """
    vocab = vocabulary(chunks, lexicon)
    q = question_terms(questions, vocab, lexicon)
    title = F.concat_ws(" ", F.coalesce("part_title", F.lit("")), F.coalesce("section_title", F.lit("")), "text")
    facts = chunks.select(
        "chunk_id", "clause_id", "text", "raw_text", F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text").alias("passage"), term_set(title, lexicon=lexicon).alias("doc_terms")
    )
    p = retrieved.join(q, "qid").join(facts, "chunk_id")
    p = p.join(concept_coverage(p, concept_groups(questions, vocab, lexicon)), ["qid", "chunk_id"], "left")
    p = p.join(gaps.select("qid", "clause_id").distinct().withColumn("gap", F.lit(True)), ["qid", "clause_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    matched = F.array_intersect("expanded", "doc_terms")
    needed = F.greatest(F.lit(1), F.size(F.array_except("terms", words(lexicon.generic))))
    plain = F.least(F.lit(1.0), F.size(matched) / needed)
    p = p.withColumns(
        {
            "matched": F.array_sort(matched),
            "coverage": F.greatest(plain, F.coalesce(aspect_coverage(F.col("question"), F.col("doc_terms"), lexicon), F.lit(0.0))),
            "alignment": I.answer_alignment(F.col("question"), F.col("passage"), F.coalesce("raw_text", "text")),
            "signal": F.greatest(zero("lexical_score"), zero("fused_score"), zero("reranker_score")),
            "subject_hit": F.size(F.array_intersect(matched, F.array_union("subject", F.array_except("expanded", "terms")))) > 0,
            "concept": F.coalesce("concept", F.lit(1.0)),
            "any_concept": F.coalesce("any_concept", F.lit(True)),
            "asked": F.array_contains(I.lookup_ids(F.col("question")), F.coalesce("clause_id", F.lit(""))),
        }
    )
    c, a, s, g = F.col("coverage"), F.col("alignment"), F.col("score"), F.col("signal")
    p = p.withColumn("score", F.least(F.lit(1.0), 0.50 * c + 0.20 * zero("lexical_score") + 0.15 * a + 0.15 * g))
    is_direct = (
        ((s >= refusal) | ((a >= 0.95) & (g >= 0.55) & (c >= 0.28)))
        & (c >= F.least(F.lit(direct), F.when(a >= 0.95, 0.28).otherwise(1.0)))
        & F.col("subject_hit")
        & (a >= 0.55)
        & (F.col("concept") >= F.when(F.col("question").rlike(I.CLASSIFICATION_QUESTION), 0.75).otherwise(0.60))
        & F.col("any_concept")
    )
    label = (
        F.when(F.col("asked"), "DIRECT")
        .when(F.col("gap"), F.when(c >= 0.18, "PARTIAL").otherwise("RELATED_ONLY"))
        .when(is_direct, "DIRECT")
        .when((c >= 0.28) & (s >= max(0.35, refusal - 0.20)), "PARTIAL")
        .when((g >= 0.28) | (c >= 0.15), "RELATED_ONLY")
        .otherwise("NONE")
    )
    one = lambda x: F.when(F.col("asked"), 1.0).otherwise(F.round(x, 6))
    return p.select(
        "qid",
        "chunk_id",
        label.alias("support"),
        one(s).alias("score"),
        one(c).alias("topic_coverage"),
        one(a).alias("answer_alignment"),
        F.when(F.col("asked"), F.array("clause_id")).otherwise(F.col("matched")).alias("matched_terms"),
        F.when(F.col("asked"), F.array().cast(EMPTY)).otherwise(F.array_sort(F.array_except("subject", "doc_terms"))).alias("missing_terms"),
    )


def pairs_of(retrieved: DataFrame, chunks: DataFrame, first: int = 12) -> DataFrame:
    """Ordered pairs of each question's first chunks; the rank cut comes before the self-join, so pairs stay few."""
    c = retrieved.where(F.col("pos") <= first).select("qid", "chunk_id", "pos").join(
        chunks.select("chunk_id", "clause_id", "section_id", "cross_references", "text"), "chunk_id"
    )
    side = lambda n: c.select("qid", *[F.col(x).alias(f"{n}_{x}") for x in c.columns if x != "qid"])
    return side("a").join(side("b"), "qid").where("a_pos < b_pos")


def detected_conflicts(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, known: DataFrame, suppressed: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Numeric and polarity conflicts between retrieved clauses.

    ``known`` are (qid, pair) already found by review, ``suppressed`` (lo, hi, unless_pattern) pairs of clauses that clash only
    where the question matches the pattern; pairs are sorted arrays of ids.
    """
    q = questions.select("qid", "question", term_set(F.col("question"), True, lexicon).alias("q_terms"))
    p = pairs_of(retrieved, chunks).join(q, "qid").withColumn("pair", F.array_sort(F.array("a_chunk_id", "b_chunk_id")))
    p = p.join(known.select("qid", "pair").distinct(), ["qid", "pair"], "left_anti")
    refers = lambda x, y: F.coalesce(F.array_contains(f"{x}_cross_references", F.col(f"{y}_clause_id")), F.lit(False)) | F.coalesce(
        F.array_contains(f"{x}_cross_references", F.col(f"{y}_section_id")), F.lit(False)
    )
    p = p.withColumns(
        {
            "linked": refers("a", "b") | refers("b", "a"),
            "a_q": quantities(F.col("a_text")),
            "b_q": quantities(F.col("b_text")),
            "shared": F.array_intersect(F.array_intersect(term_set(F.col("a_text"), lexicon=lexicon), term_set(F.col("b_text"), lexicon=lexicon)), "q_terms"),
            "scoped": F.col("a_text").rlike(I.EXCEPTION_SCOPE) | F.col("b_text").rlike(I.EXCEPTION_SCOPE),
        }
    )
    units = F.array_intersect(F.transform("a_q", lambda x: x["unit"]), F.transform("b_q", lambda x: x["unit"]))
    values = lambda side, u: F.transform(F.filter(side, lambda x: x["unit"] == u), lambda x: x["value"])
    clash = F.array_sort(F.filter(units, lambda u: values("a_q", u) != values("b_q", u)))
    pair_ids = F.array_sort(F.array("a_clause_id", "b_clause_id"))
    p = p.withColumn("lo", pair_ids[0]).withColumn("hi", pair_ids[1]).join(suppressed, ["lo", "hi"], "left")
    muted = F.col("unless_pattern").isNotNull() & ~F.coalesce(F.regexp_like("question", F.col("unless_pattern")), F.lit(False))
    topical = F.size(F.array_except("shared", words("day week month year period must may".split()))) >= 2
    numeric = (
        F.col("question").rlike(I.NUMERIC_INTENT)
        & ~muted
        & (F.size(clash) > 0)
        & (F.col("linked") | topical)
        & ~(F.coalesce(F.col("a_section_id") == F.col("b_section_id"), F.lit(False)) & F.col("scoped"))
    )
    no = lambda s: F.col(f"{s}_text").rlike(I.INELIGIBLE)
    yes = lambda s: F.col(f"{s}_text").rlike(I.ELIGIBLE)
    acts = lambda s, neg: actions(F.col(f"{s}_text"), neg)
    against = (no("a") & yes("b")) | (no("b") & yes("a")) | F.arrays_overlap(acts("a", True), acts("b", False)) | F.arrays_overlap(acts("b", True), acts("a", False))
    ignored = words("eligible eligibility ineligible must may not person applicant recipient household program assistance".split())
    polarity = against & ~F.col("scoped") & (F.size(F.array_except("shared", ignored)) > 0)
    basis = F.when(numeric, "NUMERIC").when(polarity, "POLARITY")
    found = p.withColumn("basis", basis).where("basis is not null").withColumn("unit", F.when(F.col("basis") == "NUMERIC", clash[0]).otherwise("polarity"))
    ident = F.substring(F.sha2(F.concat_ws("|", "a_chunk_id", "b_chunk_id", "unit").cast("binary"), 256), 1, 10)
    return found.select(
        "qid",
        F.concat(F.lower("basis"), F.lit("_"), ident).alias("finding_id"),
        F.array("a_chunk_id", "b_chunk_id").alias("chunk_ids"),
        F.array(F.coalesce("a_clause_id", "a_chunk_id"), F.coalesce("b_clause_id", "b_chunk_id")).alias("clause_ids"),
        "basis",
        F.when(F.col("basis") == "POLARITY", 0.86).when(F.col("linked"), 0.92).otherwise(0.82).alias("confidence"),
        F.when(F.col("basis") == "NUMERIC", F.concat(F.lit("The clauses give different "), "unit", F.lit(" values for the same question.")))
        .otherwise("The clauses apply opposite positive and negative rules to the same question.")
        .alias("explanation"),
        F.struct(F.lit(1).alias("late"), F.col("a_pos").alias("x"), F.col("b_pos").alias("y")).alias("seq"),
    )


def curated_conflicts(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, findings: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Reviewed conflicts that match a question and of which every side was retrieved (relational division)."""
    sides = findings.select("id", "seq", "explanation", "trigger_patterns", "topic_terms", F.size("clause_ids").alias("need"), F.posexplode("clause_ids").alias("k", "clause_id"))
    have = retrieved.select("qid", "chunk_id").join(chunks.select("chunk_id", "clause_id"), "chunk_id")
    met = have.join(sides, "clause_id").join(questions.select("qid", "question"), "qid")
    met = met.where(I.finding_matches(F.col("question"), F.col("trigger_patterns"), F.col("topic_terms"), lexicon))
    whole = met.groupBy("qid", "id", "seq", "explanation", "need").agg(F.count_distinct("clause_id").alias("n"), F.array_sort(F.collect_set(F.struct("k", "chunk_id", "clause_id"))).alias("s"))
    return whole.where("n = need and need >= 2").select(
        "qid",
        F.col("id").alias("finding_id"),
        F.transform("s", lambda x: x["chunk_id"]).alias("chunk_ids"),
        F.transform("s", lambda x: x["clause_id"]).alias("clause_ids"),
        F.lit("CURATED").alias("basis"),
        F.lit(1.0).alias("confidence"),
        "explanation",
        F.struct(F.lit(0).alias("late"), F.col("seq").cast("int").alias("x"), F.lit(0).alias("y")).alias("seq"),
    )


def conflicts(questions: DataFrame, retrieved: DataFrame, chunks: DataFrame, findings: DataFrame, suppressed: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Reviewed conflicts first, then detected ones on pairs that no reviewed one holds."""
    reviewed = curated_conflicts(questions, retrieved, chunks, findings, lexicon)
    pairs = reviewed.select("qid", F.array_sort("chunk_ids").alias("pair"))
    return reviewed.unionByName(detected_conflicts(questions, retrieved, chunks, pairs, suppressed, lexicon))


def missing_aspects(questions: DataFrame, evidence: DataFrame, chunks: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(qid, aspects, missing): parts of a question that no direct chunk covers by a fifth."""
    parts = questions.select("qid", aspects(F.col("question"), lexicon).alias("aspects"))
    direct = evidence.where("support = 'DIRECT'").select("qid", "chunk_id").join(
        chunks.select("chunk_id", term_set(F.concat_ws(" ", F.coalesce("section_title", F.lit("")), "text"), lexicon=lexicon).alias("d")), "chunk_id"
    )
    a = parts.select("qid", F.posexplode("aspects").alias("k", "aspect")).withColumn("t", term_set(F.col("aspect"), True, lexicon))
    best = a.join(direct, "qid", "left").groupBy("qid", "k", "aspect").agg(F.max(F.size(F.array_intersect("t", "d")) / F.size("t")).alias("best"))
    gone = best.where("coalesce(best, 0) < 0.20").groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "aspect"))), lambda x: x["aspect"]).alias("missing"))
    return parts.join(gone, "qid", "left").withColumn("missing", F.coalesce("missing", F.array().cast(EMPTY)))


def decide(questions: DataFrame, evidence: DataFrame, conflicts_: DataFrame, gaps: DataFrame, aspects_: DataFrame, refusal: float = 0.58, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """(qid, decision, reason, rule, best_score): the first rule that holds; ``gaps`` are (qid, seq, explanation)."""
    e = evidence.groupBy("qid").agg(
        F.max(F.when(F.col("support") == "DIRECT", F.col("score"))).alias("best_score"),
        F.max(F.col("support").isin("PARTIAL", "RELATED_ONLY")).alias("related"),
    )
    c = conflicts_.groupBy("qid").agg(F.lit(True).alias("clash"))
    g = gaps.groupBy("qid").agg(F.min_by("explanation", "seq").alias("gap"))
    q = questions.select("qid", "question").join(e, "qid", "left").join(c, "qid", "left").join(g, "qid", "left").join(aspects_, "qid", "left")
    text = F.col("question")
    rule = (
        F.when(I.is_underspecified(text, lexicon), "underspecified")
        .when(F.col("clash"), "conflict")
        .when(F.col("gap").isNotNull(), "gap")
        .when(I.needs_case_facts(text), "case_facts")
        .when(F.col("best_score").isNull(), F.when(F.col("related"), "related_only").otherwise("no_support"))
        .when(F.size("missing") > 0, "partial")
        .when(F.col("best_score") < refusal, "below_threshold")
        .otherwise("answer")
    )
    reasons = {
        "underspecified": "The question names no specific topic or depends on missing context.",
        "conflict": "Relevant provisions are incompatible and no precedence rule resolves them.",
        "case_facts": "The question needs case facts that were not provided.",
        "related_only": "The clauses found are related but do not settle the question.",
        "no_support": "No clause directly supports an answer.",
        "partial": "Direct evidence was found for part of the question only.",
        "below_threshold": "The evidence does not reach the support threshold.",
        "answer": "Direct, complete and consistent evidence was found.",
    }
    table = F.create_map(*[F.lit(x) for kv in reasons.items() for x in kv])
    q = q.withColumn("rule", rule)
    decision = F.when(F.col("rule") == "conflict", "CONFLICT").when(F.col("rule") == "answer", "ANSWER").otherwise("REFUSE")
    reason = F.when(F.col("rule") == "gap", F.col("gap")).otherwise(F.element_at(table, F.col("rule")))
    return q.select("qid", "question", decision.alias("decision"), reason.alias("reason"), "rule", "best_score", "aspects", "missing")


def evidence_level(cited: DataFrame) -> DataFrame:
    """HIGH if every cited chunk scores 0.72 or more, else MEDIUM."""
    return cited.groupBy("qid").agg(F.when(F.min("score") >= 0.72, "HIGH").otherwise("MEDIUM").alias("level"))


def first_conflict(conflicts_: DataFrame) -> DataFrame:
    """The conflict that an answer explains: the first in order."""
    w = Window.partitionBy("qid").orderBy("seq")
    return conflicts_.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
