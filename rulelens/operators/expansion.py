"""Context expansion (R2, J4-J9, W11, W12): from the final selection to a compact set of clauses.

Inherited scores are a maximum, so the order in which parents add a chunk does not matter; which label wins does, and is
carried as a priority. Findings go in file order and see what earlier ones added, so they are folded one by one over a
table of reviewed findings, which is small by nature (people review each).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intents import PERSONAL
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.text import term_set

#: Section titles that questions about one's own case always bring in (fixed values).
PERSONAL_SECTIONS = ["the basic conditions", "resources", "disregards", "income thresholds", "the award", "needs figures"]
DECAY, PARENTS = 0.92, 4


def neighbours(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The chunks just before and after a parent, within its section."""
    near = parents.withColumn("at", F.explode(F.array(F.col("source_order") - 1, F.col("source_order") + 1)))
    other = chunks.select(F.col("chunk_id").alias("to"), F.col("source_order").alias("at"), F.col("section_id").alias("s"))
    return near.join(other, "at").where(F.col("s") == F.col("section_id")).select("qid", "to", "ranking_score", F.col("chunk_id").alias("reason"), F.lit(1).alias("step"), "pos")


def references(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """What a parent's cross-references name, clauses and all clauses of sections."""
    refs = parents.select("qid", "chunk_id", "ranking_score", "pos", F.explode("cross_references").alias("ref"))
    targets = chunks.select(F.explode(F.array("clause_id", "section_id")).alias("ref"), F.col("chunk_id").alias("to")).where("ref is not null").distinct()
    return refs.join(targets, "ref").select("qid", "to", "ranking_score", F.col("chunk_id").alias("reason"), F.lit(2).alias("step"), "pos")


def exception_siblings(parents: DataFrame, chunks: DataFrame) -> DataFrame:
    """The whole section, if the question asks for an exception."""
    asked = parents.where(F.contains(F.lower("question"), F.lit("exception")) & F.col("section_id").isNotNull())
    other = chunks.select(F.col("chunk_id").alias("to"), "section_id")
    return asked.join(other, "section_id").select("qid", "to", "ranking_score", F.concat(F.lit("exception:"), "chunk_id").alias("reason"), F.lit(3).alias("step"), "pos")


def operative_clauses(chunks: DataFrame, titles: list[str] = PERSONAL_SECTIONS) -> DataFrame:
    """Of each named section, the clause that states the rule: a keyword first, then the earliest."""
    text = F.lower("text")
    keyed = F.contains(text, F.lit("following")) | F.contains(text, F.lit("threshold")) | F.contains(text, F.lit("figure")) | F.contains(text, F.lit("conditions are"))
    return (
        chunks.where(F.lower("section_title").isin(titles))
        .groupBy("section_id")
        .agg(F.max_by("chunk_id", F.struct(keyed.cast("int").alias("k"), (-F.col("source_order")).alias("o"))).alias("to"))
    )


def intent_sections(questions: DataFrame, primary: DataFrame, chunks: DataFrame) -> DataFrame:
    best = primary.where("pos = 1").select("qid", "ranking_score", "pos")
    asked = questions.where(F.col("question").rlike(PERSONAL)).select("qid").join(best, "qid")
    # one row for each of a handful of titles
    return asked.join(operative_clauses(chunks)).select("qid", "to", "ranking_score", F.concat(F.lit("intent:"), "section_id").alias("reason"), F.lit(4).alias("step"), "pos")


def add(selected: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Add edges(qid, to, ranking_score of the parent, reason, step, pos) to selected(qid, chunk_id, score, neighbor_of, seen).

    A chunk's score is the greatest of its own and DECAY of each parent's. A selected chunk keeps its label, unless a later
    reason is a finding or an intent, whose last one wins; a new chunk takes its first reason otherwise.
    """
    strong = F.col("reason").startswith("finding:") | F.col("reason").startswith("intent:")
    order = F.struct("step", "pos", "reason")
    gathered = edges.groupBy("qid", F.col("to").alias("chunk_id")).agg(
        F.max(F.col("ranking_score") * DECAY).alias("inherited"),
        F.min_by("reason", order).alias("first_reason"),
        F.max_by(F.when(strong, F.col("reason")), F.when(strong, order)).alias("strong_reason"),
        F.min(order).alias("first_seen"),
    )
    own = candidates.select("qid", "chunk_id", F.col("ranking_score").alias("own"))
    both = selected.join(gathered, ["qid", "chunk_id"], "full").join(own, ["qid", "chunk_id"], "left")
    known = F.col("score").isNotNull()
    start = F.when(known, F.col("score")).otherwise(F.coalesce("own", F.lit(0.0)))
    return both.select(
        "qid",
        "chunk_id",
        F.greatest(start, F.coalesce("inherited", F.lit(0.0))).alias("score"),
        F.coalesce("strong_reason", F.when(known, F.col("neighbor_of")).otherwise(F.col("first_reason"))).alias("neighbor_of"),
        F.coalesce("seen", F.struct((F.col("first_seen.step") + 10).alias("step"), "first_seen.pos", F.col("first_seen.reason").alias("reason"))).alias("seen"),
    )


def apply_findings(selected: DataFrame, questions: DataFrame, chunks: DataFrame, findings: list, candidates: DataFrame, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """Each finding in turn: where one of its clauses is selected and the question matches, all of them are pinned."""
    by_clause = chunks.select(F.col("chunk_id"), "clause_id")
    for f in findings:
        phrases = F.array(*map(F.lit, f["topic_terms"])) if f["topic_terms"] else F.array().cast("array<string>")
        topic = F.array_distinct(F.flatten(F.transform(phrases, lambda p: term_set(p, True, lexicon))))
        needed = F.when(F.size(topic) <= 2, 1).when(F.size(topic) <= 5, 2).otherwise(3)
        match = F.size(F.array_intersect(term_set(F.col("question"), True, lexicon), topic)) >= needed
        for p in f.get("trigger_patterns") or []:
            match = match | F.col("question").rlike(f"(?i){p}")
        clauses = sorted({*f["clause_ids"], *(f.get("context_clause_ids") or [])})
        sides = by_clause.where(F.col("clause_id").isin(clauses)).select(F.col("chunk_id").alias("to"))
        seeds = (
            selected.join(sides.withColumnRenamed("to", "chunk_id"), "chunk_id", "left_semi")
            .join(questions.where(match).select("qid"), "qid", "left_semi")
            .groupBy("qid")
            .agg(F.min_by("score", "seen").alias("ranking_score"))
        )
        edges = seeds.join(sides).select("qid", "to", "ranking_score", F.lit(f"finding:{f['id']}").alias("reason"), F.lit(5).alias("step"), F.lit(0).alias("pos"))
        selected = add(selected, edges, candidates)
    return selected


def compact(selected: DataFrame, chunks: DataFrame, limit: int) -> DataFrame:
    """The best ``limit``; pinned rows beyond it take the places of the last unpinned ones."""
    s = selected.join(chunks.select("chunk_id", "source_order"), "chunk_id")
    pinned = F.coalesce(F.col("neighbor_of").rlike("^(finding|intent):"), F.lit(False))
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "source_order")
    own = Window.partitionBy("qid", "pinned").orderBy(F.col("score").desc(), "source_order")
    s = s.withColumn("pinned", pinned).withColumn("nth", F.row_number().over(own))
    s = s.withColumn("pins", F.least(F.sum(F.col("pinned").cast("int")).over(Window.partitionBy("qid")), F.lit(limit)))
    kept = s.where(F.when(F.col("pinned"), F.col("nth") <= limit).otherwise(F.col("nth") <= limit - F.col("pins")))
    return kept.withColumn("pos", F.row_number().over(w)).select("qid", "chunk_id", "score", "neighbor_of", "pos")


def expand(questions: DataFrame, primary: DataFrame, candidates: DataFrame, chunks: DataFrame, findings: list, final_k: int = 6, lexicon: Lexicon = DEFAULT) -> DataFrame:
    """R2: (qid, chunk_id, score, neighbor_of, pos) of the context of each question."""
    facts = chunks.select("chunk_id", "section_id", "source_order", "cross_references")
    parents = primary.where(F.col("pos") <= PARENTS).select("qid", "chunk_id", "ranking_score", "pos").join(facts, "chunk_id").join(questions.select("qid", "question"), "qid")
    edges = neighbours(parents, chunks).unionByName(references(parents, chunks)).unionByName(exception_siblings(parents, chunks)).unionByName(intent_sections(questions, primary, chunks))
    start = primary.select("qid", "chunk_id", F.col("ranking_score").alias("score"), "neighbor_of", F.struct(F.lit(0).alias("step"), "pos", F.lit("").alias("reason")).alias("seen"))
    return compact(apply_findings(add(start, edges, candidates), questions, chunks, findings, candidates, lexicon), chunks, final_k + 6)
