"""Evaluation, ranking metrics, calibration and training data."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.settling import narrow_rows, parts_for, settled_table
from ..functions.text import NUMBER, SECTION_REF, extract_all
from ..functions.vectors import ratio
from .groups import components, in_folds

STATES = ["ANSWER", "CONFLICT", "REFUSE"]
CHECKS = ["trace", "decision", "retrieval", "citation_recall", "citation_integrity", "facts", "forbidden_claims", "grounding", "refusal_contract", "unsupported_claim_safety"]
EMPTY = "array<string>"
#: Rows whose folded texts a Python worker holds at once.
FOLDED_AT_ONCE = 1000


def plain(text: Column) -> Column:
    """F8: lower case, one kind of hyphen, single blanks. Case folding and NFKC have no built-in form: ``folded`` has both."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[‐‑‒–—−]", "-"), r"\s+", " "))


def _folded(one):
    import pandas as pd

    def run(parts):
        for texts in parts:
            yield texts.map(one)

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "string")


def folded(text: Column) -> Column:
    """F8 in full: NFKC, case folding, one kind of hyphen, single blanks."""
    import re
    import unicodedata

    def one(t):
        return None if t is None else " ".join(re.sub("[‐‑‒–—−]", "-", unicodedata.normalize("NFKC", t).casefold()).split())

    return _folded(one)(text)


def folded_lists(lists: Column) -> Column:
    """``folded`` of every text of an array of arrays, so that one Python worker a task folds all that a row has."""
    import re
    import unicodedata

    import pandas as pd

    def one(t):
        return None if t is None else " ".join(re.sub("[‐‑‒–—−]", "-", unicodedata.normalize("NFKC", t).casefold()).split())

    def run(parts):
        for rows in parts:
            for at in range(0, len(rows), FOLDED_AT_ONCE):
                yield rows.iloc[at : at + FOLDED_AT_ONCE].map(lambda row: None if row is None else [None if ts is None else [one(t) for t in ts] for ts in row])

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<string>>")(lists)


def score_cases(cases: DataFrame, results: DataFrame) -> DataFrame:
    """One row a case with its ten checks, ``overall_pass`` and ordered ``failure_types``.

    ``cases`` have the expected lists; ``results`` (id, decision, answer, next_step, trace_decision, retrieved, cited, excerpts,
    elapsed_ms[, retrieved_locators, cited_locators]), retrieved and cited being arrays of clause ids, excerpts of the cited
    texts as retrieved, locators those of the same chunks. Texts are compared with compatibility forms and case folded. A case
    without a result is an ERROR.
    """
    r = cases.join(results, "id", "left")
    none = F.array().cast(EMPTY)
    for c in ("expected_source_locators", "expected_evidence_source_locators", "retrieved_locators", "cited_locators"):
        if c not in r.columns:
            r = r.withColumn(c, none)
    arr = lambda c: F.coalesce(F.col(c), none)
    distinct = lambda c: F.array_distinct(arr(c))
    texts = ("expected_facts", "forbidden_claims", "excerpts")
    r = r.withColumn("_all", folded_lists(F.array(F.array("answer"), *[distinct(c) for c in texts])))
    r = r.withColumns({"_answer": F.coalesce(F.col("_all")[0][0], F.lit("")), **{f"_{c}": F.col("_all")[i] for i, c in enumerate(texts, 1)}}).drop("_all")
    answer = F.col("_answer")
    # texts beside their folded forms, those that the answer holds or lacks
    split = lambda c, held: F.transform(F.filter(F.arrays_zip(distinct(c).alias("t"), F.col(f"_{c}").alias("f")), lambda x: F.contains(answer, x["f"]) == held), lambda x: x["t"])
    lacks, has = lambda c: split(c, F.lit(False)), lambda c: split(c, F.lit(True))
    refused = F.col("decision") == "REFUSE"
    source = F.array_join(arr("excerpts"), " ")
    bare = lambda c: F.transform(extract_all(F.regexp_replace(c, SECTION_REF, ""), NUMBER), lambda x: F.replace(x, F.lit(","), F.lit("")))
    refs = lambda c: extract_all(c, SECTION_REF, 1)
    quoted = F.forall(F.col("_excerpts"), lambda x: F.contains(answer, x))
    grounded = refused | (
        (F.size(arr("cited")) > 0)
        & quoted
        & (F.size(F.array_except(refs(F.col("answer")), F.array_union(arr("cited"), refs(source)))) == 0)
        & (F.size(F.array_except(bare(F.col("answer")), bare(source))) == 0)
    )
    needed = F.when(F.col("decision") == "ANSWER", 1).when(F.col("decision") == "CONFLICT", 2).otherwise(0)
    intact = (F.size(arr("cited")) >= needed) & (F.size(distinct("cited")) == F.size(arr("cited"))) & (F.size(F.array_except(arr("cited"), arr("retrieved"))) == 0)
    false_answer = (F.col("expected_decision") != "ANSWER") & (F.col("decision") == "ANSWER")
    r = r.withColumns(
        {
            "actual_decision": F.coalesce("decision", F.lit("ERROR")),
            "missing_evidence": F.array_except(distinct("expected_evidence_clause_ids"), arr("retrieved")),
            "missing_citations": F.array_except(distinct("expected_clause_ids"), arr("cited")),
            "missing_evidence_locators": F.array_except(distinct("expected_evidence_source_locators"), arr("retrieved_locators")),
            "missing_citation_locators": F.array_except(distinct("expected_source_locators"), arr("cited_locators")),
            "missing_facts": lacks("expected_facts"),
            "forbidden_found": has("forbidden_claims"),
        }
    )
    forbidden_ok = F.size("forbidden_found") == 0
    values = {
        "trace": F.col("trace_decision") == F.col("decision"),
        "decision": F.col("decision") == F.col("expected_decision"),
        "retrieval": (F.size("missing_evidence") == 0) & (F.size("missing_evidence_locators") == 0),
        "citation_recall": (F.size("missing_citations") == 0) & (F.size("missing_citation_locators") == 0),
        "citation_integrity": intact,
        "facts": F.size("missing_facts") == 0,
        "forbidden_claims": forbidden_ok,
        "grounding": grounded,
        "refusal_contract": ~refused | (F.contains(answer, F.lit("i don't know")) & (F.trim(F.coalesce("next_step", F.lit(""))) != "")),
        "unsupported_claim_safety": forbidden_ok & grounded & ~false_answer,
    }
    ran = F.col("decision").isNotNull()
    r = r.withColumn("checks", F.struct(*[(ran & F.coalesce(values[c], F.lit(False))).alias(c) for c in CHECKS]))
    passed = F.lit(True)
    for c in CHECKS:
        passed = passed & F.col(f"checks.{c}")
    return r.withColumn("overall_pass", passed).withColumn("failure_types", failure_types()).drop("_answer", "_expected_facts", "_forbidden_claims", "_excerpts")


def audit_rows(scored: DataFrame) -> DataFrame:
    """What an audit of many candidates keeps of a scored case."""
    kept = "id expected_decision actual_decision overall_pass checks missing_evidence missing_citations missing_evidence_locators missing_citation_locators missing_facts forbidden_found failure_types"
    return scored.select(*kept.split())


def failure_types() -> Column:
    """V3: what went wrong, in a fixed order, each kind once."""
    bad = lambda *cs: ~F.least(*[F.col(f"checks.{c}") for c in cs]) if len(cs) > 1 else ~F.col(f"checks.{cs[0]}")
    expected, actual = F.col("expected_decision"), F.col("actual_decision")
    kinds = [
        ("MISSED_CONFLICT", bad("decision") & (expected == "CONFLICT")),
        ("FALSE_CONFLICT", bad("decision") & (actual == "CONFLICT")),
        ("FALSE_ANSWER", bad("decision") & (actual == "ANSWER")),
        ("FALSE_REFUSAL", bad("decision") & (actual == "REFUSE") & (expected == "ANSWER")),
        ("RETRIEVAL_MISS", bad("retrieval")),
        ("BAD_CITATION", bad("citation_recall", "citation_integrity")),
        ("INCOMPLETE_ANSWER", bad("facts")),
        ("UNSUPPORTED_CLAIM", bad("forbidden_claims", "grounding", "unsupported_claim_safety")),
        ("CONTRACT_ERROR", bad("trace", "refusal_contract")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in kinds]))
    return F.when(actual == "ERROR", F.array(F.lit("PIPELINE_ERROR"))).otherwise(found)


def totals(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, rates and latency of scored cases, for all of them or by some columns."""
    yes = lambda c: F.sum(c.cast("long"))
    wrong = (F.col("expected_decision") != "ANSWER") & (F.col("actual_decision") == "ANSWER")
    g = scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("cases"),
        yes(F.col("overall_pass")).alias("passes"),
        yes(F.col("checks.decision")).alias("decisions"),
        yes(F.col("checks.unsupported_claim_safety")).alias("safe"),
        yes(wrong).alias("false_answers"),
        yes(F.col("expected_decision") != "ANSWER").alias("not_answerable"),
        yes(F.col("expected_decision") == "CONFLICT").alias("conflict_cases"),
        yes((F.col("expected_decision") == "CONFLICT") & (F.col("actual_decision") == "CONFLICT")).alias("conflict_hits"),
        yes((F.col("expected_decision") != "CONFLICT") & (F.col("actual_decision") == "CONFLICT")).alias("false_conflicts"),
        F.sum(F.size(F.array_distinct("expected_evidence_clause_ids"))).alias("evidence_total"),
        F.sum(F.size("missing_evidence")).alias("evidence_missing"),
        F.sum(F.size(F.array_distinct("expected_facts"))).alias("facts_total"),
        F.sum(F.size("missing_facts")).alias("facts_missing"),
        *latency("elapsed_ms"),
    )
    return g.withColumns(
        {
            "strict_pass_rate": ratio(F.col("passes"), F.col("cases")),
            "accuracy": ratio(F.col("decisions"), F.col("cases")),
            "safety_rate": ratio(F.col("safe"), F.col("cases")),
            "false_answer_rate": ratio(F.col("false_answers"), F.col("not_answerable")),
            "conflict_recall": ratio(F.col("conflict_hits"), F.col("conflict_cases")),
            "evidence_recall": ratio(F.col("evidence_total") - F.col("evidence_missing"), F.col("evidence_total")),
        }
    )


def latency(column: str) -> list[Column]:
    """Mean, nearest-rank percentiles and maximum."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {column})")
    return [F.avg(column).alias("mean"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.max(column).alias("max")]


def nearest_ranks(values: DataFrame, by: list[str], column: str, quantiles: list[float], parts: int = 32, rounds: int = 64) -> DataFrame:
    """M8 for groups of any size: (by, quantile, n, value), the value of rank ceil(quantile * n), exactly.

    ``latency`` holds a group's distinct values in one buffer; here a group and quantile hold a sketch of ``parts`` cuts and as many
    counters. Each round takes cuts of about equal counts from a sketch, counts the values between them exactly, and goes on
    with the part in which the rank falls, until its least and greatest value are one. Values equal to either end are parts of
    their own, so ties end a search and never hold it up. Sketches and counts are partial before their shuffle, and a
    round reads only values within its ranges. Nulls and NaN are left out; a group without values has no row.
    """
    every = F.array(*[F.lit(float(q)) for q in quantiles])
    x = values.select(*by, F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    spans = x.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).withColumn("quantile", F.explode(every))
    spans = settled_table(spans.withColumn("rank", F.greatest(F.lit(1), F.ceil(F.col("quantile") * F.col("n"))).cast("long")))
    own = [*by, "quantile"]

    def within(ranges: DataFrame) -> DataFrame:
        named = ranges.withColumnsRenamed({k: f"_{k}" for k in by})
        return x.join(named, [*[F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by], F.col("x").between(F.col("low"), F.col("high"))])

    for _ in range(rounds):
        open_ = spans.where("low < high")
        if open_.isEmpty():
            break
        cuts = within(open_).groupBy(*own, "n", "rank", "low", "high").agg(F.percentile_approx("x", [i / parts for i in range(1, parts)], 1000).alias("cuts"))
        below = F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        part = F.when(F.col("x") == F.col("low"), -1).when(F.col("x") == F.col("high"), parts).otherwise(below)
        counted = within(settled_table(cuts)).groupBy(*own, "n", "rank", part.alias("part")).agg(F.count(F.lit(1)).alias("m"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("m").over(Window.partitionBy(*own).orderBy("part"))
        held = counted.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("m") < F.col("rank")))
        held = held.select(*by, "n", "low", "high", "quantile", (F.col("rank") - F.col("upto") + F.col("m")).alias("rank"))
        spans = settled_table(spans.where("low = high").unionByName(held))
    else:
        raise RuntimeError("ranks did not settle")
    return spans.select(*by, "quantile", "n", F.col("low").alias("value"))


def confusion(scored: DataFrame) -> DataFrame:
    """Expected by actual decisions, errors included, absent cells zero."""
    return scored.groupBy("expected_decision").pivot("actual_decision", [*STATES, "ERROR"]).agg(F.count(F.lit(1))).na.fill(0)


def state_metrics(scored: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each state."""
    s = scored.select("expected_decision", "actual_decision", F.explode(F.array(*map(F.lit, STATES))).alias("state"))
    hit = (F.col("expected_decision") == F.col("state")) & (F.col("actual_decision") == F.col("state"))
    g = s.groupBy("state").agg(
        F.count_if(hit).alias("tp"), F.count_if(F.col("expected_decision") == F.col("state")).alias("expected"), F.count_if(F.col("actual_decision") == F.col("state")).alias("predicted")
    )
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("expected"))
    return g.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def failures(scored: DataFrame) -> DataFrame:
    """Cases of each kind of failure."""
    return scored.select(F.explode("failure_types").alias("failure_type")).groupBy("failure_type").agg(F.count(F.lit(1)).alias("cases"))


def seed_summary(runs: DataFrame) -> DataFrame:
    """Mean and population deviation of each metric over seeds."""
    return runs.groupBy("metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("stdev"))


def ranking_metrics(ranked: DataFrame, gold: DataFrame, cutoffs=(1, 3, 6, 10, 24)) -> DataFrame:
    """(cutoff, evaluated, excluded, mrr, recall, complete, hit, ndcg) of ranked(qid, item, rank) and gold(qid, item).

    Questions in ``gold`` with a null item have no relevant item and are left out of the means.
    """
    need = gold.groupBy("qid").agg(F.count_distinct("item").alias("need"))
    hits = gold.where("item is not null").distinct().join(ranked.groupBy("qid", "item").agg(F.min("rank").alias("rank")), ["qid", "item"])
    k = F.explode(F.array(*map(F.lit, cutoffs))).alias("cutoff")
    within = F.col("rank") <= F.col("cutoff")
    grid = need.where("need > 0").select("qid", "need", k).join(hits, "qid", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("need"), F.col("cutoff").cast("long")).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    each = grid.groupBy("qid", "need", "cutoff").agg(
        F.count_if(within).alias("n"), F.sum(F.when(within, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"), F.min("rank").alias("first")
    )
    each = each.withColumn("ideal", ideal)
    means = each.groupBy("cutoff").agg(
        F.count(F.lit(1)).alias("evaluated"),
        F.round(F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
        F.round(F.sum("n") / F.sum("need"), 6).alias("recall"),
        F.round(F.avg((F.col("n") == F.col("need")).cast("double")), 6).alias("complete"),
        F.round(F.avg((F.col("n") > 0).cast("double")), 6).alias("hit"),
        F.round(F.avg(F.col("gain") / F.col("ideal")), 6).alias("ndcg"),
    )
    return means.join(need.agg(F.count_if(F.col("need") == 0).alias("excluded")))


def binary_metrics(scored: DataFrame) -> DataFrame:
    """ROC AUC as the share of won pairs, ties one half, and accuracy at logit zero, of scored(label, logit).

    By rank sums over distinct logits: equal logits share one row. The running count of negatives is taken within narrow
    buckets of logits and over the buckets' totals, so no window sees all rows.
    """
    by = scored.groupBy("logit").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") == 0).alias("n"), F.count_if((F.col("logit") >= 0) == (F.col("label") == 1)).alias("ok"))
    by = by.withColumn("bucket", F.floor(F.greatest(F.lit(-20.0), F.least(F.lit(20.0), F.col("logit"))) * 64))
    before = F.coalesce(F.sum("total").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    buckets = by.groupBy("bucket").agg(F.sum("n").alias("total")).select("bucket", before.alias("before"))  # 2,561 rows at most
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("bucket").orderBy("logit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = by.join(buckets, "bucket").withColumn("won", F.col("p") * (F.col("before") + inside + F.col("n") / 2.0))
    s = t.agg(F.sum("won").alias("won"), F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("ok").alias("ok"), F.sum(F.col("logit") * F.col("p")).alias("lp"), F.sum(F.col("logit") * F.col("n")).alias("ln"))
    return s.select(
        F.round(F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0)), 6).alias("auc"),
        F.round(F.col("ok") / (F.col("p") + F.col("n")), 6).alias("accuracy"),
        F.round(F.col("lp") / F.nullif("p", F.lit(0)), 6).alias("mean_positive"),
        F.round(F.col("ln") / F.nullif("n", F.lit(0)), 6).alias("mean_negative"),
    )


REFUSAL_GRID = (0.42, 0.48, 0.53, 0.58, 0.63, 0.68, 0.74)
COVERAGE_GRID = (0.24, 0.29, 0.34, 0.40)


def threshold_grid(spark, refusal=REFUSAL_GRID, coverage=COVERAGE_GRID) -> DataFrame:
    """L1: every pair of thresholds; a table of a few dozen rows."""
    return spark.createDataFrame([(r, c) for r in refusal for c in coverage], "refusal double, coverage double")


def objective() -> Column:
    """L2: what a pair of thresholds is worth."""
    return F.col("strict_pass_rate") + 0.25 * F.col("accuracy") + 0.50 * F.col("safety_rate") + 0.25 * F.col("conflict_recall") - 2.0 * F.col("false_answer_rate")


def select_candidate(candidates: DataFrame, base_refusal: float = 0.58, base_coverage: float = 0.34) -> DataFrame:
    """The best row by eight keys in turn; further ties go to the lowest thresholds."""
    distance = F.abs(F.col("refusal") - base_refusal) + F.abs(F.col("coverage") - base_coverage)
    c = candidates.withColumn("objective", objective()).withColumn("distance", distance)
    missed = F.col("conflict_cases") - F.col("conflict_hits")
    return c.orderBy(
        F.col("false_answers"), missed, F.col("passes").desc(), F.col("accuracy").desc(), F.col("safety_rate").desc(), F.col("false_conflicts"), F.col("objective").desc(), F.col("distance"), "refusal", "coverage"
    ).limit(1)


def guarded(positives: DataFrame, chunks: DataFrame) -> DataFrame:
    """(case_id, chunk_id) that are no safe negatives: a positive's section, neighbours, and clauses that it names or that name it."""
    c = chunks.select("chunk_id", "section_id", "clause_id", "source_order", "cross_references")
    p = positives.join(c, "chunk_id")
    o = c.select(F.col("chunk_id").alias("other"), F.col("section_id").alias("o_section"), F.col("clause_id").alias("o_clause"), F.col("source_order").alias("o_order"), F.col("cross_references").alias("o_refs"))
    same = p.join(o, p.section_id == o.o_section)
    near = p.withColumn("at", F.explode(F.array(F.col("source_order") - 1, "source_order", F.col("source_order") + 1))).join(o, F.col("at") == F.col("o_order"))
    forth = p.withColumn("r", F.explode("cross_references")).join(o, F.col("r") == F.col("o_clause"))
    back = p.join(o.withColumn("r", F.explode("o_refs")), F.col("r") == p.clause_id)
    parts = [x.select("case_id", F.col("other").alias("chunk_id")) for x in (same, near, forth, back)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def hard_negatives(ranked: DataFrame, positives: DataFrame, chunks: DataFrame, k: int = 4) -> DataFrame:
    """The best-ranked chunks of each case that nothing guards."""
    free = ranked.join(guarded(positives, chunks), ["case_id", "chunk_id"], "left_anti")
    w = Window.partitionBy("case_id").orderBy("rank", "chunk_id")
    return free.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k)


def short_of_negatives(negatives: DataFrame, cases: DataFrame, k: int = 4) -> DataFrame:
    """(case_id, n) of cases(case_id) that have fewer than ``k`` negatives; training must not go on with any."""
    n = negatives.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"))
    return cases.select("case_id").distinct().join(n, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < k)


def reciprocal_ranks(*rankings: DataFrame, k: int = 60) -> DataFrame:
    """Unweighted fusion of ranked(case_id, chunk_id, rank) tables."""
    all_ = rankings[0]
    for r in rankings[1:]:
        all_ = all_.unionByName(r)
    s = all_.groupBy("case_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 12).alias("rrf"))
    w = Window.partitionBy("case_id").orderBy(F.col("rrf").desc(), "chunk_id")
    return s.withColumn("rank", F.row_number().over(w))


def triplets(cases: DataFrame, positives: DataFrame, negatives: DataFrame, chunks: DataFrame) -> DataFrame:
    """Anchor, positive and negative texts of every positive and negative of a case."""
    t = chunks.select("chunk_id", F.coalesce("index_text", "text").alias("t"), "clause_id")
    side = lambda df, n: df.select("case_id", "chunk_id").join(t, "chunk_id").select("case_id", F.col("t").alias(n), F.col("clause_id").alias(f"{n}_clause_id"))
    return cases.select("case_id", F.col("question").alias("anchor")).join(side(positives, "positive"), "case_id").join(side(negatives, "negative"), "case_id")


def labelled_pairs(cases: DataFrame, positives: DataFrame, negatives: DataFrame, chunks: DataFrame) -> DataFrame:
    """Query and passage with a label."""
    t = chunks.select("chunk_id", F.coalesce("index_text", "text").alias("passage"), "clause_id")
    both = positives.select("case_id", "chunk_id", F.lit(1.0).alias("label")).unionByName(negatives.select("case_id", "chunk_id", F.lit(0.0).alias("label")))
    return cases.select("case_id", F.col("question").alias("query")).join(both, "case_id").join(t, "chunk_id").select("query", "passage", "label", "case_id", "clause_id")


def folds(cases: DataFrame, seed: int = 42, n: int = 2) -> DataFrame:
    """A stable fold for each case, by keyed hash."""
    return cases.withColumn("fold", F.pmod(F.xxhash64("case_id", F.lit(seed)), F.lit(n)).cast("int"))


def case_groups(gold: DataFrame, cases: DataFrame | None = None) -> DataFrame:
    """(case_id, lead) of cases that hang together by the clauses of gold(case_id, clause); ``cases`` adds those without any."""
    gold = gold.where("case_id is not null and clause is not null").select("case_id", "clause")
    parts = parts_for(gold, gold.count())
    with narrow_rows(gold.sparkSession, parts):
        gold = settled_table(gold.repartition(parts, "case_id", "clause").distinct())
        least = gold.groupBy("clause").agg(F.min("case_id").alias("b"))
        edges = settled_table(gold.join(least, "clause").select(F.col("case_id").alias("a"), "b").where("a <> b"))
    return components((gold if cases is None else cases).select(F.col("case_id").alias("node")), edges).withColumnRenamed("node", "case_id")


def disjoint_folds(cases: DataFrame, seed: int = 42, n: int = 2) -> DataFrame:
    """cases(case_id, expected_evidence_clause_ids) with a stable fold, cases that share a gold clause in one fold.

    Groups are packed so that folds hold evenly many cases; a case without an id has no fold and is left out.
    """
    leads = case_groups(cases.select("case_id", F.explode("expected_evidence_clause_ids").alias("clause")), cases)
    return cases.join(in_folds(leads, n, seed).select("case_id", "fold"), "case_id")


def fold_overlap(train: DataFrame, held_out: DataFrame) -> DataFrame:
    """Cases on both sides and gold clauses of both; any row is a leak."""
    both = train.select("case_id").intersect(held_out.select("case_id")).select(F.lit("case").alias("kind"), F.col("case_id").cast("string").alias("id"))
    gold = "expected_evidence_clause_ids"
    if gold not in train.columns:
        return both
    side = lambda df: df.select(F.explode(gold).alias("id"))
    return both.unionByName(side(train).intersect(side(held_out)).select(F.lit("clause").alias("kind"), "id"))


def release_assessment(metrics: DataFrame, suites: DataFrame) -> DataFrame:
    """One row of decision, reasons and gains, of metrics(side, metric, value) and suites(suite, failures).

    A candidate is good for blind validation if recall at 6 rose, the pairwise AUC did not fall, and the strict suites were run
    without a failure; nothing is ever promoted by itself. ``side`` is baseline or candidate; a candidate's values over seeds
    and folds are averaged.
    """
    by = metrics.groupBy("metric").agg(F.avg(F.when(F.col("side") == "candidate", F.col("value"))).alias("c"), F.avg(F.when(F.col("side") == "baseline", F.col("value"))).alias("b"))
    gains = by.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.round(F.col("c") - F.col("b"), 6).alias("gain"))))).alias("gains"))
    run = suites.agg(F.count(F.lit(1)).alias("suites"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"))
    more, auc = F.coalesce(F.element_at("gains", F.lit("recall_at_6")) > 0, F.lit(False)), F.coalesce(F.element_at("gains", F.lit("roc_auc")) >= 0, F.lit(False))
    safe = (F.col("suites") > 0) & (F.col("failures") == 0)
    reasons = [(~more, "recall at 6 did not improve"), (~auc, "the pairwise AUC fell"), (F.col("suites") == 0, "no strict suite was run"), (F.col("failures") > 0, "a strict case failed")]
    # both sides are one row
    return gains.join(run).select(
        F.when(more & auc & safe, "ELIGIBLE_FOR_BLIND_VALIDATION").otherwise("KEEP_PRETRAINED_BASELINE").alias("decision"), F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in reasons])).alias("reasons"), "gains"
    )


def release(baseline: DataFrame, candidate: DataFrame, metric: str = "ndcg", cutoff: int = 10, least: float = 0.0) -> DataFrame:
    """Whether one ranking beats another, from two tables of ranking metrics; ``release_assessment`` decides on releases."""
    b = baseline.where(F.col("cutoff") == cutoff).select(F.col(metric).alias("b"), F.col("mrr").alias("bm"))
    c = candidate.where(F.col("cutoff") == cutoff).select(F.col(metric).alias("c"), F.col("mrr").alias("cm"))
    gain = b.join(c).withColumn("delta", F.round(F.col("c") - F.col("b"), 6)).withColumn("mrr_delta", F.round(F.col("cm") - F.col("bm"), 6))
    better = (F.col("delta") > least) & (F.col("mrr_delta") >= 0)
    return gain.select("delta", "mrr_delta", F.when(better, "RELEASE_CANDIDATE").otherwise("KEEP_PRETRAINED_BASELINE").alias("decision"))


def calibrate(evaluate, spark) -> tuple[DataFrame, DataFrame]:
    """All candidates and the recommended one.

    ``evaluate(grid)`` scores all cases under every pair of thresholds at once, as scored cases with ``refusal`` and
    ``coverage``; retrieval does not depend on them and so runs once.
    """
    scored = evaluate(threshold_grid(spark))
    candidates = totals(scored, ["refusal", "coverage"]).withColumn("objective", objective())
    return candidates, select_candidate(candidates.drop("objective"))
