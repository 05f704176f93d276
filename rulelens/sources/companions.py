"""Reviewed findings, contacts, timelines, question sets, settings and reports."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import markdown_cell

FINDING = "id string, status string, clause_ids array<string>, context_clause_ids array<string>, topic_terms array<string>, trigger_patterns array<string>, temporal_scope string, explanation string, source_verified boolean"
FINDINGS = (
    "document_id string, document_name string, document_version string, consolidated_as_of date, source_verified boolean, "
    "reviewed_amendments array<struct<document_id:string,amendment_number:string,effective_date:date,source_verified:boolean>>, "
    f"conflicts array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>, gaps array<struct<{FINDING.replace(' ', ':').replace(',:', ',')}>>"
)
CASE = (
    "id string, question string, expected_decision string, expected_clause_ids array<string>, expected_evidence_clause_ids array<string>, expected_source_locators array<string>, "
    "expected_evidence_source_locators array<string>, expected_facts array<string>, forbidden_claims array<string>, category string, notes string"
)
RULE = (
    "id string, topic string, operation string, target_clause_ids array<string>, amendment_paragraph_id string, transition_paragraph_id string, temporal_basis string, "
    "before map<string,string>, after map<string,string>, expected_replacement_count int, source_verified boolean"
)
OPERATIONS, BASES = ["substitute", "replace_table", "insert"], ["determination_date", "change_date", "claim_period"]


class CompanionError(ValueError):
    """A companion file that breaks its contract."""


def load_findings(spark: SparkSession, path: str) -> DataFrame:
    """(kind, seq, document_id, …finding) in file order."""
    raw = spark.read.schema(FINDINGS).option("multiLine", True).option("mode", "FAILFAST").json(path)
    side = lambda c, kind: raw.select("document_id", F.posexplode(F.coalesce(c, F.array().cast(raw.schema[c].dataType))).alias("seq", "f")).select(F.lit(kind).alias("kind"), "seq", "document_id", "f.*")
    out = side("conflicts", "conflict").unionByName(side("gaps", "gap"))
    empty = F.array().cast("array<string>")
    return out.withColumns({c: F.coalesce(c, empty) for c in ("clause_ids", "context_clause_ids", "topic_terms", "trigger_patterns")})


def findings_list(findings: DataFrame) -> list[dict]:
    """Findings in file order on the driver: a table that people have reviewed line by line, so small by nature."""
    order = F.when(F.col("kind") == "conflict", 0).otherwise(1)
    return [r.asDict() for r in findings.orderBy(order, "seq").collect()]


def load_contacts(spark: SparkSession, path: str) -> DataFrame:
    """(route, next_step, source_clause_ids); there must be a default."""
    body = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    rows = [(k, v.get("next_step"), v.get("source_clause_ids") or []) for k, v in body.items() if isinstance(v, dict) and "next_step" in v]
    if "default" not in {r[0] for r in rows} or any(not (r[1] or "").strip() for r in rows):
        raise CompanionError("contacts need a default route, and every route a next step")
    return spark.createDataFrame(rows, "route string, next_step string, source_clause_ids array<string>")


def load_timeline(spark: SparkSession, path: str) -> DataFrame:
    """The typed rules of a timeline, with its effective date; unknown keys, repeated ids or unreviewed rules are errors."""
    body = json.loads(spark.read.text(path, wholetext=True).first()["value"])
    known = {f.split()[0] for f in RULE.split(", ")}
    rules = body.get("rules") or []
    odd = sorted({k for r in rules for k in r if k not in known})
    ids = [r.get("id") for r in rules]
    for wrong, said in (
        (body.get("schema_version") != 1, "schema version differs"),
        (not body.get("source_verified") or not all(r.get("source_verified") for r in rules), "not reviewed against its source"),
        (odd, f"unknown keys: {', '.join(odd)}"),
        (len(set(ids)) != len(ids), "rule ids repeat"),
        (any(r.get("operation") not in OPERATIONS or r.get("temporal_basis") not in BASES for r in rules), "unknown operation or basis"),
    ):
        if wrong:
            raise CompanionError(f"timeline: {said}")
    df = spark.read.schema(f"rules array<struct<{RULE.replace(', ', ',').replace(' ', ':')}>>").option("multiLine", True).json(path)
    return df.select(F.explode("rules").alias("r")).select(
        F.col("r.id").alias("rule_id"), "r.topic", F.col("r.temporal_basis").alias("basis"), F.lit(body["effective_date"]).cast("date").alias("effective_date"), "r.before", "r.after",
        "r.target_clause_ids", "r.amendment_paragraph_id", "r.transition_paragraph_id", "r.expected_replacement_count",
    )


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Validated cases; lists that are absent are empty."""
    cases = spark.read.schema(CASE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    empty = F.array().cast("array<string>")
    cases = cases.withColumns({c: F.coalesce(c, empty) for c, t in cases.dtypes if t == "array<string>"})
    bad = question_problems(cases).limit(1).collect()
    if bad:
        raise CompanionError(f"{bad[0]['problem']}: {bad[0]['id']}")
    return cases


def question_problems(cases: DataFrame) -> DataFrame:
    """(id, problem) of cases that break the contract: blanks, repeats, unknown decisions, citations beyond the evidence."""
    blank = F.coalesce(F.trim("id") == "", F.lit(True)) | F.coalesce(F.trim("question") == "", F.lit(True))
    beyond = F.size(F.array_except("expected_clause_ids", "expected_evidence_clause_ids")) > 0
    uncited = F.col("expected_decision").isin("ANSWER", "CONFLICT") & (F.size("expected_clause_ids") == 0) & (F.size("expected_source_locators") == 0)
    own = F.when(blank, "blank id or question").when(~F.coalesce(F.col("expected_decision").isin("ANSWER", "CONFLICT", "REFUSE"), F.lit(False)), "unknown decision").when(beyond, "citation beyond the evidence").when(uncited, "no citation expected")
    rows = cases.select("id", own.alias("problem")).where("problem is not null")
    for key in ("id", F.lower(F.regexp_replace(F.trim("question"), r"\s+", " ")).alias("q")):
        k = cases.select("id", (F.col(key) if isinstance(key, str) else key).alias("k"))
        rows = rows.unionByName(k.groupBy("k").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.lit("repeated").alias("problem")))
    return rows


def unknown_labels(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, label) of expected clauses and locators that the corpus lacks."""
    labels = cases.select("id", F.explode(F.concat("expected_clause_ids", "expected_evidence_clause_ids", "expected_source_locators", "expected_evidence_source_locators")).alias("label"))
    known = chunks.select(F.explode(F.array("clause_id", "source_locator")).alias("label"))
    return labels.join(known, "label", "left_anti").distinct()


def companion_problems(chunks: DataFrame, findings: DataFrame, contacts: DataFrame, amendments: DataFrame) -> DataFrame:
    """(kind, value): clauses that companions name and the corpus lacks, unreviewed amendments, missing routes."""
    known = chunks.select(F.col("clause_id").alias("value")).where("value is not null").unionByName(chunks.select(F.explode("inserts_clause_ids").alias("value"))).distinct()
    named = findings.select(F.explode(F.concat("clause_ids", "context_clause_ids")).alias("value")).unionByName(contacts.select(F.explode("source_clause_ids").alias("value")))
    lost = named.distinct().exceptAll(known.intersect(named)).select(F.lit("unknown clause").alias("kind"), "value")
    have = chunks.where("source_kind = 'amendment'").select(F.col("document_id").alias("value")).distinct()
    unreviewed = have.exceptAll(amendments.select(F.col("document_id").alias("value"))).select(F.lit("unreviewed amendment").alias("kind"), "value")
    routes = chunks.sparkSession.createDataFrame([(r,) for r in ("default", "eligibility", "appeals", "conflict")], "value string")
    missing = routes.exceptAll(contacts.select(F.col("route").alias("value"))).select(F.lit("missing route").alias("kind"), "value")
    raw = findings.where(~F.coalesce("source_verified", F.lit(False))).select(F.lit("unreviewed finding").alias("kind"), F.col("id").alias("value"))
    return lost.unionByName(unreviewed).unionByName(missing).unionByName(raw)


@dataclass(frozen=True)
class Settings:
    """Everything that a run may be given; ``RULELENS_<NAME>`` in the environment overrides a default."""

    dense_k: int = 18
    lexical_k: int = 18
    final_k: int = 6
    refusal: float = 0.58
    coverage: float = 0.34
    dimension: int = 768
    hashing: bool = True
    today: str | None = None

    @classmethod
    def from_env(cls, env: dict | None = None) -> Settings:
        env = os.environ if env is None else env
        out = cls()
        for f in fields(cls):
            raw = env.get(f"RULELENS_{f.name.upper()}")
            if raw is not None:
                kind = type(getattr(out, f.name))
                out = replace(out, **{f.name: raw.lower() in ("1", "true", "yes") if kind is bool else raw if kind is type(None) else kind(raw)})
        if not (0 <= out.refusal <= 1 and 0 <= out.coverage <= 1 and out.final_k > 0):
            raise CompanionError("thresholds lie between 0 and 1, and at least one clause is kept")
        return out


def markdown_table(df: DataFrame, limit: int | None = None) -> str:
    """A report as a Markdown table of all rows; where a ``limit`` is given, a line below says how many it left out."""
    cells = df.select([markdown_cell(F.col(c).cast("string")).alias(c) for c in df.columns])
    rows = (cells if limit is None else cells.limit(limit)).collect()
    line = lambda xs: "| " + " | ".join(xs) + " |"
    table = "\n".join([line(df.columns), line(["---"] * len(df.columns)), *[line(["" if x is None else x for x in r]) for r in rows]]) + "\n"
    more = df.count() - len(rows) if limit is not None and len(rows) == limit else 0
    return table + (f"\n{more} more rows are left out.\n" if more > 0 else "")


def write_report(text: str, path: str) -> None:
    """Replaced as a whole or not at all."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_suffix(target.suffix + ".part")
    part.write_text(text, encoding="utf-8")
    os.replace(part, target)
