"""Numbered Markdown documents as a clause table (S1-S5, P1-P7, P12, DT1, U1, U2, F1).

A document is read whole, cut into lines with their UTF-8 byte offsets, and the lines are flagged by pattern; running windows
over one document's lines carry the part and section down and number the clauses, and a clause is the aggregate of its lines.
Everything is keyed by path, so any number of documents go through one plan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import source_date
from ..functions.text import display_text, normalized_text, section_refs, slug

# The documents' grammar.
PART = r"^#+\s+Part\s+([0-9]+)\s*[—–-]\s*(.+?)\s*$"
SECTION = r"^#+\s+([0-9]+\.[0-9]+)\s+(.+?)\s*$"
CLAUSE = r"^\*\*([0-9]+\.[0-9]+\.[0-9]+)(?:\s+([^*]+?))?\*\*\s*(.*)$"
VERSION = r"Consolidated text as at\s+([0-9]{1,2}\s+[A-Z][a-z]+\s+[0-9]{4})"
AMENDMENT = r"(?m)^#+\s+Amendment No\.\s*([0-9A-Za-z-]+)"
ISSUED = r"(?i)\*\*Issued:\*\*\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})"
EFFECTIVE = r"(?i)\*\*Effective:\*\*\s*([0-9]{1,2}\s+[A-Za-z]+\s+[0-9]{4})"
TITLE = r"^#+\s+([0-9]+)\.\s+(.+?)\s*$"
PARAGRAPH = r"^\*\*([0-9]+\.[0-9]+)\*\*\s*(.*)$"
INSERTED = r"(?m)^>\s*\*\*([0-9]+\.[0-9]+\.[0-9]+[A-Z])"
#: Line ends that the offsets count: also form feeds, the information separators, next line, and the Unicode ones.
_LINE = r"[^\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]*(?:\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]|\z)"


class DocumentError(ValueError):
    """A source that breaks the grammar."""


def read_documents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, name, document_index, source): whole files in the order given; not UTF-8, or missing, is an error."""
    raw = spark.read.format("binaryFile").load(paths).select("path", "content")
    raw = raw.withColumn("source", F.decode("content", "UTF-8"))
    raw = raw.withColumn("source", F.when(F.encode("source", "UTF-8") == F.col("content"), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("not UTF-8: "), "path"))))
    order = None
    # the whole path decides, as files of one name may lie in several folders; the longest ending that fits is meant
    for at, p in sorted(enumerate(paths), key=lambda x: -len(x[1])):
        ending = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", p).strip("/")
        here = F.endswith(F.concat(F.lit("/"), "path"), F.lit(ending))
        order = F.when(here, F.lit(at)) if order is None else order.when(here, F.lit(at))
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), order.cast("int").alias("document_index"), "source")


def lines(documents: DataFrame) -> DataFrame:
    """(… , n, line, bare, start): numbered lines with their ends, without them, and where they begin in bytes."""
    found = F.filter(F.regexp_extract_all("source", F.lit(_LINE), F.lit(0)), lambda x: x != "")
    rows = documents.select("path", "name", "document_index", F.posexplode(found).alias("i", "line"))
    w = Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.sum(F.octet_length("line")).over(w) - F.octet_length("line")
    return rows.withColumns({"n": F.col("i") + 1, "bare": F.regexp_replace("line", r"[\r\n]+$", ""), "start": start.cast("long")}).withColumn("flat", F.trim(F.regexp_replace("bare", r"^\s+|\s+$", "")))


def _blocks(rows: DataFrame, opens: Column, stops: Column, context: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Number the blocks that lines open, end them at stops, and carry context down; a change of the outer one resets the inner."""
    w = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = rows.withColumns({"opens": opens, "stops": stops | opens})
    out = out.withColumn("block", F.sum(F.col("stops").cast("int")).over(w))
    for name, (value, reset) in context.items():
        mark = F.when(value.isNotNull(), F.struct(value.alias("v"))).when(reset, F.struct(F.lit(None).cast("string").alias("v")))
        out = out.withColumn(name, F.last(mark, ignorenulls=True).over(w)["v"])
    return out


def _group(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each block that a line opened: first line, source text without trailing blank lines, and offsets."""
    w = Window.partitionBy("path", "block")
    last = F.max(F.when((F.col("flat") != "") | F.col("opens"), F.col("n"))).over(w)
    inside = rows.withColumn("end", last).where(F.col("n") <= F.col("end"))
    body = F.array_sort(F.collect_list(F.struct("n", "line", "bare", "opens")))
    g = inside.groupBy("path", "name", "document_index", "block").agg(
        F.max("opens").alias("opened"), F.min("n").alias("line_start"), F.max("n").alias("line_end"), F.min("start").alias("start_offset"), body.alias("body"), *[F.first(c, True).alias(c) for c in keep]
    ).where("opened")
    text = F.regexp_replace(F.array_join(F.transform("body", lambda b: b["line"]), ""), r"[\r\n]+$", "")
    return g.withColumn("source_text", text).withColumn("end_offset", F.col("start_offset") + F.octet_length("source_text"))


def _raw(first: Column) -> Column:
    rest = F.transform(F.slice("body", F.lit(2), F.size("body")), lambda b: b["bare"])
    return F.trim(F.regexp_replace(F.array_join(F.concat(F.array(first), rest), "\n"), r"^\s+|\s+$", ""))


def _finish(rows: DataFrame, locator: Column) -> DataFrame:
    """The columns that all kinds of document share."""
    digest = F.sha2(F.col("source_text").cast("binary"), 256)
    ident = F.concat_ws("|", "document_id", F.coalesce("document_version", F.lit("None")), locator, digest)
    order = F.row_number().over(Window.partitionBy("path").orderBy("line_start")) - 1
    return rows.withColumns(
        {
            "chunk_id": F.concat(F.lit("chunk_"), F.substring(F.sha2(ident.cast("binary"), 256), 1, 16)),
            "text": display_text(F.col("raw_text")),
            "normalized_text": normalized_text(F.col("raw_text")),
            "cross_references": section_refs(F.col("raw_text")),
            "document_order": order.cast("int"),
            "page": F.lit(None).cast("int"),
            "active": F.lit(True),
        }
    )


SCHEMA = (
    "chunk_id string, document_id string, document_name string, document_version string, effective_date date, active boolean, source_kind string, "
    "document_title string, amendment_number string, issued_date date, text string, raw_text string, normalized_text string, source_text string, "
    "part_id string, part_title string, section_id string, section_title string, clause_id string, official_clause_id boolean, locator_kind string, "
    "source_locator string, source_locator_label string, amends_clause_ids array<string>, inserts_clause_ids array<string>, page int, line_start int, "
    "line_end int, start_offset bigint, end_offset bigint, source_order int, document_index int, document_order int, cross_references array<string>"
)


def _shaped(rows: DataFrame) -> DataFrame:
    for field in SCHEMA.split(", "):
        name, kind = field.split(" ", 1)
        rows = rows.withColumn(name, F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind))
    return rows.select(*[f.split(" ", 1)[0] for f in SCHEMA.split(", ")])


def parse_manual(documents: DataFrame, title: str = "Manual") -> DataFrame:
    """One row for each clause ``x.y.z`` of a manual."""
    part, section, clause = (F.col("flat").rlike(p) for p in (PART, SECTION, CLAUSE))
    got = lambda p, g, c: F.when(c, F.regexp_extract("flat", p, g))
    rows = _blocks(
        lines(documents),
        clause,
        part | section | (F.col("flat") == "---"),
        {
            "part_id": (got(PART, 1, part), F.lit(False)),
            "part_title": (got(PART, 2, part), F.lit(False)),
            "section_id": (got(SECTION, 1, section), part),
            "section_title": (got(SECTION, 2, section), part),
        },
    )
    g = _group(rows, ["part_id", "part_title", "section_id", "section_title"])
    first = F.col("body")[0]["bare"]
    flat = F.trim(first)
    head = F.concat_ws(" ", F.nullif(F.trim(F.regexp_extract(flat, CLAUSE, 2)), F.lit("")), F.nullif(F.trim(F.regexp_extract(flat, CLAUSE, 3)), F.lit("")))
    version = documents.select("path", F.nullif(F.regexp_extract("source", VERSION, 1), F.lit("")).alias("document_version"))
    g = g.join(version, "path").withColumns(
        {
            "clause_id": F.regexp_extract(flat, CLAUSE, 1),
            "raw_text": _raw(head),
            "document_id": slug(F.regexp_replace("name", r"\.[^.]*$", "")),
            "document_name": F.col("name"),
            "effective_date": source_date(F.col("document_version")),
            "source_kind": F.lit("manual"),
            "document_title": F.lit(title),
            "official_clause_id": F.lit(True),
            "locator_kind": F.lit("clause"),
        }
    )
    g = g.withColumns({"source_locator": F.concat(F.lit("manual:"), "clause_id"), "source_locator_label": F.concat(F.lit(f"{title} §"), "clause_id")})
    return _shaped(_finish(g, F.col("clause_id")).withColumn("source_order", F.col("document_order")))


def parse_amendment(documents: DataFrame, title: str = "Amendment") -> DataFrame:
    """One row for each paragraph ``n.m`` of an amendment."""
    head, para = F.col("flat").rlike(TITLE), F.col("flat").rlike(PARAGRAPH)
    got = lambda p, g, c: F.when(c, F.regexp_extract("flat", p, g))
    rows = _blocks(lines(documents), para, head | (F.col("flat") == "---"), {"section_id": (got(TITLE, 1, head), F.lit(False)), "section_title": (got(TITLE, 2, head), F.lit(False))})
    g = _group(rows, ["section_id", "section_title"])
    flat = F.trim(F.col("body")[0]["bare"])
    pick = lambda p: F.nullif(F.regexp_extract("source", p, 1), F.lit(""))
    facts = documents.select("path", pick(AMENDMENT).alias("amendment_number"), source_date(pick(ISSUED)).alias("issued_date"), source_date(pick(EFFECTIVE)).alias("effective_date"))
    g = g.join(facts, "path").withColumns(
        {
            "paragraph": F.regexp_extract(flat, PARAGRAPH, 1),
            "raw_text": _raw(F.trim(F.regexp_extract(flat, PARAGRAPH, 2))),
            "document_id": slug(F.regexp_replace("name", r"\.[^.]*$", "")),
            "document_name": F.col("name"),
            "document_version": F.concat(F.lit("No. "), "amendment_number"),
            "source_kind": F.lit("amendment"),
            "document_title": F.lit(title),
            "official_clause_id": F.lit(False),
            "locator_kind": F.lit("paragraph"),
        }
    )
    inserted = F.array_distinct(F.regexp_extract_all("source_text", F.lit(INSERTED), F.lit(1)))
    g = g.withColumns(
        {
            "inserts_clause_ids": inserted,
            "amends_clause_ids": F.array_except(F.filter(section_refs(F.col("raw_text")), lambda r: r.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$")), inserted),
            "source_locator": F.concat(F.lit("amendment:"), "paragraph"),
            "source_locator_label": F.concat(F.lit(f"{title} ¶"), "paragraph"),
        }
    )
    return _shaped(_finish(g, F.col("paragraph")).withColumn("source_order", F.col("document_order")))


def combine(*sources: DataFrame) -> DataFrame:
    """All documents in one order; position is a column and never that of a row."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    counts = out.groupBy("document_index").agg(F.count(F.lit(1)).alias("n"))  # one row a document
    before = counts.select("document_index", (F.sum("n").over(Window.orderBy("document_index")) - F.col("n")).alias("before"))
    return out.join(before, "document_index").withColumn("source_order", (F.col("before") + F.col("document_order")).cast("int")).drop("before").select(*sources[0].columns)


def index_text(chunks: DataFrame) -> DataFrame:
    """Chunks with ``index_text``, absent levels left out."""
    part = F.concat(F.lit("Part "), "part_id", F.lit(": "), F.coalesce("part_title", F.lit("")))
    section = F.concat(F.lit("Section "), "section_id", F.lit(": "), F.coalesce("section_title", F.lit("")))
    clause = F.concat(F.lit("Clause "), F.coalesce("clause_id", "source_locator"))
    return chunks.withColumn("index_text", F.concat_ws(" | ", part, section, clause, "normalized_text"))


def problems(chunks: DataFrame, paragraphs: list[str] | None = None) -> DataFrame:
    """What breaks the grammar, as rows (kind, value): duplicates, clauses without context, bad dates, paragraphs amiss."""
    twice = chunks.groupBy("source_locator").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.lit("duplicate locator").alias("kind"), F.col("source_locator").alias("value"))
    manual = chunks.where("source_kind = 'manual'")
    bare = manual.where("part_id is null or section_id is null").select(F.lit("no context").alias("kind"), F.col("clause_id").alias("value"))
    dates = chunks.where("document_version is not null and effective_date is null").select(F.lit("bad date").alias("kind"), F.col("document_id").alias("value")).distinct()
    odd = chunks.where("source_kind = 'amendment'").where(F.coalesce(F.split(F.split("source_locator", ":")[1], r"\.")[0] != F.col("section_id"), F.lit(True)))
    out = twice.unionByName(bare).unionByName(dates).unionByName(odd.select(F.lit("paragraph outside its section").alias("kind"), F.col("source_locator").alias("value")))
    if paragraphs is not None:
        want = chunks.sparkSession.createDataFrame([(p,) for p in paragraphs], "value string")
        have = chunks.where("source_kind = 'amendment'").select(F.split("source_locator", ":")[1].alias("value"))
        out = out.unionByName(want.exceptAll(have).select(F.lit("missing paragraph").alias("kind"), "value"))
        out = out.unionByName(have.exceptAll(want).select(F.lit("unexpected paragraph").alias("kind"), "value"))
    return out


def checked(chunks: DataFrame, paragraphs: list[str] | None = None) -> DataFrame:
    """``chunks``, or an error that names the first problem."""
    if chunks.isEmpty():
        raise DocumentError("no clauses found")
    first = problems(chunks, paragraphs).limit(1).collect()
    if first:
        raise DocumentError(f"{first[0]['kind']}: {first[0]['value']}")
    return chunks


def write_chunks(chunks: DataFrame, path: str, kind: str = "parquet") -> None:
    """S4."""
    chunks.write.mode("overwrite").format(kind).save(path)


def load_chunks(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Read back with the stated schema."""
    return spark.read.schema(SCHEMA).format(kind).load(path)


def find_source(chunks: DataFrame, ident: str) -> DataFrame:
    """by chunk, clause, section or locator, with or without its prefix and sign, or as an inserted clause."""
    bare = ident.strip().lstrip("§¶").strip()
    c = F.col
    return chunks.where(
        (c("chunk_id") == ident)
        | (c("clause_id") == bare)
        | (c("section_id") == bare)
        | (c("source_locator") == ident)
        | (F.split("source_locator", ":")[1] == bare)
        | F.coalesce(F.array_contains("inserts_clause_ids", bare), F.lit(False))
    ).orderBy("source_order")
