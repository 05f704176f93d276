"""Corpus reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def corpus_report(chunks: DataFrame) -> DataFrame:
    """One row for each document and, with a null index, one for all: counts and text lengths."""
    return chunks.rollup("document_index").agg(
        F.count(F.lit(1)).alias("chunks"), F.count_distinct("part_id").alias("parts"), F.count_distinct("section_id").alias("sections"), F.count_distinct("clause_id").alias("clauses"),
        F.round(F.avg(F.length("text")), 6).alias("mean_length"), F.max(F.length("text")).alias("max_length"), F.count_if(F.size("cross_references") > 0).alias("with_references"),
    )


def duplicate_texts(chunks: DataFrame) -> DataFrame:
    """Groups of chunks with one normalised text; texts meet by digest, so that the shuffle carries no long keys."""
    return (
        chunks.groupBy(F.sha2(F.col("normalized_text").cast("binary"), 256).alias("digest"))
        .agg(F.array_sort(F.collect_list("chunk_id")).alias("chunk_ids"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def duplicate_members(chunks: DataFrame) -> DataFrame:
    """G6 as rows: (chunk_id, representative, n) of every chunk that shares its normalised text, so that no group is one value."""
    digest = F.sha2(F.col("normalized_text").cast("binary"), 256)
    keyed = chunks.select("chunk_id", digest.alias("digest"))
    groups = keyed.groupBy("digest").agg(F.min("chunk_id").alias("representative"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return keyed.join(groups, "digest").select("chunk_id", "representative", "n")


def duplicate_locators(chunks: DataFrame) -> DataFrame:
    """G8."""
    return chunks.groupBy("source_locator").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unresolved_references(chunks: DataFrame) -> DataFrame:
    """(chunk_id, ref) that name no clause, section or inserted clause."""
    known = chunks.select(F.explode(F.concat(F.array("clause_id", "section_id"), F.coalesce("inserts_clause_ids", F.array().cast("array<string>")))).alias("ref")).where("ref is not null").distinct()
    return chunks.select("chunk_id", F.explode("cross_references").alias("ref")).join(known, "ref", "left_anti").select("chunk_id", "ref")
