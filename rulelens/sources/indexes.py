"""Vector indexes with a manifest, and digests."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = 3


class IndexError_(ValueError):
    """An index that fails its checks."""


def row_digest(df: DataFrame) -> str:
    """A digest of a table that the order of its rows does not change, yet repeated rows do: counts and two sums of hashes.

    Each row's SHA-256 gives two 60-bit numbers, which are summed as decimals, so the digest is one aggregation.
    """
    h = F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"}).cast("binary"), 256)
    part = lambda a: F.sum(F.conv(F.substring(F.col("h"), a, 15), 16, 10).cast("decimal(38,0)"))
    r = df.select(h.alias("h")).agg(F.count(F.lit(1)).alias("n"), part(1).alias("a"), part(20).alias("b")).first()
    return hashlib.sha256(f"{r['n']}|{r['a']}|{r['b']}".encode()).hexdigest()


def check_vectors(vectors: DataFrame, dim: int | None = None) -> dict:
    """The facts of an index, or an error: one size, finite components, distinct ids."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = vectors.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("ids"), F.min(F.size("embedding")).alias("lo"), F.max(F.size("embedding")).alias("hi"), F.count_if(bad | F.col("embedding").isNull()).alias("bad")
    ).first()
    if not r["n"]:
        raise IndexError_("empty index")
    for wrong, said in ((r["lo"] != r["hi"] or (dim and r["lo"] != dim), "dimensions differ"), (r["bad"], "components are not finite"), (r["ids"] != r["n"], "ids repeat")):
        if wrong:
            raise IndexError_(said)
    return {"dimension": r["lo"], "chunks": r["n"]}


def save_index(vectors: DataFrame, chunks: DataFrame, path: str, corpus_sha256: str, backend: str = "hashing", model: str | None = None) -> dict:
    """Vectors, chunks and a manifest of one JSON row beside them."""
    facts = check_vectors(vectors)
    if chunks.count() != facts["chunks"]:
        raise IndexError_("vectors and chunks differ in number")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    spark = vectors.sparkSession
    manifest = {
        "schema_version": SCHEMA_VERSION, "index_type": "exact", "metric": "inner_product", **facts, "embedding_backend": backend, "embedding_model": model,
        "corpus_sha256": corpus_sha256, "index_sha256": row_digest(spark.read.parquet(f"{path}/vectors")), "metadata_sha256": row_digest(spark.read.parquet(f"{path}/chunks")),
    }
    spark.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def load_index(spark: SparkSession, path: str, corpus_sha256: str | None = None) -> tuple[DataFrame, DataFrame, dict]:
    """(vectors, chunks, manifest), every claim of the manifest checked first."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()["value"])
    if manifest.get("schema_version") != SCHEMA_VERSION:
        raise IndexError_("schema version differs")
    if corpus_sha256 is not None and manifest["corpus_sha256"] != corpus_sha256:
        raise IndexError_("the corpus has changed since the index was built")
    vectors, chunks = spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/chunks")
    if check_vectors(vectors, manifest["dimension"])["chunks"] != manifest["chunks"]:
        raise IndexError_("number of vectors differs")
    lost = vectors.select("chunk_id").exceptAll(chunks.select("chunk_id")).limit(1).count() + chunks.select("chunk_id").exceptAll(vectors.select("chunk_id")).limit(1).count()
    if lost:
        raise IndexError_("vectors and chunks do not match")
    if row_digest(vectors) != manifest["index_sha256"]:
        raise IndexError_("vector digest differs")
    if row_digest(chunks) != manifest["metadata_sha256"]:
        raise IndexError_("chunk digest differs")
    return vectors, chunks, manifest


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of either table that the other lacks, repeated rows counted; empty if they are equal."""
    cols = sorted(a.columns)
    x, y = a.select(cols), b.select(cols)
    return x.exceptAll(y).withColumn("only_in", F.lit("left")).unionByName(y.exceptAll(x).withColumn("only_in", F.lit("right")))


def bundle_digest(paths: list[str]) -> str:
    """A digest of files in order, names and contents framed by their lengths."""
    h = hashlib.sha256()
    for p in map(Path, paths):
        for part in (p.name.encode(), p.read_bytes()):
            h.update(len(part).to_bytes(8, "big"))
            h.update(part)
    return h.hexdigest()


def directory_digest(folder: str) -> str:
    """A digest of a folder's files; links, empty folders and files that change meanwhile are errors."""
    root = Path(folder)
    files = sorted(p for p in root.rglob("*") if not p.is_dir())
    if not files:
        raise IndexError_(f"empty folder: {folder}")
    h = hashlib.sha256()
    for p in files:
        if p.is_symlink() or any(q.is_symlink() for q in p.parents if root in q.parents):
            raise IndexError_(f"link in {folder}: {p.name}")
        before = p.stat()
        data = p.read_bytes()
        after = p.stat()
        if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns) or len(data) != after.st_size:
            raise IndexError_(f"changed while being read: {p.name}")
        for part in (p.relative_to(root).as_posix().encode(), data):
            h.update(len(part).to_bytes(8, "big"))
            h.update(part)
    return h.hexdigest()


def local_directory(ref: str, base: str | None = None) -> str | None:
    """The folder that a reference names, from ``base`` if it is relative; null if it is none."""
    p = Path(os.path.expanduser(ref))
    for candidate in [p] if p.is_absolute() else [Path(base or ".") / p, p]:
        if candidate.is_dir():
            return str(candidate.resolve())
    return None
