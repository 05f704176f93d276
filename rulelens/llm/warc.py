"""WARC archives: written from pages, indexed record by record, and read back through coalesced byte ranges.

Writing. Each task writes its own archive (one gzip member a record) into the shared folder under a name that no other
attempt uses, and reports offset, length, URL and digest of every record; only the reports of the attempts that Spark
commits make the index, so a lost executor leaves at most an archive that nothing points to. Of pages with equal payloads
the one of the largest page_id is the response and the others revisit it.

A record's id is derived from its page_id and digest, so a revisit names the id, URL and date of the very record that it
refers to, and any reader of archives can resolve it.

Reading starts from the index: the wanted records are dealt by archive and stretch, to as many tasks as their bytes ask for,
sorted by offset, and neighbours closer than ``gap`` are fetched in one read of at most ``most`` bytes (a longer record is
one read).

Defined results: null html is an empty payload, null URLs are left out and line ends in them are written as %0D and %0A;
pages without page_id are always responses; rows with the same page_id and payload are all responses, of one record id;
other columns are ignored; no rows give no archive and no records.
Archives need a file system that pyarrow opens (local or mounted, HDFS, S3, GCS).
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, encoded, fresh_dir, open_folder, ship

INDEX = "page_id long, url string, record_type string, digest string, file string, offset long, length long"
WRITTEN = ["page_id", "url", "html", "refers", "refers_url"]
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    """A record's URI: one for each page and payload; records of no page have random ones."""
    return f"<urn:uuid:{uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/sha1:{digest}')}>"


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str, refers_url: str | None = None) -> bytes:
    """One record, compressed; a revisit keeps the HTTP header, with the full payload's length, and drops the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Date: {date}"]
    lines.append(f"WARC-Record-ID: {record_id(page_id, digest)}")
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_uri(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Date: {date}", f"X-Refers-To-Page-ID: {refers_to}"]
        if refers_url is not None:
            lines.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n") + packer.flush()


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC headers, HTTP headers, payload) of one compressed record."""
    raw = zlib.decompress(data, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = _headers(head)
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, _headers(http), payload


def _headers(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}


#: A payload of more than one in so many pages is hot; there are fewer such payloads than this number.
HOT = 512


def referred(own: DataFrame, revisit_from: int) -> DataFrame:
    """own(page_id, url, html, sha) with ``refers`` and ``refers_url`` of revisits.

    Hot payloads, fewer than ``HOT`` by their definition, meet their pages by broadcast, and those pages are then dealt by
    their own ids, so no payload's pages gather in one task.
    """
    counts = own.groupBy("sha").agg(F.max("page_id").alias("latest"), F.max_by("url", "page_id").alias("at"), F.count(F.lit(1)).alias("n"))
    counts = cut(counts.where("n > 1"))
    total = own.count()
    hot = F.col("n") * HOT > total
    target = F.struct("latest", "at")
    few = counts.where(hot).select("sha", target.alias("hot"))
    many = counts.where(~hot).select(F.col("sha").alias("key"), target.alias("cold"))
    own = own.join(F.broadcast(few), "sha", "left")
    own = own.withColumn("key", F.when(F.col("hot").isNull(), F.col("sha")).otherwise(F.sha1(F.col("page_id").cast("string").cast("binary"))))
    both = own.join(many, "key", "left").withColumn("to", F.coalesce("hot", "cold"))
    older = (F.octet_length("html") >= revisit_from) & (F.col("page_id") < F.col("to.latest"))
    return both.withColumns({"refers": F.when(older, F.col("to.latest")), "refers_url": F.when(older, F.col("to.at"))})


def write(pages: DataFrame, folder: str, revisit_from: int = 0, date: str | None = None, roll: int = 1 << 30) -> DataFrame:
    """Write pages(page_id, url, html) into archives under ``folder``; returns their index, already materialised.

    ``date`` is that of all records, by default the time of writing.
    """
    ship(pages.sparkSession)
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    placed = referred(own.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))), revisit_from)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for pdf in batches:
                rows = []
                for page, url, html, refers, there in zip(*(pdf[c] for c in WRITTEN), strict=True):
                    if out is None or at >= roll:
                        if out is not None:
                            out.close()
                        files.create_dir(base, recursive=True)
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{base}/{name}", compression=None)
                    page, refers = (None if pd.isna(x) else int(x) for x in (page, refers))
                    payload = encoded(html)
                    digest = base32_digest(payload)
                    data = record(page, url, payload, digest, refers, date, there)
                    out.write(data)
                    rows.append((page, url, "response" if refers is None else "revisit", digest, f"{folder}/{name}", at, len(data)))
                    at += len(data)
                frame = pd.DataFrame(rows, columns=[f.split()[0] for f in INDEX.split(", ")])
                yield frame.astype({"page_id": "Int64", "offset": "int64", "length": "int64"})
        finally:
            if out is not None:
                out.close()

    return cut(placed.select(*WRITTEN).mapInPandas(run, INDEX))


def ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int, list[int]]]:
    """Coalesce sorted (offset, length) pairs into reads: (start, end, positions served)."""
    start = end = 0
    held: list[int] = []
    for k, (offset, length) in enumerate(rows):
        if held and (offset - end > gap or offset + length - start > most):
            yield start, end, held
            held = []
        if not held:
            start, end = offset, offset
        end = max(end, offset + length)
        held.append(k)
    if held:
        yield start, end, held


def read(index: DataFrame, gap: int = 1 << 16, most: int = 8 << 20, stretch: int = 32 << 20, payload: bool = False) -> DataFrame:
    """The records of an index (filtered as wished), fetched and parsed; digests are checked where a payload is present.

    Records are dealt by archive and ``stretch`` bytes of it, to one task for each stretch that their lengths add up to.
    """
    ship(index.sparkSession)
    schema = RECORDS + ", payload binary" * payload
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            edges = [0, *(i for i in range(1, len(pdf)) if pdf["file"].iat[i] != pdf["file"].iat[i - 1]), len(pdf)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                part = pdf.iloc[a:b]
                where = list(zip(part["offset"].tolist(), part["length"].tolist(), strict=True))
                folder, _, name = part["file"].iat[0].rpartition("/")
                files, base = open_folder(folder)
                with files.open_input_file(f"{base}/{name}") as f:
                    for start, end, held in ranges(where, gap, most):
                        f.seek(start)
                        data = f.read(end - start)
                        rows = [_row(data[where[k][0] - start : where[k][0] - start + where[k][1]], payload) for k in held]
                        yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    wanted = index.agg(F.sum("length")).first()[0] or 0
    # a number of its own, as the index is far smaller than what it stands for and would be taken by too few tasks
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, -(-wanted // stretch))
    dealt = index.select("file", "offset", "length").repartition(tasks, "file", F.expr(f"offset div {stretch}"))
    return dealt.sortWithinPartitions("file", "offset").mapInPandas(run, schema)


def _row(data: bytes, keep: bool) -> tuple:
    head, http, payload = parse(data)
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    if head["warc-type"] == "response" and base32_digest(payload) != digest:
        raise ValueError(f"damaged record: digest {digest}")
    refers = head.get("x-refers-to-page-id")
    page = head.get("x-page-id")
    row = (
        None if page is None else int(page),
        head.get("warc-target-uri"),
        head["warc-type"],
        None if refers is None else int(refers),
        int(http["content-length"]),
        digest,
    )
    return (*row, payload) if keep else row


def roundtrip(pages: DataFrame, revisit_from: int = 0) -> DataFrame:
    """Write all pages, then read every record back."""
    folder = fresh_dir(pages.sparkSession, "warc")
    records = read(write(pages, folder, revisit_from))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")
