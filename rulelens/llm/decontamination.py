"""Benchmark decontamination with one Aho-Corasick automaton over the normalised test items.

Normalising lower-cases A-Z and makes every other ASCII non-letter, non-digit a separator. Each item gives its windows of
``window`` consecutive words (a shorter item is one window, an item without words none). Words are numbered and the automaton
runs over numbers. It holds short items whole and of longer ones the blocks of ``(window + 1) // 2`` words that stand at
multiples of that length: every window holds one whole block, and the automaton has one node for each word of the items instead
of one for each word of each window. A document is normalised once and scanned once; where a block ends, the few windows
about it are looked up by hash and compared word by word, and the hits are mapped back to code points of the original text.

Defined results: a null or empty document has no words, no hits and is clean; null or wordless items are ignored; items without
an id have windows and count as one item, without a name; repeated items and repeated documents are each reported as they
stand; an empty benchmark finds nothing; other columns are ignored, and kept where documents are dropped.

The item table is sent to every executor only where it holds at most ``shard_bytes``, which bounds what the driver gathers, what
is broadcast and the automaton (about 30 bytes of memory a byte of items). A larger benchmark is written in parts of that size to the shared
folder; each part makes an automaton that scans all documents, and what it found is merged by text, so no item is ever dropped.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NON_WORD, encoded, fresh_dir, mix, open_folder, ship

#: Maps A-Z to lower case and every separator to a blank.
_FOLD = bytes(0x20 if b in NON_WORD and not 0x41 <= b <= 0x5A else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
SCHEMA = "n_words long, n_hit long, items array<string>, hit_spans array<struct<start:long,end:long>>"
SHARD_BYTES = 8 << 20
_U = np.uint64
_PIECE = 1 << 15


def fold(data: bytes) -> bytes:
    return data.translate(_FOLD)


def _window_hashes(grid: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of word numbers."""
    h = np.zeros(len(grid), np.uint64)
    for k in range(grid.shape[1]):
        h = mix(h * _U(0x9E3779B97F4A7C15) + grid[:, k].astype(np.uint64) + _U(1))
    return h


class Scanner:
    """The automaton over word numbers, and the windows that its blocks lead to."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        import ahocorasick

        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        owners: dict[bytes, set] = {}
        for item, text in items:
            words = fold(encoded(text)).split()
            if words:
                ids = np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words], np.int32)
                owners.setdefault(ids.tobytes(), set()).add(item)
        # a node's children are searched one after another, so a number is spelt in digits, each place having letters of its own
        self.width = max(1, -(-max(len(self.numbers) - 1, 1).bit_length() // 8))
        self.codes = ["".join(chr(256 * (j + 1) + (n >> 8 * j & 255)) for j in range(self.width)) for n in range(len(self.numbers))]
        self.codes.append("\uffff" * self.width)  # number -1: a word of no item
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        #: Owners of each distinct item, and the number and length of each short one.
        self.owners = list(owners.values())
        self.short: list[tuple[int, int]] = []
        whole = [np.frombuffer(k, np.int32) for k in owners]
        for n, ids in enumerate(whole):
            if len(ids) < window:
                self.short.append((n, len(ids)))
                self._add(ids, len(self.short) << 1)
            else:
                for at in range(0, len(ids) - self.block + 1, self.block):
                    self._add(ids[at : at + self.block], 1)
        self.empty = not owners
        if owners:
            self.machine.make_automaton()
        self._index([(n, ids) for n, ids in enumerate(whole) if len(ids) >= window])

    def _add(self, ids: np.ndarray, flag: int) -> None:
        key = "".join([self.codes[n] for n in ids.tolist()])
        self.machine.add_word(key, self.machine.get(key, 0) | flag)

    def _index(self, long: list[tuple[int, np.ndarray]]) -> None:
        """Distinct windows by hash, where one stands, and the items of each."""
        w = self.window
        self.flat = np.concatenate([ids for _, ids in long]) if long else np.zeros(0, np.int32)
        first = np.cumsum([0] + [len(ids) for _, ids in long])
        at = np.concatenate([np.arange(a, b - w + 1) for a, b in zip(first[:-1], first[1:], strict=True)]) if long else np.zeros(0, np.int64)
        item = np.repeat([n for n, _ in long], [len(ids) - w + 1 for _, ids in long]) if long else np.zeros(0, np.int64)
        h = np.concatenate([_window_hashes(self._rows(self.flat, at[k : k + _PIECE])) for k in range(0, len(at), _PIECE)]) if len(at) else np.zeros(0, np.uint64)
        order = np.lexsort((item, h))
        at, item, h = at[order], item[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        for k in range(0, len(at), _PIECE):
            if (self._rows(self.flat, at[k : k + _PIECE]) != self._rows(self.flat, at[lead[k : k + _PIECE]])).any():
                raise ValueError("two windows of the benchmark share a 64-bit hash")
        self.hashes, self.where = h[new], at[new]
        fresh = new.copy()
        fresh[1:] |= item[1:] != item[:-1]
        self.holder = item[fresh]
        self.bounds = np.append(np.flatnonzero(new[fresh]), len(self.holder))

    def _rows(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return ids[starts[:, None] + np.arange(self.window)]

    def scan(self, data: bytes):
        """(words, mask of hit words or None, items found, folded text) of one document."""
        folded = fold(data)
        words = folded.split()
        if self.empty or not words:
            return len(words), None, set(), folded
        get = self.numbers.get
        ids, codes, width = [get(w, -1) for w in words], self.codes, self.width
        change, found, ends = None, set(), []
        for end, flags in self.machine.iter("".join([codes[n] for n in ids])):
            end //= width
            if flags & 1:
                ends.append(end)
            if flags > 1:
                n, size = self.short[(flags >> 1) - 1]
                found |= self.owners[n]
                change = np.zeros(len(words) + 1, np.int64) if change is None else change
                change[end - size + 1] += 1
                change[end + 1] -= 1
        if ends and len(words) >= self.window:
            starts, hit = self._met(np.array(ids, np.int32), np.array(ends))
            if len(starts):
                change = np.zeros(len(words) + 1, np.int64) if change is None else change
                np.add.at(change, starts, 1)
                np.add.at(change, starts + self.window, -1)
                for k in hit.tolist():
                    for n in set(self.holder[self.bounds[k] : self.bounds[k + 1]].tolist()):
                        found |= self.owners[n]
        return len(words), None if change is None else np.cumsum(change[:-1]) > 0, found, folded

    def _met(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows about blocks that are the items' own, and the distinct windows among them."""
        last = len(ids) - self.window
        near = np.unique(np.concatenate([ends - self.block + 1 - k for k in range(self.window - self.block + 1)]))
        near = near[(near >= 0) & (near <= last)]
        starts, kinds = [near[:0]], [near[:0]]
        for k in range(0, len(near), _PIECE):
            part = near[k : k + _PIECE]
            grid = self._rows(ids, part)
            place = np.searchsorted(self.hashes, h := _window_hashes(grid))
            place[place == len(self.hashes)] = 0
            some = np.flatnonzero(self.hashes[place] == h)
            some = some[(grid[some] == self._rows(self.flat, self.where[place[some]])).all(axis=1)]
            starts.append(part[some])
            kinds.append(np.unique(place[some]))
        return np.concatenate(starts), np.unique(np.concatenate(kinds))


def original_spans(folded: bytes, mask: np.ndarray) -> list[tuple[int, int]]:
    """Code-point spans of the runs of hit words in the original text."""
    raw = np.frombuffer(folded, np.uint8)
    blank = np.empty(len(raw) + 2, bool)
    blank[0] = blank[-1] = True
    # bytes.split() also splits at what folding has made blank, and at nothing else: controls are folded too
    blank[1:-1] = raw == 0x20
    turn = np.flatnonzero(blank[1:] != blank[:-1])
    begin, end = turn[0::2], turn[1::2]
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return [(int(points[begin[a]]), int(points[end[b - 1]])) for a, b in runs_of(mask)]


def runs_of(mask: np.ndarray | None) -> list[tuple[int, int]]:
    """(start, end) of the runs of hit words."""
    if mask is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[0::2].tolist(), edge[1::2].tolist(), strict=True))


def _listed(found: set) -> list:
    """Item ids as strings in order, what has no id last."""
    return sorted(i for i in found if i is not None) + [None] * (None in found)


class _Items:
    """A benchmark as the workers get it: one list, or parts in the shared folder."""

    def __init__(self, benchmark: DataFrame, shard_bytes: int):
        spark = benchmark.sparkSession
        rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("i"), "text")
        total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
        self.key, self.sent, self.parts = uuid.uuid4().hex, None, []
        if total <= shard_bytes:
            self.sent = spark.sparkContext.broadcast([(r["i"], r["text"]) for r in rows.collect()])
        else:
            number = -(-total // shard_bytes)
            place = fresh_dir(spark, "items")
            dealt = rows.withColumn("part", F.pmod(F.xxhash64("i", "text"), F.lit(number)).cast("int")).repartition(number, "part")
            dealt.write.partitionBy("part").parquet(place)
            self.parts = [f"{place}/part={r['part']}" for r in spark.read.parquet(place).select("part").distinct().orderBy("part").collect()]

    def scanner(self, part: str | None, window: int) -> Scanner:
        """The automaton of a part, or of all; a worker keeps the last one it made."""
        key = (self.key, part, window)
        if key not in _scanners:
            _scanners.clear()
            _scanners[key] = Scanner(self.sent.value if part is None else _read_part(part), window)
        return _scanners[key]


def _read_part(folder: str) -> list[tuple[str | None, str]]:
    import pyarrow.dataset as ds

    files, base = open_folder(folder)
    rows = ds.dataset(base, filesystem=files, format="parquet").to_table(columns=["i", "text"])
    return list(zip(rows["i"].to_pylist(), rows["text"].to_pylist(), strict=True))


_scanners: dict[tuple, Scanner] = {}


def _found_rows(docs: DataFrame, items: _Items, part: str | None, window: int) -> DataFrame:
    """(digest, runs, items) of the texts that hold windows of one part."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = items.scanner(part, window)
        for pdf in batches:
            out = []
            for t in pdf["text"]:
                data = encoded(t)
                _, mask, found, _ = own.scan(data)
                if mask is not None:
                    out.append((hashlib.sha256(data).hexdigest(), [{"start": a, "end": b} for a, b in runs_of(mask)], _listed(found)))
            yield pd.DataFrame(out, columns=["digest", "runs", "items"])

    return docs.where("text is not null").select("text").mapInPandas(run, "digest string, runs array<struct<start:int,end:int>>, items array<string>")


def _merged(docs: DataFrame, items: _Items, window: int) -> DataFrame:
    """(digest, runs, items) over all parts; copies of a text give one row of each part before they meet."""
    every = None
    for part in items.parts:
        one = _found_rows(docs, items, part, window).groupBy("digest").agg(F.first("runs").alias("runs"), F.first("items").alias("items"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))


def _digest():
    """A text's digest; rows without text have digests of their own, so that they do not gather."""
    return F.coalesce(F.sha2(F.col("text").cast("binary"), 256), F.concat(F.lit("-"), F.rand().cast("string")))


def _report(doc_id, data: bytes, n: int, mask: np.ndarray | None, found: set, folded: bytes) -> tuple:
    spans = [] if mask is None else [{"start": a, "end": b} for a, b in original_spans(folded, mask)]
    return doc_id, n, 0 if mask is None else int(mask.sum()), _listed(found), spans


def scan_documents(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, text's word count, hit words, the items found, and the hit spans in code points."""
    ship(docs.sparkSession)
    items = _Items(benchmark, shard_bytes)
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "n_words", "n_hit", "items", "hit_spans"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = items.scanner(None, window)
        for pdf in batches:
            data = [encoded(t) for t in pdf["text"]]
            yield pd.DataFrame([_report(i, d, *own.scan(d)) for i, d in zip(pdf["doc_id"], data, strict=True)], columns=columns)

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for doc_id, t, runs, found in zip(pdf["doc_id"], pdf["text"], pdf["runs"], pdf["items"], strict=True):
                folded = fold(encoded(t))
                n, mask = len(folded.split()), None
                if runs is not None:
                    mask = np.zeros(n, bool)
                    for r in runs:
                        mask[r["start"] : r["end"]] = True
                out.append(_report(doc_id, b"", n, mask, set() if found is None else set(found), folded))
            yield pd.DataFrame(out, columns=columns)

    rows = docs.select("doc_id", "text")
    if items.sent is not None:
        return rows.mapInPandas(run, f"doc_id {kind}, {SCHEMA}")
    both = rows.withColumn("digest", _digest()).join(_merged(docs, items, window), "digest", "left")
    return both.select("doc_id", "text", "runs", "items").mapInPandas(finish, f"doc_id {kind}, {SCHEMA}")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The digest columns: contaminated means at least one hit word, and one in ``share`` of the words or more."""
    found = scan_documents(docs, benchmark, window, shard_bytes)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.expr(f"n_hit > 0 and {int(share)} * n_hit >= n_words")).alias("contaminated"),
        "hit_spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents that are not contaminated, with their columns; one pass without shuffle for a benchmark of one part."""
    ship(docs.sparkSession)
    items = _Items(benchmark, shard_bytes)

    @F.pandas_udf("boolean")
    def dirty(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = items.scanner(None, window)
        for texts in parts:
            out = []
            for t in texts:
                n, mask, _, _ = own.scan(encoded(t))
                hit = 0 if mask is None else int(mask.sum())
                out.append(hit > 0 and share * hit >= n)
            yield pd.Series(out, dtype=bool)

    if items.sent is not None:
        return docs.where(~dirty(F.col("text")))
    texts = docs.select(F.sha2(F.col("text").cast("binary"), 256).alias("doc_id"), "text").where("text is not null")
    found = contamination(texts, benchmark, window, share, shard_bytes).where("contaminated").select(F.col("doc_id").alias("bad")).distinct()
    return docs.join(found, F.sha2(F.col("text").cast("binary"), 256) == F.col("bad"), "left_anti")
