"""Byte-pair encoding and decoding with a public vocabulary, merging through a segment tree over pair ranks.

The tokenizer file gives the vocabulary, the ordered merges, the word-end suffix and the literal special tokens. A text is
cut at its special tokens, then at white space; each distinct chunk is normalised (NFC, lower case), cut into pieces, spelt
in bytes and merged. The tree's leaves hold the rank of each adjacent pair, its root the leftmost lowest one; a merge
updates two leaves, so a piece of n bytes takes O(n log n) whatever its length.

Defined results: null and empty texts give no ids and an empty text; very long pieces are merged whole; repeated rows are
encoded each; other columns are ignored. Each worker keeps a memory of chunks it has met, of bounded size.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import ship

_NONE = 1 << 62
#: Code points that the pre-tokenizer counts as white space (fixed values).
_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


#: Where later Unicode versions may add letters and digits: planes 0 to 3, and the start of plane 14; no others are planned.
_OPEN = (range(0x40000), range(0xE0000, 0xE0200))


@functools.cache
def _later(initial: str) -> frozenset[int]:
    """Code points that Python's Unicode tables do not know and the library's count to a general category."""
    unknown = "".join(chr(p) for part in _OPEN for p in part if unicodedata.category(chr(p)) == "Cn")
    found = pre_tokenizers.Split(Regex(f"\\p{{{initial}}}+"), "removed", invert=True).pre_tokenize_str(unknown)
    return frozenset(ord(c) for piece, _ in found for c in piece)


def _runs(last: int, inside: Callable[[int], bool]) -> str:
    """The inside of a character class: the code points to ``last`` that are ``inside``."""
    runs, start = [], None
    for point in range(last + 2):
        within = point <= last and inside(point)
        if within and start is None:
            start = point
        elif not within and start is not None:
            runs.append(f"\\U{start:08x}-\\U{point - 1:08x}")
            start = None
    return "".join(runs)


def _of_category(initial: str, last: int) -> str:
    """The code points to ``last`` of a general category: by Python's Unicode tables, and by the library's where those end."""
    later = _later(initial)
    return _runs(last, lambda p: unicodedata.category(chr(p))[0] == initial or p in later)


def piece_pattern(last: int) -> re.Pattern:
    """The piece pattern of the vocabulary file (a fixed value) for texts of code points to ``last``.

    Classes that stay within 16 bits compile to bitmaps; wider ones are searched range by range, so are kept apart.
    """
    letter, digit = _of_category("L", last), _of_category("N", last)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{digit}]|[^{_SPACE}{letter}{digit}]+")


_CHUNKS, _PIECES, _LONGEST = 60_000, 120_000, 40


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where Latin-1 prints it, else the next free code point from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def merge(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """Apply merges, leftmost lowest rank first, until no adjacent pair has one."""
    n = len(symbols)
    if n < 2:
        return symbols
    symbols, get = list(symbols), ranks.get
    # a node holds rank * 2**32 + leaf, so the lesser of two nodes is the lower rank, and of equal ranks the left one
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        found = get((symbols[i], symbols[i + 1]))
        if found is not None:
            tree[size + i] = found[0] << 32 | i
    for i in range(size - 1, 0, -1):
        left, right = tree[2 * i], tree[2 * i + 1]
        tree[i] = left if left < right else right
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            other = tree[i ^ 1]
            i >>= 1
            if other < value:
                value = other
            tree[i] = value

    while tree[1] < _NONE:
        i = tree[1] & 0xFFFFFFFF
        j = after[i]
        symbols[i] = new = get((symbols[i], symbols[j]))[1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, _NONE)
        value = _NONE
        if k < n:
            before[k] = i
            found = get((new, symbols[k]))
            if found is not None:
                value = found[0] << 32 | i
        put(i, value)
        h = before[i]
        if h >= 0:
            found = get((symbols[h], new))
            put(h, _NONE if found is None else found[0] << 32 | h)
    return [s for s in symbols if s >= 0]


class Memory:
    """A map of bounded size that forgets what has gone unused longest, by generations."""

    def __init__(self, size: int):
        self.size, self.young, self.old = size, {}, {}

    def get(self, key):
        found = self.young.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value


class Codec:
    """A vocabulary, ready to encode and decode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        letters = byte_letters()
        self.inner = [vocab.get(c, -1) for c in letters]
        self.final = [vocab.get(c + self.suffix, -1) for c in letters]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        #: What each id stands for; null for ids that stand for nothing.
        self.names = [names.get(i) for i in range(max(names, default=-1) + 1)]
        self.cut = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.narrow, self.wide = piece_pattern(0xFFFF).findall, piece_pattern(0x10FFFF).findall
        # what Python's tables do not know is brought to NFC and lower case by the library's
        unknown = lambda last: re.compile(f"[{_runs(last, lambda p: unicodedata.category(chr(p)) == 'Cn')}]").search
        self.narrow_unknown, self.wide_unknown = unknown(0xFFFF), unknown(0x10FFFF)
        self.form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.blank = re.compile(f"[{_SPACE}]+")
        self.chunks, self.pieces = Memory(_CHUNKS), Memory(_PIECES)

    def _piece(self, piece: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if (out := self.pieces.get(piece)) is not None:
            return out
        data = piece.encode("utf-8", "surrogatepass")
        symbols = [self.inner[b] for b in data[:-1]]
        symbols.append(self.final[data[-1]])
        out = _little(array("I", merge([s for s in symbols if s >= 0], self.ranks)))
        if len(piece) <= _LONGEST:
            self.pieces.put(piece, out)
        return out

    def _folded(self, chunk: str) -> str:
        if (self.narrow_unknown if max(chunk) <= "\uffff" else self.wide_unknown)(chunk):
            return self.form(chunk)
        return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()

    def _chunk(self, chunk: str) -> bytes:
        folded = chunk.lower() if chunk.isascii() else self._folded(chunk)
        pieces = self.narrow(folded) if folded.isascii() or max(folded) <= "\uffff" else self.wide(folded)
        parts = [self._piece(p) for p in pieces]
        out = parts[0] if len(parts) == 1 else b"".join(parts)
        if len(chunk) <= _LONGEST:
            self.chunks.put(chunk, out)
        return out

    def _plain(self, text: str) -> list[bytes]:
        # str.split() also cuts at U+001C to U+001F, which the vocabulary's pattern takes as symbols
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        chunks = [c for c in self.blank.split(text) if c] if odd else text.split()
        found = list(map(self.chunks.young.get, chunks))
        if None in found:
            get, make = self.chunks.get, self._chunk
            found = [(get(c) or make(c)) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(self._plain(text))
        parts: list[bytes] = []
        at = 0
        for m in self.cut.finditer(text):
            parts += self._plain(text[at : m.start()])
            parts.append(_little(array("I", [self.special[m[0]]])))
            at = m.end()
        return b"".join(parts + self._plain(text[at:]))

    def decode(self, ids: bytes) -> str:
        """The text of little-endian ids; the vocabulary file names no decoder, so tokens are joined by blanks."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        names, size = self.names, len(self.names)
        try:
            return " ".join(map(names.__getitem__, numbers))
        except (IndexError, TypeError):  # ids that stand for nothing
            return " ".join([names[i] for i in numbers if i < size and names[i] is not None])


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each vocabulary and worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def tokenize(docs: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of the decoded text, and the ids themselves if asked for; no shuffle."""
    ship(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * keep_ids

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = codec(path)
        for pdf in batches:
            out = []
            for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                ids = own.encode(text)
                decoded = own.decode(ids).encode("utf-8", "surrogatepass")
                row = (doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
                out.append((*row, ids) if keep_ids else row)
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the text that its ids stand for."""
    ship(encoded.sparkSession)

    @F.pandas_udf("string")
    def back(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = codec(path)
        for ids in parts:
            yield ids.map(lambda b: own.decode(bytes(b or b"")))

    return encoded.select("doc_id", back("ids").alias("text"))
