"""MinHash near-dedup through a multi-index Hamming join with exact confirmation.

Each set of word shingles gets a signature of ``symbols`` b-bit minhashes, and the signature distance is the number of
symbols that differ. Signatures are split into ``chunks``; two within ``distance`` of each other have, by pigeonhole, some
chunk with at most ``distance // chunks`` wrong symbols, so each signature is indexed under every chunk with every allowed
choice of that many symbols left out. All pairs within the distance therefore meet under at least one key. At a similarity
of 0.85 a symbol differs with probability 0.15, so 15 of 40 is exceeded by about one linked pair in five thousand, and pairs
beyond it nearly always meet all the same (one in a million at 0.85 has two wrong symbols in every chunk). Star links
that differ in more than ``reach`` symbols are left to the blocks.

Hot groups. Equal sets collapse to one class first, by a digest of the whole set. Under each key members are linked to the
smallest one, a star instead of all pairs, and the links confirmed on the full sets. Keys whose members are then still in
different components send the members' full sets to salted blocks, where every pair across components is compared in place
and only links that join two of them leave. Which pairs inside one component link further cannot change the components, so
nothing is lost and no group is expanded into its pairs.

Defined results: a text without words, or null, has an empty set and links with nothing (its component is its own doc_id);
fewer words than the shingle length make one shingle; repeated rows are equal sets; rows of one doc_id with different texts
are one document, which is linked where any of its texts is; null doc_ids are ignored as representatives and get the
component of their set, or none; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batch_word_hashes, cut, encoded, mix, ship, space_table
from .components import connected_components

_SPACE = space_table(BLANKS)
_U = np.uint64


class Scheme:
    """Parameters of signatures and of their index."""

    def __init__(self, shingle: int = 5, numerator: int = 80, denominator: int = 100, symbols: int = 40, chunks: int = 8, distance: int = 15, reach: int = 20, block: int = 400_000):
        self.shingle, self.numerator, self.denominator = shingle, numerator, denominator
        self.symbols, self.chunks, self.distance, self.reach, self.block = symbols, chunks, distance, reach, block
        rng = np.random.default_rng(97)
        self.a = rng.integers(1, 1 << 32, symbols, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, symbols, dtype=np.uint32)
        size, wrong = symbols // chunks, distance // chunks
        #: The first distance % chunks + 1 chunks must allow for distance // chunks errors, the rest for one less.
        extra = distance % chunks + 1
        masks = []
        for c in range(chunks):
            allowed = wrong if c < extra else wrong - 1
            if allowed >= 0:
                masks += [[c * size + i for i in keep] for keep in combinations(range(size), size - allowed)]
        self.masks = masks


def shingle_sets(texts, shingle: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (position, sorted distinct 64-bit shingle hashes) of each text, A-Z lower-cased."""
    data = [encoded(t).lower() for t in texts]
    for first, h, bounds in batch_word_hashes(data, _SPACE):
        for i in range(len(bounds) - 1):
            w = h[bounds[i] : bounds[i + 1]]
            n = min(shingle, len(w))
            if n:
                s = w[: len(w) - n + 1] + _U(n)
                for k in range(1, n):
                    s = mix(s) * _U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
                s = np.sort(mix(s))
                if len(s) > 1:
                    s = s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                s = w
            yield first + i, s


def signature(s: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The minimum of each permuted hash, folded to 16 bits; long sets go through in pieces."""
    low = np.full(scheme.symbols, 0xFFFFFFFF, np.uint32)
    x = (s >> _U(32)).astype(np.uint32)
    for at in range(0, len(x), 8192):
        y = (x[None, at : at + 8192] ^ scheme.b[:, None]) * scheme.a[:, None]
        np.minimum(low, y.min(axis=1), out=low)
    return (mix(low.astype(np.uint64) + _U(1)) >> _U(48)).astype(np.uint16)


def index_keys(sig: np.ndarray, scheme: Scheme) -> np.ndarray:
    """The keys under which a signature is found: one for each chunk and allowed choice of left-out symbols."""
    out = np.empty(len(scheme.masks), np.uint64)
    out[:] = np.arange(1, len(out) + 1)
    wide = sig.astype(np.uint64)
    grid = np.array(scheme.masks) if len({len(m) for m in scheme.masks}) == 1 else None
    if grid is not None:
        for j in range(grid.shape[1]):
            out = mix(out) * _U(0x9E3779B97F4A7C15) + wide[grid[:, j]]
    else:
        for k, keep in enumerate(scheme.masks):
            h = out[k : k + 1]
            for j in keep:
                h = mix(h) * _U(0x9E3779B97F4A7C15) + wide[j : j + 1]
            out[k] = h[0]
    return mix(out).view(np.int64)


def sketch(docs: DataFrame, scheme: Scheme) -> DataFrame:
    """doc_id, n_shingles, set digest (null for empty sets) and signature of every row; one pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, key, sig = [0] * len(pdf), [None] * len(pdf), [None] * len(pdf)
            for i, s in shingle_sets(pdf["text"], scheme.shingle):
                if len(s):
                    n[i] = len(s)
                    key[i] = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    sig[i] = signature(s, scheme).tobytes()
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_shingles": n, "set_key": key, "sig": sig})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def _near(pair_sigs: DataFrame, limit: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures differ in at most ``limit`` symbols."""

    @F.pandas_udf("int")
    def differ(sa: pd.Series, sb: pd.Series) -> pd.Series:
        if not len(sa):
            return pd.Series([], dtype="int32")
        x = np.frombuffer(b"".join(sa), np.uint16).reshape(len(sa), -1)
        y = np.frombuffer(b"".join(sb), np.uint16).reshape(len(sb), -1)
        return pd.Series((x != y).sum(axis=1).astype("int32"))

    return pair_sigs.where(differ("sa", "sb") <= limit).select("a", "b")


def confirm(pairs: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; texts travel to their pairs and sets are rebuilt there."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("i"), "text")
    num, den = scheme.numerator, scheme.denominator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, left = None, None
        for pdf in batches:
            right = dict(shingle_sets(pdf["tb"], scheme.shingle))
            ok = np.zeros(len(pdf), bool)
            a, ta = pdf["a"].to_numpy(), pdf["ta"]
            for k in range(len(pdf)):
                if a[k] != last:
                    last, left = a[k], next(shingle_sets([ta.iloc[k]], scheme.shingle))[1]
                r = right[k]
                if den * min(len(left), len(r)) < num * max(len(left), len(r)):
                    continue
                at = np.searchsorted(left, r)
                at[at == len(left)] = 0
                same = int((left[at] == r).sum()) if len(left) else 0
                ok[k] = same > 0 and den * same >= num * (len(left) + len(r) - same)
            yield pdf.loc[ok, ["a", "b"]]

    withb = pairs.join(texts.select(F.col("i").alias("b"), F.col("text").alias("tb")), "b")
    both = withb.join(texts.select(F.col("i").alias("a"), F.col("text").alias("ta")), "a")
    return both.select("a", "b", "ta", "tb").mapInPandas(run, "a long, b long")


def _sets(docs: DataFrame, ids: DataFrame, scheme: Scheme) -> DataFrame:
    """(rep, shingles): the whole sets of some documents, eight bytes of hash a shingle, in order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            packed = [b""] * len(pdf)
            for i, s in shingle_sets(pdf["text"], scheme.shingle):
                packed[i] = s.tobytes()
            yield pd.DataFrame({"rep": pdf["rep"], "shingles": packed})

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    return texts.join(ids.select("rep").distinct(), "rep").mapInPandas(run, "rep long, shingles binary")


def _cross_links(members: DataFrame, docs: DataFrame, scheme: Scheme) -> DataFrame:
    """Links (a, b) between components that share keys: a spanning forest of those in each block.

    ``members`` are (key, rep, comp, n_shingles). Keys of one component are done. The whole sets of the others' members meet
    in blocks of a bounded number of shingles, where each row outside the largest component is compared with all rows, on
    full sets, and only links that join two components leave.
    """
    # like sets meet under many keys: of keys that have the same members, told by 128 bits of hash and their number, one does
    low, high = F.bit_xor(F.xxhash64("rep")), F.bit_xor(F.xxhash64("rep", F.lit(1)))
    counts = members.groupBy("key").agg(F.sum("n_shingles").alias("w"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("n"), low.alias("x"), high.alias("y"))
    counts = counts.where("lo < hi").groupBy("lo", "hi", "w", "n", "x", "y").agg(F.min("key").alias("key"))
    counts = counts.select("key", F.ceil(F.col("w") / scheme.block).cast("int").alias("parts"))
    placed = (
        members.join(counts, "key")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "rep", "comp")
    )
    placed = cut(placed)
    num, den = scheme.numerator, scheme.denominator

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in runs(batches, ["key", "p", "q"]):
            found = meet(group["rep"].to_numpy(), group["comp"].to_numpy(), group["shingles"].tolist())
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    def meet(rep: np.ndarray, comp: np.ndarray, packed: list) -> list[tuple[int, int]]:
        kinds, at, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return []
        n = np.array([len(x) // 8 for x in packed])
        number = np.unique(np.frombuffer(b"".join(packed), np.uint64), return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(n)[:-1]])
        mark = np.zeros(int(number.max()) + 1, bool)
        root = list(range(len(kinds)))
        out = []

        def top(k: int) -> int:
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for i in np.flatnonzero(at != sizes.argmax()):
            mine = number[start[i] : start[i] + n[i]]
            mark[mine] = True
            same = np.add.reduceat(mark[number], start, dtype=np.int64)
            mark[mine] = False
            for j in np.flatnonzero((den * same >= num * (n[i] + n - same)) & (at != at[i])):
                u, v = top(at[i]), top(at[j])
                if u != v:
                    root[max(u, v)] = min(u, v)
                    out.append((min(rep[i], rep[j]), max(rep[i], rep[j])))
        return out

    keys = ["key", "p", "q"]
    rows = placed.join(_sets(docs, placed, scheme), "rep").select(*keys, "rep", "comp", "shingles")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long")


def runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of equal keys in a sorted stream of batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[keys].to_numpy()
        edges = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        parts = np.concatenate([[0], edges, [len(pdf)]])
        for s, e in zip(parts[:-1], parts[1:], strict=True):
            if held and (held[-1][keys].iloc[-1].to_numpy() != k[s]).any():
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            held.append(pdf.iloc[s:e])
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def keep_one(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """One document of each group of near-duplicates, with its columns: the smallest doc_id, once.

    Rows of one doc_id are one document, of which the row with the least hash of its text stays; rows without doc_id stay.
    Only ids that repeat are sorted for that.
    """
    dropped = near_duplicates(docs, scheme).where("not kept").select("doc_id").distinct()
    named = docs.where("doc_id is not null").join(dropped, "doc_id", "left_anti")
    repeated = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = named.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.struct(F.xxhash64("text"), F.coalesce("text", F.lit("")))).alias("row"))
    one = first.select(*[F.col(f"row.`{c}`") for c in docs.columns])
    return named.join(repeated, "doc_id", "left_anti").select(docs.columns).unionByName(one).unionByName(docs.where("doc_id is null"))


def near_duplicates(docs: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs(doc_id, text)."""
    scheme = scheme or Scheme()
    rows = cut(sketch(docs, scheme))
    classes = cut(rows.where("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles")))

    @F.pandas_udf("array<long>")
    def keys_of(sigs: pd.Series) -> pd.Series:
        return pd.Series([index_keys(np.frombuffer(s, np.uint16), scheme) for s in sigs], dtype=object)

    index = classes.select("rep", F.explode(keys_of("sig")).alias("key"))
    lead = index.groupBy("key").agg(F.min("rep").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "lead")
    shared = cut(index.join(lead, "key").select("key", "rep", "lead"))

    sigs = classes.select("rep", "sig")
    stars = shared.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b")).distinct()
    stars = cut(
        _near(
            stars.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b"),
            scheme.reach,
        )
    )
    linked = cut(confirm(stars, docs, scheme))
    first = connected_components(linked)

    members = shared.select("key", "rep").join(first.select(F.col("node").alias("rep"), "component"), "rep", "left")
    members = members.withColumn("comp", F.coalesce("component", "rep")).drop("component").join(classes.select("rep", "n_shingles"), "rep")
    final = connected_components(linked.unionByName(_cross_links(members, docs, scheme)))

    named = classes.select("set_key", "rep").join(final.select(F.col("node").alias("rep"), "component"), "rep", "left")
    named = named.select(F.col("set_key").alias("key"), F.coalesce("component", "rep").alias("c"))
    # empty sets have no key; each such row gets one of its own, longer than any digest, so that they do not gather
    own = F.coalesce("set_key", F.concat(F.lit("-" * 17), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (
        rows.drop("sig")
        .withColumn("key", own)
        .join(named, "key", "left")
        .select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
        .withColumn("kept", F.col("doc_id") == F.col("component_id"))
    )
