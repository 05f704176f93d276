"""Embedding near-dedup: random-hyperplane sign hashing in several tables, exact cosine checks, connected components.

Vectors are compared only under equal, non-null labels. Equal vectors collapse to one representative with a count. In each
table a vector's bucket is its signs against ``bits`` random hyperplanes; at a cosine of 0.93 two vectors agree in one sign
with probability 0.88, so they share a bucket of 12 signs with 0.216 and one of 40 tables with all but 6 in 100,000.

Bucket rows go to salted blocks: a bucket of more than ``block`` members is split by the members' hash, and every pair of its
parts meets in one task, whose memory is bounded by two parts. A block yields, for each member, how many vectors it links to
of which no earlier table has told (both signatures are at hand, so that is plain to see), and a spanning forest of its
links. Output is thus in proportion to the rows, never to the pairs, and link counts and components are those of all pairs.

Defined results: null labels and vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different length never link; rows with equal vectors link with one another; repeated vec_ids count as several
vectors and get one component; null vec_ids are reported alone with a null component; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship
from .components import connected_components

#: Buckets of no more members than this are met many at a time.
SMALL = 48


class Hashing:
    """Parameters of the sign hashing."""

    def __init__(self, bits: int = 12, tables: int = 40, block: int = 2048, seed: int = 5):
        self.bits, self.tables, self.block, self.seed = bits, tables, block, seed

    def signs(self, x: np.ndarray) -> np.ndarray:
        """Bucket numbers, one row a vector and one column a table."""
        planes = np.random.default_rng([self.seed, x.shape[1]]).standard_normal((x.shape[1], self.bits * self.tables))
        on = (x @ planes > 0).reshape(len(x), self.tables, self.bits)
        return (on * (1 << np.arange(self.bits))).sum(axis=2).astype(np.uint16 if self.bits <= 16 else np.uint32)


def _unit(x: np.ndarray) -> np.ndarray:
    # scaling by the largest component first keeps squares of huge or tiny vectors within range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _bucketed(vectors: DataFrame, h: Hashing) -> DataFrame:
    """(rep, label, copies, dim, vec, sig, buckets) of usable vectors, vec being doubles in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = pdf["embedding"].map(len).to_numpy() if len(pdf) else np.empty(0, int)
            for dim in np.unique(size):
                part = pdf[size == dim]
                x = _unit(np.stack(part["embedding"].to_numpy()).astype(np.float64))
                sig = h.signs(x)
                yield pd.DataFrame(
                    {
                        "rep": part["rep"].to_numpy(),
                        "label": part["label"].to_numpy(),
                        "copies": part["copies"].to_numpy(),
                        "dim": np.full(len(part), dim),
                        "vec": [v.tobytes() for v in x],
                        "sig": [s.tobytes() for s in sig],
                        "buckets": [s.astype(np.int32) for s in sig],
                    }
                )

    return vectors.mapInPandas(run, "rep long, label string, copies long, dim int, vec binary, sig binary, buckets array<int>")


def linked(rows: DataFrame, h: Hashing, cosine: float) -> DataFrame:
    """(a, b, n): b is null and n counts links of a first met in some block, or (a, b) is a forest link and n null."""
    wide = np.uint16 if h.bits <= 16 else np.uint32
    keys = ["dim", "label", "tab", "bucket", "p", "q"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            held, edges = None, _edges(pdf, keys)
            # the last bucket of a batch may go on in the next one
            held = pdf.iloc[edges[-2] :].reset_index(drop=True)
            yield from buckets(pdf.iloc[: edges[-2]], edges[:-1])
        if held is not None:
            yield from buckets(held, _edges(held, keys))

    def buckets(pdf: pd.DataFrame, edges: np.ndarray) -> Iterator[pd.DataFrame]:
        size = np.diff(edges)
        for g in np.flatnonzero(size > SMALL):
            yield from meet(pdf.iloc[edges[g] : edges[g + 1]])
        end = np.repeat(edges[1:], size)
        few = np.repeat((size > 1) & (size <= SMALL), size)
        if few.any():
            # rows keep their order, so the ends move by what is left out before them
            left_out = np.cumsum(~few)
            end = (end - left_out[np.minimum(end, len(few)) - 1])[few]
            yield from small(pdf[few], end)

    def small(pdf: pd.DataFrame, end: np.ndarray) -> Iterator[pd.DataFrame]:
        """All small buckets of a batch at once: each row with the next one of its bucket, then with the one after, and so on."""
        n = len(pdf)
        at, rep, own, copies = np.arange(n), pdf["rep"].to_numpy(), pdf["own"].to_numpy(), pdf["copies"].to_numpy()
        tab, apart, dim = pdf["tab"].to_numpy(), (pdf["p"] != pdf["q"]).to_numpy(), pdf["dim"].to_numpy()
        first, second = [], []
        for d in np.unique(dim):
            rows_ = np.flatnonzero(dim == d)
            x = np.frombuffer(b"".join(pdf["vec"].iloc[rows_])).reshape(len(rows_), -1)
            place = np.full(n, -1)
            place[rows_] = np.arange(len(rows_))
            for lag in range(1, SMALL):
                i = rows_[at[rows_] + lag < end[rows_]]
                if not len(i):
                    break
                j = i + lag
                i, j = (v[~apart[i] | (own[i] != own[j])] for v in (i, j))
                ok = np.einsum("ij,ij->i", x[place[i]], x[place[j]]) >= cosine
                first.append(i[ok])
                second.append(j[ok])
        i, j = np.concatenate(first or [at[:0]]), np.concatenate(second or [at[:0]])
        if not len(i):
            return
        same = np.frombuffer(b"".join(pdf["sig"].iloc[i]), wide).reshape(len(i), -1) == np.frombuffer(b"".join(pdf["sig"].iloc[j]), wide).reshape(len(i), -1)
        fresh = same.argmax(axis=1) == tab[i]
        count = np.zeros(n, np.int64)
        np.add.at(count, i[fresh], copies[j[fresh]])
        np.add.at(count, j[fresh], copies[i[fresh]])
        root: dict[int, int] = {}
        a, b = [], []
        for u, v in zip(i.tolist(), j.tolist(), strict=True):
            while (k := root.get(u, u)) != u:
                u = k
            while (k := root.get(v, v)) != v:
                v = k
            if u != v:
                root[max(u, v)] = min(u, v)
                a.append(rep[max(u, v)])
                b.append(rep[min(u, v)])
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"a": rep[met], "b": pd.array([None] * len(met), "Int64"), "n": pd.array(count[met], "Int64")})
        if a:
            yield pd.DataFrame({"a": a, "b": pd.array(b, "Int64"), "n": pd.array([None] * len(a), "Int64")})

    def meet(g: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = np.frombuffer(b"".join(g["vec"])).reshape(len(g), -1)
        sig = np.frombuffer(b"".join(g["sig"]), wide).reshape(len(g), -1)
        rep, own, copies = g["rep"].to_numpy(), g["own"].to_numpy(), g["copies"].to_numpy()
        tab = int(g["tab"].iat[0])
        apart = g["p"].iat[0] != g["q"].iat[0]
        left = np.flatnonzero(own == g["p"].iat[0]) if apart else np.arange(len(g))
        right = np.flatnonzero(own != g["p"].iat[0]) if apart else left
        count, root = np.zeros(len(g), np.int64), np.arange(len(g))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for at in range(0, len(left), 512):
            rows_ = left[at : at + 512]
            # a last step in one order of summation, so that either order of a pair gives one value
            close = x[rows_] @ x[right].T >= cosine - 1e-9
            i, j = np.nonzero(close)
            i, j = rows_[i], right[j]
            once = i < j if not apart else np.ones(len(i), bool)
            i, j = i[once], j[once]
            for s in range(0, len(i), 100_000):
                a, b = i[s : s + 100_000], j[s : s + 100_000]
                ok = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[ok], b[ok]
                if tab:
                    fresh = ~(sig[a, :tab] == sig[b, :tab]).any(axis=1)
                else:
                    fresh = np.ones(len(a), bool)
                np.add.at(count, a[fresh], copies[b[fresh]])
                np.add.at(count, b[fresh], copies[a[fresh]])
                for u, v in zip(a.tolist(), b.tolist(), strict=True) if len(a) < 64 else _forest(a, b, len(g)):
                    u, v = top(u), top(v)
                    if u != v:
                        root[max(u, v)] = min(u, v)
        met = np.flatnonzero(count)
        if len(met):
            yield pd.DataFrame({"a": rep[met], "b": pd.array([None] * len(met), "Int64"), "n": pd.array(count[met], "Int64")})
        tops = np.array([top(i) for i in range(len(g))])
        out = np.flatnonzero(tops != np.arange(len(g)))
        if len(out):
            yield pd.DataFrame({"a": rep[out], "b": pd.array(rep[tops[out]], "Int64"), "n": pd.array([None] * len(out), "Int64")})

    tables = rows.select("rep", "label", "copies", "dim", "vec", "sig", F.posexplode("buckets").alias("tab", "bucket"))
    sizes = tables.groupBy("dim", "label", "tab", "bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    sizes = sizes.select("dim", "label", "tab", "bucket", F.ceil(F.col("m") / h.block).cast("int").alias("parts"))
    placed = (
        tables.join(sizes, ["dim", "label", "tab", "bucket"])
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .withColumn("p", F.least("own", "other"))
        .withColumn("q", F.greatest("own", "other"))
        .select(*keys, "own", "rep", "copies", "vec", "sig")
    )
    return placed.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(run, "a long, b long, n long")


def _edges(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Where the runs of equal keys begin, and the number of rows; for no rows, (0, 0)."""
    new = np.zeros(max(len(pdf) - 1, 0), bool)
    for k in keys:
        v = pdf[k].to_numpy()
        new |= v[1:] != v[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(pdf)]])


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of many links among n members."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return iter([(i, int(low[i])) for i in range(n) if low[i] != i])


def near_duplicates(vectors: DataFrame, cosine: float = 0.93, hashing: Hashing | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors(vec_id, embedding, label)."""
    h = hashing or Hashing()
    ship(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.col("label").cast("string").alias("label"),
    )
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    usable = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda v: v != 0)
    rows = rows.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), F.struct("label", F.transform("embedding", lambda v: v + 0.0).alias("v"))))
    classes = (
        rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    classes = cut(classes)
    hashed = cut(_bucketed(classes.select("rep", F.col("key.label").alias("label"), "copies", F.col("key.v").alias("embedding")), h))
    found = cut(linked(hashed, h, cosine))
    counts = found.where("n is not null").groupBy("a").agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    named = (
        classes.join(counts.withColumnRenamed("a", "rep"), "rep", "left")
        .join(parts.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    )
    return (
        rows.join(named, "key", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
