"""Hard-negative mining with a vector-approximation file.

Every component of a vector is quantised into one of ``2 ** bits`` cells, marked by the least and greatest value of its dimension.
An anchor has, for each dimension and cell, the least and greatest product its component can have with a value of that cell;
sums of such table entries bound its score with a row from below and above without a look at the row itself. Only rows whose
bounds leave it open whether they enter a window are scored, exactly, in whole numbers.

Two passes meet the anchors, which are the stated query set, with all rows, in blocks: the first for the best rows of an
anchor's own label (its positives), the second for the best rows of other labels whose score lies between a share of a positive's
score and that score itself. In a block the k-th greatest lower bound, among rows that are sure to be in the window, is a mark
that a row must be able to reach; each block yields at most k rows for each window, and the best k of all blocks are kept. A
block's size bounds the memory of its task; neither a label nor a group of copies makes any block larger.

Defined results: rows with a null vec_id, label or vector, or with a null or non-finite component, take no part; vectors of
different length do not meet; rows equal in all three columns count once; rows that share a vec_id but differ are rows of their
own and, where scores and vec_ids tie, go by label and then by vector; a window without rows gives none; components beyond
``limit`` (2**27 in 64 dimensions) are held there, so that every score fits a long; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, ship


class Approximation:
    """Parameters: bits of a cell's number, rows and anchors of a block, anchors bounded at a time."""

    def __init__(self, bits: int = 6, rows: int = 16384, anchors: int = 4096, at_once: int = 64):
        self.bits, self.rows, self.anchors, self.at_once = bits, rows, anchors, at_once
        if not 1 <= bits <= 8:
            raise ValueError("a cell's number has one to eight bits")


def limit(dimensions: int) -> int:
    """The greatest size of a whole-number component for which no score can leave a long."""
    return int((2.0**62 / max(dimensions, 1)) ** 0.5)


# --- within a task -----------------------------------------------------------------------------------


class Cells:
    """Cell marks of one dimensionality: cell c of dimension d holds the whole numbers from marks[d, c] to marks[d, c + 1] - 1."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int):
        n = 1 << bits
        width = np.maximum(-(-(high - low + 1) // n), 1)
        self.low, self.width, self.n = low, width, n
        self.first = low[:, None] + width[:, None] * np.arange(n)
        self.last = np.minimum(self.first + width[:, None] - 1, high[:, None])

    def number(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.low) // self.width).astype(np.uint8)

    def tables(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest products, [dimension, cell, anchor]."""
        a, b = (self.first[:, :, None] * anchors.T[:, None, :], self.last[:, :, None] * anchors.T[:, None, :])
        low, high = np.minimum(a, b), np.maximum(a, b)
        if max(np.abs(t).max(axis=1).sum(axis=0).max() for t in (low, high)) < 2**31:
            low, high = low.astype(np.int32), high.astype(np.int32)
        return low, high


def bounds(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums of table entries: [row, anchor] for cells[row, dimension] and table[dimension, cell, anchor]."""
    out = np.zeros((len(cells), table.shape[2]), table.dtype)
    for d in range(cells.shape[1]):
        out += table[d].take(cells[:, d], axis=0)
    return out


def _mark(low: np.ndarray, sure: np.ndarray, k: int) -> np.ndarray:
    """For each column, the k-th greatest of the entries that are sure; where there are fewer, less than any."""
    least = np.iinfo(low.dtype).min
    if len(low) < k:
        return np.full(low.shape[1], least, low.dtype)
    return np.partition(np.where(sure, low, least), len(low) - k, axis=0)[len(low) - k]


def _best(anchor: np.ndarray, score: np.ndarray, order: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each anchor, by score descending and then by order."""
    at = np.lexsort((order, -score, anchor))
    a = anchor[at]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    return at[rank < k]


class Block:
    """The rows of one block and the anchors they meet, as whole numbers, in the order of ties."""

    def __init__(self, rows: pd.DataFrame, anchors: pd.DataFrame, cells: Cells, at_once: int):
        # "key" tells the very same row apart; ties go by vec_id, then by label, then by vector
        self.rows = rows.sort_values(["vec_id", "label", "key"], kind="stable")
        self.anchors, self.cells, self.at_once = anchors, cells, at_once
        self.x = np.frombuffer(b"".join(self.rows["ints"]), np.int64).reshape(len(rows), -1)
        self.q = np.frombuffer(b"".join(anchors["ints"]), np.int64).reshape(len(anchors), -1)
        codes, self.label = np.unique(np.concatenate([self.rows["label"].to_numpy(object), anchors["label"].to_numpy(object)]).astype(str), return_inverse=True)
        self.key = self.rows["key"].to_numpy()
        self.number = cells.number(self.x)

    def spans(self) -> Iterator[tuple]:
        """Of some anchors at a time: where they are, their label equal to each row's or not, lower and upper bounds."""
        n = len(self.rows)
        for s in range(0, len(self.q), self.at_once):
            part = slice(s, min(s + self.at_once, len(self.q)))
            low, high = self.cells.tables(self.q[part])
            alike = self.label[:n, None] == self.label[n:][part][None, :]
            yield part, alike, bounds(self.number, low), bounds(self.number, high)

    def exact(self, row: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        out = np.empty(len(row), np.int64)
        for s in range(0, len(row), 65536):
            out[s : s + 65536] = np.einsum("ij,ij->i", self.x[row[s : s + 65536]], self.q[anchor[s : s + 65536]])
        return out

    def positives(self, k: int) -> tuple:
        """(row, anchor, score) of the best k rows of each anchor's own label, itself left out; and how many were scored."""
        found, scored = [], 0
        own = self.anchors["key"].to_numpy()
        for part, alike, low, high in self.spans():
            alike &= self.key[:, None] != own[part][None, :]
            row, anchor = np.nonzero(alike & (high >= _mark(low, alike, k)))
            score = self.exact(row, anchor + part.start)
            scored += len(row)
            top = _best(anchor, score, row, k)
            found.append((row[top], anchor[top] + part.start, score[top]))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), scored

    def negatives(self, k: int, floor: int, of: int) -> tuple:
        """(row, anchor, place of the positive, score) of the best k in each window; and how many were scored.

        A window of a positive's score p holds the rows of other labels with floor * p <= of * score <= of * p.
        """
        found, scored = [], 0
        given = self.anchors["scores"].map(list).to_list()
        for part, alike, low, high in self.spans():
            most = max(map(len, given[part]), default=0)
            window = np.zeros((most, low.shape[1]), np.int64)
            there = np.zeros((most, low.shape[1]), bool)
            for i, scores in enumerate(given[part]):
                window[: len(scores), i], there[: len(scores), i] = scores, True
            wanted = []
            for p, live in zip(window, there, strict=True):
                least = -(-floor * p // of)
                open_ = ~alike & live & (low <= p) & (high >= least)
                sure = open_ & (high <= p) & (low >= least)
                wanted.append(open_ & (high >= _mark(low, sure, k)))
            if not wanted:
                continue
            row, anchor = np.nonzero(np.logical_or.reduce(wanted))
            score = self.exact(row, anchor + part.start)
            scored += len(row)
            for place, (p, live) in enumerate(zip(window, there, strict=True)):
                inside = np.flatnonzero(live[anchor] & (floor * p[anchor] <= of * score) & (score <= p[anchor]))
                top = inside[_best(anchor[inside], score[inside], row[inside], k)]
                found.append((row[top], anchor[top] + part.start, np.full(len(top), place), score[top]))
        return *(np.concatenate(x) for x in zip(*found, strict=True)), scored


# --- the plan ----------------------------------------------------------------------------------------


def whole_numbers(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, x as a double, held within ``limit``."""
    bound = F.sqrt(F.lit(2.0**62) / F.greatest(F.size(vector), F.lit(1)))
    held = lambda v: F.greatest(F.least(F.floor(F.lit(scale) * v), F.floor(bound)), -F.floor(bound)).cast("long")
    return F.transform(vector.cast("array<double>"), held)


def _usable(vectors: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    numbers = rows.select("vec_id", "label", whole_numbers(F.col("embedding")).alias("x"), F.sha2(F.to_json(F.struct("embedding")).cast("binary"), 256).alias("v"))
    return numbers.distinct().select("vec_id", "label", "x", F.size("x").alias("dim"), F.concat_ws(":", "vec_id", "label", "v").alias("key"))


def _ranges(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Least and greatest value of each dimension; one row for each dimension reaches the driver."""
    each = rows.select("dim", F.posexplode("x").alias("d", "x")).groupBy("dim", "d").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    found: dict[int, tuple[list, list]] = {}
    for r in each.orderBy("dim", "d").collect():
        low, high = found.setdefault(r["dim"], ([], []))
        low.append(r["low"])
        high.append(r["high"])
    return {k: (np.array(a, np.int64), np.array(b, np.int64)) for k, (a, b) in found.items()}


def _met(rows: DataFrame, anchors: DataFrame, run, schema: str, n_rows: int, n_anchors: int, a: Approximation) -> DataFrame:
    """Every block of anchors with every block of rows of its dimension, one task's group each."""
    parallel = rows.sparkSession.sparkContext.defaultParallelism
    row_blocks = max(-(-n_rows // a.rows), min(parallel, -(-n_rows // 2048)), 1)
    anchor_blocks = max(-(-n_anchors // a.anchors), 1)
    of = lambda n: F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")
    left = rows.withColumn("rb", of(row_blocks)).withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    right = anchors.withColumn("ab", of(anchor_blocks)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    right = right.toDF(*right.columns)  # both sides come from one table; these are columns of its own
    keys = ["dim", "rb", "ab"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, schema)


def _packed(rows: DataFrame) -> DataFrame:
    """Vectors as bytes, eight for each whole number, so that tasks read them without a list for each row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["ints"] = [np.asarray(x, np.int64).tobytes() for x in pdf["x"]]
            yield pdf[["vec_id", "label", "dim", "key", "ints"]]

    return rows.mapInPandas(run, "vec_id long, label string, dim int, key string, ints binary")


def _first(df: DataFrame, keys: list[str], score: str, then: list[str], k: int, rank: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *then)
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= k)


def mine(vectors: DataFrame, is_anchor: Column, k: int = 5, negatives: int = 5, floor: int = 80, of: int = 100, how: Approximation | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score for vectors(vec_id, embedding, label).

    Anchors are the rows for which ``is_anchor``, a condition on vec_id, holds; their positives the best ``k`` other rows of
    their label. Of each positive the best ``negatives`` rows of other labels whose score is at least ``floor`` of ``of`` parts of
    the positive's, and at most the positive's, are given.
    """
    a = how or Approximation()
    ship(vectors.sparkSession)
    rows = cut(_usable(vectors))
    cells = {dim: Cells(*r, a.bits) for dim, r in _ranges(rows).items()}
    packed = cut(_packed(rows))
    chosen = packed.where(is_anchor)
    size = packed.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("m")).first()
    at_once = a.at_once

    def block(rows_: pd.DataFrame, anchors: pd.DataFrame) -> Block | None:
        if not len(rows_) or not len(anchors):
            return None
        dim = int(rows_["dim"].iat[0])
        return Block(rows_, anchors, cells.get(dim) or Cells(np.empty(0, np.int64), np.empty(0, np.int64), 1), at_once)

    good_schema = "anchor string, anchor_id long, positive string, positive_id long, score long"

    def best(rows_: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        b = block(rows_, anchors)
        if b is None:
            return pd.DataFrame(columns=[c.split()[0] for c in good_schema.split(", ")])
        row, anchor, score, _ = b.positives(k)
        own, other = b.anchors.iloc[anchor], b.rows.iloc[row]
        return pd.DataFrame({"anchor": own["key"].to_numpy(), "anchor_id": own["vec_id"].to_numpy(), "positive": other["key"].to_numpy(), "positive_id": other["vec_id"].to_numpy(), "score": score})

    good = _met(packed, chosen, best, good_schema, size["n"], size["m"], a)
    good = cut(_first(good, ["anchor"], "score", ["positive_id", "positive"], k, "place"))
    windows = good.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda x: x["score"]).alias("scores"))  # k at most
    asking = chosen.join(windows, chosen["key"] == windows["anchor"]).drop("anchor")
    bad_schema = "anchor string, place int, negative string, negative_id long, negative_score long"

    def worst(rows_: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        b = block(rows_, anchors)
        if b is None:
            return pd.DataFrame(columns=[c.split()[0] for c in bad_schema.split(", ")])
        row, anchor, place, score, _ = b.negatives(negatives, floor, of)
        other = b.rows.iloc[row]
        return pd.DataFrame({"anchor": b.anchors["key"].to_numpy()[anchor], "place": place + 1, "negative": other["key"].to_numpy(), "negative_id": other["vec_id"].to_numpy(), "negative_score": score})

    bad = _met(packed, asking, worst, bad_schema, size["n"], size["m"], a)
    bad = _first(bad, ["anchor", "place"], "negative_score", ["negative_id", "negative"], negatives, "rank")
    return bad.join(good, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", F.col("score").alias("positive_score"), "negative_score")


def relabelled(vectors: DataFrame) -> DataFrame:
    """``vectors`` with the label of every vec_id that is divisible by 7 moved on by one, modulo 10."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
