"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are its distinct word unigrams and bigrams, as written, between blanks, hashed to ``2**bits`` buckets,
each of the same value, three divided by their number to the power 3/4. The model is fitted on at most ``max_train_rows``
labelled rows and ``MAX_TRAIN_BYTES`` of features, those of the lowest hash of doc_id, in one task; every row is scored, as a
sparse dot product with the weights, which are sent to the executors (at most ``2**bits`` doubles).

Defined results: null and wordless texts have only the bias, so they score as the training rows do on average; rows without
a label are not learnt from; null doc_ids count as held out of learning and are scored; without any labelled row every
score is 0.5; repeated rows are scored each, and learnt from each, within the bounds; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batch_word_hashes, encoded, mix, ship, space_table

_SPACE = space_table(BLANKS)
_U = np.uint64
#: The bigram of any word with itself, which all repetitions share.
_TWICE = mix(np.array([11], np.uint64))
#: The bias's constant input.
BIAS = 0.3
BITS = 18
MAX_TRAIN_ROWS = 12_000
#: Four bytes for each feature of each row that is learnt from.
MAX_TRAIN_BYTES = 256 << 20


def feature_runs(texts, bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Yield (position, features) of each text: distinct bucket numbers of its unigrams and bigrams."""
    data = [encoded(t) for t in texts]
    shift = _U(64 - bits)
    for first, h, bounds in batch_word_hashes(data, _SPACE):
        for i in range(len(bounds) - 1):
            w = h[bounds[i] : bounds[i + 1]]
            pair = mix(w[:-1] * _U(3) + w[1:]) if len(w) > 1 else w[:0]
            grams = [w, pair, _TWICE] if (w[1:] == w[:-1]).any() else [w, pair]
            yield first + i, np.unique(np.concatenate(grams) >> shift).astype(np.int32)


def value(features: np.ndarray) -> float:
    """What each feature of a text counts: less in long texts, so that neither length nor brevity decides."""
    return 3.0 / max(len(features), 1) ** 0.75


class Ftrl:
    """Per-coordinate FTRL-proximal logistic regression; the last coordinate is the bias."""

    def __init__(self, size: int, alpha: float = 5.0, beta: float = 1.0, l1: float = 0.0, l2: float = 0.01):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, features: np.ndarray, label: int) -> None:
        at = np.append(features, len(self.z) - 1)
        x = np.full(len(at), value(features))
        x[-1] = BIAS
        w = self.weights(at)
        p = 1.0 / (1.0 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - label) * x
        n = self.n[at]
        step = (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha
        self.z[at] += g - step * w
        self.n[at] = n + g * g


def fit(train: DataFrame, bits: int = BITS, epochs: int = 4, max_rows: int = MAX_TRAIN_ROWS, max_bytes: int = MAX_TRAIN_BYTES) -> np.ndarray:
    """Weights of train(o, label, text), float64, the bias last. Deterministic: rows go by ``o``, features and label.

    The one learning task keeps the first ``max_rows`` of that order, and of them as many as ``max_bytes`` of features hold.
    """
    spark = train.sparkSession
    ship(spark)
    size = 1 << bits

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [f.tobytes() for _, f in feature_runs(pdf["text"], bits)]
            yield pd.DataFrame({"o": pdf["o"], "label": pdf["label"], "f": rows})

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            # what comes after the bounds is read to its end but not kept
            for r in zip(pdf["o"], pdf["f"], pdf["label"], strict=True):
                held += len(r[1])
                if len(rows) < max_rows and held <= max_bytes:
                    rows.append(r)
        if not rows:
            return
        model = Ftrl(size)
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(rows)):
                model.learn(np.frombuffer(rows[k][1], np.int32), rows[k][2])
        w = model.weights(np.arange(size + 1))
        at = np.flatnonzero(w)
        yield pd.DataFrame({"i": at, "w": w[at]})

    found = (
        train.mapInPandas(featurise, "o long, label int, f binary")
        .repartition(1)  # the sample alone moves into one task, sorted on disk; coalescing would pull the scan into it
        .sortWithinPartitions("o", "f", "label")
        .mapInPandas(learn, "i long, w double")
        .toPandas()
    )
    w = np.zeros(size + 1)
    w[found["i"].to_numpy(np.int64)] = found["w"].to_numpy()
    return w


def training_rows(docs: DataFrame, labels: DataFrame, learnable, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """(o, label, text) of labelled rows that ``learnable`` admits, of the ``max_train_rows`` lowest id hashes.

    An id may have several rows, so ``fit`` bounds the rows again.
    """
    ids = (
        labels.where("quality in (0, 1) and doc_id is not null")
        .where(learnable)
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("label"))
        .withColumn("o", F.xxhash64("doc_id"))
        .orderBy("o", "doc_id")
        .limit(max_train_rows)
    )
    # bounded by max_train_rows, so it may be broadcast whatever the size of the corpus
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("o", "label", "text")


def score(docs: DataFrame, weights: np.ndarray, bits: int = BITS):
    """A column of scores over ``text``: the logistic of a sparse dot product."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value
        for texts in parts:
            out = np.zeros(len(texts))
            for i, f in feature_runs(texts, bits):
                out[i] = w[f].sum() * value(f) + w[-1] * BIAS
            yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(out, -35, 35))))

    return run(F.col("text"))


#: The held-out quarter of rows.
HELD_OUT = "crc32(cast(cast(doc_id as string) as binary)) % 4 = 2"


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every document; held-out rows teach nothing."""
    weights = fit(training_rows(docs, labels, f"not ({HELD_OUT})", max_train_rows), max_rows=max_train_rows)
    return docs.select(
        "doc_id", F.coalesce(F.expr(HELD_OUT), F.lit(True)).alias("held_out"), score(docs, weights).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_train_rows: int = MAX_TRAIN_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with their columns."""
    weights = fit(training_rows(docs, labels, f"not ({HELD_OUT})", max_train_rows), max_rows=max_train_rows)
    return docs.where(score(docs, weights) >= threshold)
