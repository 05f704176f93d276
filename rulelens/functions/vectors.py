"""Vector and score expressions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FEATURE_WORD


def normalized(v: Column) -> Column:
    """M2: scaled to unit length in double precision; a zero vector stays as it is."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(d, lambda x: x / norm)).otherwise(d)


def inner_product(a: Column, b: Column) -> Column:
    """M3: summed in double precision, in the order of the components."""
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def clamp(score: Column) -> Column:
    """M4: cut to 0..1, never rescaled."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def bm25(tf: Column, df: Column, dl: Column, n: Column, avgdl: Column, k1: float = 1.5, b: float = 0.75) -> Column:
    """M5: one term's contribution."""
    idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
    return idf * (tf * (k1 + 1)) / (tf + k1 * (1 - b + b * dl / F.greatest(avgdl, F.lit(1.0))))


def squash(logit: Column) -> Column:
    """M6: the logistic of a logit cut to ±20; null for null, which greatest and least would pass over."""
    return F.when(logit.isNotNull(), 1 / (1 + F.exp(-F.greatest(F.lit(-20.0), F.least(F.lit(20.0), logit)))))


def ratio(n: Column, d: Column) -> Column:
    """M7: to four places, zero over zero being zero."""
    return F.coalesce(F.round(n / F.nullif(d.cast("double"), F.lit(0.0)), 4), F.lit(0.0))


#: Rows whose vectors a Python worker holds at once.
PIECE = 512


def _hashing(dim: int, features_of):
    """A pandas UDF that hashes the features of each row; all it needs is within it, so that it travels whole."""

    class Slots(dict):
        """Twice the index of each feature, and one more where its sign is plus; a bounded number of them is remembered."""

        def __missing__(self, feature: str) -> int:
            h = hashlib.blake2b(feature.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            slot = int.from_bytes(h[:8], "little") % dim * 2 + (h[8] & 1)
            if len(self) < 200_000:
                self[feature] = slot
            return slot

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        slots = Slots()
        # vectors leave in pieces, so that a worker never holds those of a whole batch
        for batch in (whole.iloc[i : i + PIECE] for whole in parts for i in range(0, len(whole), PIECE)):
            out = []
            for row in batch:
                at = np.fromiter(map(slots.__getitem__, features_of(row) if row is not None else ()), np.int64)
                counts = np.bincount(at, minlength=2 * dim).reshape(dim, 2)
                v = (counts[:, 1] - counts[:, 0]).astype(np.float64)
                norm = np.sqrt((v * v).sum())
                out.append((v / norm if norm else v).astype(np.float32))
            yield pd.Series(out)

    return run


def hash_features(dim: int = 768):
    """M1: a pandas UDF from feature words to a unit vector, by signed hashing with blake2b.

    No built-in function offers blake2b, hence Arrow batches: the index is the first eight bytes, little-endian, modulo the
    dimension, and the sign the lowest bit of the ninth.
    """
    return _hashing(dim, lambda features: features)


def hash_text(text: Column, dim: int = 768) -> Column:
    """T10 and M1 of a text at once: ``hash_features(dim)(feature_words(text))`` without an array of words for each row.

    Only the text travels to Python, where the features of one row at a time are cut and counted; null texts have none.
    """
    word = re.compile(FEATURE_WORD)

    def features(lowered: str):
        words = word.findall(lowered)
        return chain(words, map("::".join, pairwise(words)))

    return _hashing(dim, features)(F.lower(text))
