"""Models behind columns (X10, X11): embedding backends and cross-encoders, in batches, with bounded retries and errors as rows.

A model is opened once in each task and called on batches of at most ``Retry.batch`` items. A call that fails for a passing reason
is tried again, after as long as the service asks for or else ever longer waits; one that is refused for good is split in
halves, so that one bad item costs only its own row. Nothing a model does stops a job: a row has its result or the name of an
error. Rows are never grouped or shuffled, and each goes to the model in one pass.

Models are given as objects that tasks receive whole; their classes must be importable there.
"""

from __future__ import annotations

import importlib
import math
import os
import re
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import PIECE, hash_text
from .shipping import ship


class ModelUnavailable(RuntimeError):
    """A model that cannot be opened, or whose replies do not fit."""


@dataclass(frozen=True)
class Retry:
    """How failed calls are repeated (fixed values: batch and attempts, the margin on a told wait, the longest waits)."""

    batch: int = 64
    attempts: int = 5
    margin: float = 0.5
    longest_told: float = 60.0
    longest_own: float = 20.0


#: "retry in 3 s", "retryDelay: 3.5s" and the like in a message (fixed value).
_TOLD = re.compile(r"(?:retry(?:delay|\s+in)?[^0-9]{0,24})([0-9]+(?:\.[0-9]+)?)\s*s", re.IGNORECASE)


def passing(error: Exception) -> bool:
    """Whether a failure may pass: too many requests, a fault of the server, a broken or slow connection."""
    status = getattr(error, "status_code", None) or getattr(getattr(error, "response", None), "status_code", None)
    if isinstance(status, int):
        return status == 429 or status >= 500
    return isinstance(error, (TimeoutError, ConnectionError)) or re.search("timeout|ratelimit|connection", type(error).__name__.lower()) is not None


def wait_for(error: Exception, tries: int, retry: Retry) -> float:
    """Seconds before the next try: what the reply's header or message asks for, else twice as long each time."""
    headers = getattr(getattr(error, "response", None), "headers", None) or {}
    told = headers.get("retry-after", headers.get("Retry-After"))
    if told is None and (m := _TOLD.search(str(error))):
        told = m[1]
    try:
        return min(max(float(told), 0.0) + retry.margin, retry.longest_told)
    except (TypeError, ValueError):
        return min(2.0 ** (tries - 1), retry.longest_own)


class Calls:
    """Batched calls of one opened model; ``check`` turns a reply for n items into n results, or raises."""

    def __init__(self, call: Callable[[list], Sequence], check: Callable[[Sequence, int], list], retry: Retry, sleep: Callable[[float], None] = time.sleep):
        self.call, self.check, self.retry, self.sleep = call, check, retry, sleep

    def results(self, items: list) -> list[tuple]:
        """(result or None, error or None, tries) of each item."""
        out = []
        for at in range(0, len(items), self.retry.batch):
            out += self._batch(items[at : at + self.retry.batch])
        return out

    def _batch(self, items: list) -> list[tuple]:
        tries = 0
        while True:
            tries += 1
            try:
                return [(r, None, tries) for r in self.check(self.call(items), len(items))]
            except Exception as error:  # a model may fail in any way of its own
                if passing(error):
                    if tries < self.retry.attempts:
                        self.sleep(wait_for(error, tries, self.retry))
                        continue
                elif len(items) > 1:
                    half = len(items) // 2
                    return self._batch(items[:half]) + self._batch(items[half:])
                # the kind of error only: a message may quote what was sent, or a key
                return [(None, type(error).__name__, tries)] * len(items)


# --- embeddings (X10) ---------------------------------------------------------------------------------


class Backend:
    """An embedding model: ``open`` gives a function from texts to vectors; ``kind`` is passage or query."""

    name = "backend"
    dimension = 768

    def open(self, kind: str) -> Callable[[list[str]], Sequence[Sequence[float]]]:
        raise NotImplementedError


class Hashing(Backend):
    """Signed hashes of words and pairs of words: a column of its own, which needs no model, no network and no batches."""

    name = "hashing"

    def __init__(self, dimension: int = 768):
        self.dimension = dimension


class Library(Backend):
    """A sentence encoder that a local library loads."""

    name = "sentence-transformers"

    def __init__(self, model: str = "sentence-transformers/all-MiniLM-L6-v2", dimension: int = 384):
        self.model, self.dimension = model, dimension

    def open(self, kind: str):
        model = _optional("sentence_transformers").SentenceTransformer(self.model)
        return lambda texts: model.encode(texts, convert_to_numpy=True, show_progress_bar=False)


class Hosted(Backend):
    """A hosted encoder: ``connect`` makes a client where it is called, ``request`` sends it one batch; ``lead`` goes before a text by its kind."""

    def __init__(self, name: str, dimension: int, connect: Callable[[], object], request: Callable[[object, list[str]], Sequence[Sequence[float]]], lead: dict[str, str] | None = None):
        self.name, self.dimension, self.connect, self.request, self.lead = name, dimension, connect, request, lead or {}

    def open(self, kind: str):
        client, lead = self.connect(), self.lead.get(kind, "")
        return lambda texts: self.request(client, [lead + t for t in texts])


def _optional(module: str):
    try:
        return importlib.import_module(module)
    except ImportError as error:
        raise ModelUnavailable(f"the package {module} is not installed") from error


def _key(variable: str) -> str:
    value = os.environ.get(variable, "").strip()
    if not value:
        raise ModelUnavailable(f"{variable} is not set")
    return value


def backend(name: str, model: str | None = None, dimension: int = 768) -> Backend:
    """One of the four by name; packages and keys are looked for where the model is opened."""
    if name == "hashing":
        return Hashing(dimension)
    if name == "sentence-transformers":
        return Library(*filter(None, [model]), dimension=dimension)
    if name == "openai":

        def ordered(client, texts):
            reply = client.embeddings.create(model=model, input=texts, dimensions=dimension, encoding_format="float")
            return [x.embedding for x in sorted(reply.data, key=lambda x: x.index)]

        return Hosted(name, dimension, lambda: _optional("openai").OpenAI(api_key=_key("OPENAI_API_KEY"), max_retries=0), ordered)
    if name == "gemini":

        def values(client, texts):
            reply = client.models.embed_content(model=model, contents=texts, config={"output_dimensionality": dimension})
            return [x.values for x in reply.embeddings]

        lead = {"query": "Find clauses that answer this question:\n", "passage": "Represent this clause for retrieval:\n"}
        return Hosted(name, dimension, lambda: _optional("google.genai").Client(api_key=_key("GEMINI_API_KEY")), values, lead)
    raise ValueError(f"no such backend: {name}")


def _unit_vectors(dimension: int) -> Callable[[Sequence, int], list]:
    def check(reply: Sequence, n: int) -> list:
        x = np.asarray(reply, np.float64)
        if x.shape != (n, dimension) or not np.isfinite(x).all():
            raise ModelUnavailable("vectors do not fit: number, dimension or a value that is no number")
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return list(np.divide(x, norm, out=np.zeros_like(x), where=norm != 0).astype(np.float32))

    return check


def embedded(df: DataFrame, text: Column, model: Backend, kind: str = "passage", retry: Retry = Retry()) -> DataFrame:
    """``df`` with ``embedding``, a unit vector or null, ``embedding_error``, why it is null, and ``embedding_tries``.

    Null and blank texts are not sent and have the error ``blank``; columns of these names give way.
    """
    if isinstance(model, Hashing):
        some = F.coalesce(F.trim(text) != "", F.lit(False))
        made = F.struct(F.when(some, hash_text(text, model.dimension)).alias("embedding"), F.when(~some, "blank").alias("error"), some.cast("int").alias("tries"))
        return _with(df, made, {"embedding": "embedding", "embedding_error": "error", "embedding_tries": "tries"})
    ship(df.sparkSession)
    check = _unit_vectors(model.dimension)

    @F.pandas_udf("embedding array<float>, error string, tries int")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        calls = None
        for texts in parts:
            calls = calls or Calls(model.open(kind), check, retry)
            send = texts.map(lambda t: isinstance(t, str) and t.strip() != "").astype(bool)
            for i in range(0, len(texts), PIECE):
                yield _sent(texts.iloc[i : i + PIECE], send.iloc[i : i + PIECE], calls, "embedding")

    return _with(df, run.asNondeterministic()(text.cast("string")), {"embedding": "embedding", "embedding_error": "error", "embedding_tries": "tries"})


def _sent(items: pd.Series, send: pd.Series, calls: Calls, name: str) -> pd.DataFrame:
    """What came of the items that are sent; the rest have the error ``blank``."""
    out = {name: [None] * len(items), "error": ["blank"] * len(items), "tries": [0] * len(items)}
    at = np.flatnonzero(send.to_numpy())
    for i, (result, error, tries) in zip(at, calls.results([items.iat[i] for i in at]), strict=True):
        out[name][i], out["error"][i], out["tries"][i] = result, error, tries
    return pd.DataFrame(out, columns=[name, "error", "tries"])


def _with(df: DataFrame, made: Column, names: dict[str, str]) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c not in names]
    whole = df.select(F.struct(*kept).alias("_row"), made.alias("_made"))
    return whole.select("_row.*", *[F.col(f"_made.{inner}").alias(outer) for outer, inner in names.items()])


# --- cross-encoders (X11) -----------------------------------------------------------------------------


class Scorer:
    """A cross-encoder: ``open`` gives a function from (question, passage) pairs to logits."""

    name = "scorer"

    def open(self) -> Callable[[list[tuple[str, str]]], Sequence[float]]:
        raise NotImplementedError


class CrossEncoder(Scorer):
    """A cross-encoder that a local library loads."""

    def __init__(self, model: str = "cross-encoder/ms-marco-MiniLM-L-6-v2"):
        self.name = self.model = model

    def open(self):
        model = _optional("sentence_transformers").CrossEncoder(self.model)
        return lambda pairs: model.predict(pairs, show_progress_bar=False)


def _finite(reply: Sequence, n: int) -> list:
    scores = [float(x) for x in reply]
    if len(scores) != n or not all(map(math.isfinite, scores)):
        raise ModelUnavailable("scores do not fit: their number, or a score that is no number")
    return scores


def scored(pairs: DataFrame, question: Column, passage: Column, scorer: Scorer, required: bool = False, retry: Retry = Retry()) -> DataFrame:
    """X11: ``pairs`` with ``logit`` and ``logit_error``; a null question or passage is an empty one.

    A scorer that cannot be opened stops the job where it is ``required``, and is the error of every row where it is not.
    """

    ship(pairs.sparkSession)

    @F.pandas_udf("logit double, error string, tries int")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        calls, broken = None, None
        for questions, passages in parts:
            if calls is None and broken is None:
                try:
                    calls = Calls(scorer.open(), _finite, retry)
                except Exception as error:
                    if required:
                        raise
                    broken = type(error).__name__
            items = pd.Series(list(zip(questions.fillna(""), passages.fillna(""), strict=True)), dtype=object)
            if calls is None:
                yield pd.DataFrame({"logit": np.full(len(items), np.nan), "error": broken, "tries": 0}).astype({"logit": object}).where(lambda x: x.notna(), None)
            else:
                yield _sent(items, pd.Series(np.ones(len(items), bool)), calls, "logit")

    return _with(pairs, run.asNondeterministic()(question.cast("string"), passage.cast("string")), {"logit": "logit", "logit_error": "error"})


def usable_logits(scores: DataFrame, required: bool = False) -> DataFrame:
    """(qid, chunk_id, logit) of the questions all of whose pairs were scored; others keep the order they had.

    Where the scorer is ``required`` an unscored pair stops the job instead, as an answer without it would not be the one asked for.
    """
    if required:
        fault = F.concat(F.lit("a required scorer failed: "), "logit_error")
        return scores.select("qid", "chunk_id", F.when(F.col("logit").isNull(), F.raise_error(fault).cast("double")).otherwise(F.col("logit")).alias("logit"))
    whole = scores.groupBy("qid").agg(F.count_if(F.col("logit").isNull()).alias("lost")).where("lost = 0").select("qid")
    return scores.join(whole, "qid").select("qid", "chunk_id", "logit")
