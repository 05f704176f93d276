"""Model backends and rerankers: batches, retries, errors as rows, and their place in retrieval and answers."""

import glob
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F
from rulelens.functions import vectors as V
from rulelens.operators import models, retrieval
from rulelens.plans import ask as plan
from rulelens.sources import companions

from . import fixture_corpus as fx


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    files, index = fx.write(tmp_path_factory.mktemp("corpus")), str(tmp_path_factory.mktemp("index"))
    plan.ingest(spark, files["rules.md"], [files["amendment-1.md"]], index, companions.Settings(dimension=128), ["1.1", "1.2", "5.1"])
    return plan.load_corpus(spark, index, files["findings.json"], files["contacts.json"])


class Busy(Exception):
    def __init__(self, wait=None):
        super().__init__("too many requests")
        self.status_code = 429
        self.response = type("R", (), {"status_code": 429, "headers": {} if wait is None else {"retry-after": wait}})()


class Refused(Exception):
    status_code = 400


def vector(text):
    return [text.count(c) + 0.5 for c in "aeo"]


class Stub(models.Backend):
    """Counts its calls in files; fails in passing on every ``busy``-th call, and for good on a text with REFUSED, DOWN or ODD."""

    name, dimension = "stub", 3

    def __init__(self, folder, busy=0):
        self.folder, self.busy = str(folder), busy

    def open(self, kind):
        calls = {"n": 0}
        note = lambda what, n: open(f"{self.folder}/{what}-{n}-{uuid.uuid4().hex}", "w").close()
        note("open", kind)

        def call(texts):
            calls["n"] += 1
            note("call", len(texts))
            if self.busy and calls["n"] % self.busy == 0:
                raise Busy("-0.5")
            if any("DOWN" in t for t in texts):
                raise Busy("-0.5")
            if any("REFUSED" in t for t in texts):
                raise Refused("it said: " + texts[0])
            return [vector(t)[: 2 if "ODD" in t else 3] for t in texts]

        return call

    def seen(self, what):
        return sorted(os.path.basename(p).split("-")[1] for p in glob.glob(f"{self.folder}/{what}-*"))


def unit(x):
    x = np.array(x, float)
    return x / np.linalg.norm(x)


def test_every_row_has_a_vector_or_an_error(spark, tmp_path):
    texts = [f"row {i} aeo" * (i % 3 + 1) for i in range(300)]
    texts[7], texts[130], texts[131], texts[200] = "REFUSED one", None, "  ", "REFUSED two"
    df = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in enumerate(texts)], "id int, text string, embedding string, x double").coalesce(1)
    stub = Stub(tmp_path, busy=4)
    got = {r.id: r for r in models.embedded(df, F.col("text"), stub).collect()}
    assert len(got) == 300 and all(r.x == 1.0 for r in got.values())
    for i, t in enumerate(texts):
        want = "blank" if not (t or "").strip() else "Refused" if "REFUSED" in t else None
        assert got[i].embedding_error == want and (got[i].embedding is None) == (want is not None)
        if want is None:
            assert np.allclose(got[i].embedding, unit(vector(t)), atol=1e-6)
    assert max(r.embedding_tries for r in got.values()) >= 2
    assert stub.seen("open") == ["passage"] and max(map(int, stub.seen("call"))) == 64
    # five batches, halved down to the two refused texts, and some calls again
    assert len(stub.seen("call")) < 60


def test_failures_that_last_are_bounded(spark, tmp_path):
    df = spark.createDataFrame([(0, "DOWN"), (1, "ODD shape"), (2, "good")], "id int, text string").coalesce(1)
    one = models.Retry(batch=1)
    stub = Stub(tmp_path)
    got = {r.id: r for r in models.embedded(df, F.col("text"), stub, retry=one).collect()}
    assert (got[0].embedding_error, got[0].embedding_tries) == ("Busy", 5) and len(stub.seen("call")) == 7
    assert got[1].embedding_error == "ModelUnavailable" and got[2].embedding is not None
    assert models.embedded(df.limit(0), F.col("text"), stub).count() == 0


def test_waits():
    r = models.Retry()
    assert models.wait_for(Busy("3"), 1, r) == 3.5 and models.wait_for(Busy("500"), 1, r) == 60
    assert models.wait_for(RuntimeError("please retry in 2.5 s"), 1, r) == 3.0
    assert [models.wait_for(Busy(), n, r) for n in (1, 2, 3, 6)] == [1, 2, 4, 20]
    assert models.passing(Busy()) and models.passing(TimeoutError()) and not models.passing(Refused()) and not models.passing(ValueError())
    slept = []
    replies = iter([Busy("1"), ConnectionError(), [7]])

    def call(_):
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    assert models.Calls(call, lambda r, n: list(r), r, slept.append).results(["a"]) == [(7, None, 3)] and slept == [1.5, 2.0]


def test_backends_by_name(spark, monkeypatch):
    df = spark.createDataFrame([(0, "a few words"), (1, None)], "id int, text string")
    got = {r.id: r for r in models.embedded(df, F.col("text"), models.backend("hashing", dimension=64)).collect()}
    want = df.where("id = 0").select(V.hash_text(F.col("text"), 64).alias("e")).first().e
    assert got[0].embedding == want and got[1].embedding is None and got[1].embedding_error == "blank"
    with pytest.raises(ValueError):
        models.backend("none")
    for name in ("sentence-transformers", "openai", "gemini"):
        with pytest.raises(models.ModelUnavailable):  # no package here
            models.backend(name, "m").open("query")


class Lengths(models.Scorer):
    """The logit is the passage's length; fails for good on a question with REFUSED, or where it is opened."""

    def __init__(self, broken=False):
        self.broken = broken

    def open(self):
        if self.broken:
            raise OSError("no model")

        def score(pairs):
            if any("REFUSED" in q for q, _ in pairs):
                raise Refused()
            return [len(p) / 10 - 2 for _, p in pairs]

        return score


def test_reranking_is_optional_or_required(spark):
    cands = spark.createDataFrame([(q, f"c{i}", 1 - i / 10, i + 1, None) for q in (1, 2) for i in range(10)], "qid int, chunk_id string, fused_score double, vector_rank int, lexical_rank int")
    questions = spark.createDataFrame([(1, "fine"), (2, "REFUSED")], "qid int, question string")
    chunks = spark.createDataFrame([(f"c{i}", "x" * (3 * i), "T" if i else None) for i in range(10)], "chunk_id string, text string, section_title string")
    pairs = retrieval.pairs_to_score(cands, questions, chunks)
    assert pairs.count() == 16  # the first eight of each
    scores = models.scored(pairs, F.col("question"), F.col("passage"), Lengths())
    logits = models.usable_logits(scores)
    assert {(r.qid, r.chunk_id): r.logit for r in logits.collect()} == {(1, f"c{i}"): pytest.approx((3 * i + (3 if i else 6)) / 10 - 2) for i in range(8)}
    got = retrieval.rerank(cands.join(logits, ["qid", "chunk_id"], "left"), F.col("logit"))
    got = {(r.qid, r.chunk_id): r.reranker_score for r in got.collect()}
    want = 0.65 / (1 + np.exp(-((3 * 5 + 3) / 10 - 2))) + 0.35 * 0.5
    assert got[1, "c5"] == pytest.approx(want) and got[1, "c8"] is None and got[2, "c0"] is None
    with pytest.raises(Exception, match="a required scorer failed: Refused"):
        models.usable_logits(scores, required=True).collect()
    assert models.usable_logits(models.scored(pairs, F.col("question"), F.col("passage"), Lengths(True))).count() == 0
    with pytest.raises(Exception, match="no model"):
        models.scored(pairs, F.col("question"), F.col("passage"), Lengths(True), required=True).collect()


def test_questions_that_no_model_reads_are_refused(spark, corpus, tmp_path):
    stub = Stub(tmp_path)
    chunks = plan.embed_index(corpus.chunks, 3, stub)
    with pytest.raises(models.ModelUnavailable, match="1 chunks without a vector"):
        first = corpus.chunks.limit(1).select("chunk_id", F.lit("REFUSED").alias("index_text"))
        plan.embed_index(first, 3, stub)
    own = plan.Corpus(corpus.chunks.drop("embedding").join(chunks, "chunk_id"), corpus.findings, corpus.contacts)
    asked = spark.createDataFrame([("good", "Within how many days must rent be paid?"), ("bad", "REFUSED How many days?")], "qid string, question string")
    got = {r.qid: r for r in plan.ask(asked, own, backend=stub, scorer=Lengths()).collect()}
    assert set(got) == {"good", "bad"}
    assert (got["bad"].decision, got["bad"].error, got["bad"].rule) == ("REFUSE", "Refused", "embedding_unavailable") and not got["bad"].citations
    assert got["good"].error is None and got["good"].decision in ("ANSWER", "CONFLICT", "REFUSE")
