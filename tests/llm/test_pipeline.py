"""The chained pipeline over a small fixture, against brute-force stages."""

import hashlib
import random
import re
import zlib

import corpus_pipeline
import numpy as np
import pytest
from rulelens.llm import quality, secret_scan
from rulelens.llm.queries import vocabulary
from test_operators import brute_components, brute_contamination, frame


def brute_quality(texts, labels):
    """Texts that the classifier accepts: its own features and updates, in one loop without Spark but for the row order."""
    size = 1 << quality.BITS
    rows = sorted((o, texts[i], y) for i, (o, y) in labels.items())
    features = [f for _, f in quality.feature_runs([t for _, t, _ in rows], quality.BITS)]
    model = quality.Ftrl(size)
    for epoch in range(4):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            model.learn(features[k], rows[k][2])
    w = model.weights(np.arange(size + 1))
    z = [w[f].sum() * quality.value(f) + w[-1] * quality.BIAS for _, f in quality.feature_runs(texts, quality.BITS)]
    return [i for i, x in enumerate(z) if 1 / (1 + np.exp(-x)) >= 0.7]


def brute_redact(text):
    """Base secrets blanked out; the fixture holds no weak parts."""
    spans = [(m.start(), m.end()) for p, g, least in secret_scan.BASE.values() for m in re.finditer(p, text) if len(m[g]) >= least]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_pipeline_equals_brute_stages(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(12)
    good, bad = [f"g{i}" for i in range(300)], [f"b{i}!!" for i in range(80)]
    text = lambda pool, n: " ".join(rng.choice(pool) for _ in range(n))
    texts = [text(good if i % 4 else bad, 60) for i in range(240)]
    item = text(good, 13)
    texts[41], texts[42] = texts[1], texts[2] + " g7"
    texts[5] += " " + item
    texts[6] += " password=abcdefghijklmnop"
    texts[7] = "AKIA" + "Z9" * 9 + " " + texts[7]
    texts[43] = texts[6].replace("abcdefghijklmnop", "qrstuvwxyzabcdef")
    folder = str(tmp_path)
    frame(spark, texts).write.parquet(f"{folder}/documents.parquet")
    marked = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int")
    marked.write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    order = {r.doc_id: r.o for r in marked.selectExpr("doc_id", "xxhash64(doc_id) AS o").collect()}

    kept = brute_quality(texts, {i: (order[i], int(i % 4 > 0)) for i in range(240) if zlib.crc32(str(i).encode()) % 4 != 2})
    assert 100 < len(kept) < 240
    _, comp = brute_components([texts[i] for i in kept], 5, 80, 100)
    single = [kept[k] for k in range(len(kept)) if comp[k] == k]
    clean = [i for i in single if not brute_contamination(texts[i], [(1, item)])[3]]
    assert len(kept) > len(single) > len(clean)
    codec = tokenizers.Tokenizer.from_file(vocabulary())
    want = {}
    for i in clean:
        ids = codec.encode(brute_redact(texts[i]), add_special_tokens=False).ids
        back = codec.decode(ids, skip_special_tokens=False)
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert sum(brute_redact(texts[i]) != texts[i] for i in clean) >= 2

    out = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    rows = out.collect()
    assert len(rows) == len(want)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows} == want
