"""Hard-negative mining against brute force, and its bounds."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rulelens.llm import hard_negative_mining as mining

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=5):
    usable = []
    for i, x, label in dict.fromkeys((i, tuple(x) if x is not None else None, label) for i, x, label in rows):
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        usable.append((i, label, [math.floor(256 * float(v)) for v in x]))
    out = []
    for a in usable:
        if a[0] % 100:
            continue
        score = lambda r, a=a: sum(p * q for p, q in zip(a[2], r[2], strict=True))
        others = [r for r in usable if r is not a and len(r[2]) == len(a[2])]
        ranked = sorted(others, key=lambda r: (-score(r), r[0]))
        for p in [r for r in ranked if r[1] == a[1]][:k]:
            window = [r for r in ranked if r[1] != a[1] and 80 * score(p) <= 100 * score(r) <= 100 * score(p)]
            out += [(a[0], p[0], n + 1, r[0], score(p), score(r)) for n, r in enumerate(window[:5])]
    return sorted(out)


def vectors(n=900, dims=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((10, dims))
    labels = rng.choice(10, n, p=[0.35, 0.15, *[0.0625] * 8])
    x = np.float32(0.25 * (0.9 * centres[rng.permutation(10)[labels]] + rng.standard_normal((n, dims))))
    rows = [(i, [float(v) for v in x[i]], int(labels[i])) for i in range(n)]
    copies = [(n + i, rows[n // 3][1], rows[n // 3][2] if i % 2 else 3) for i in range(60)]  # ties
    return rows + copies


@pytest.mark.parametrize("how", [mining.Approximation(), mining.Approximation(bits=2, rows=100, anchors=3, at_once=2), mining.Approximation(bits=8)])
def test_equals_brute_force(spark, how):
    rows = vectors()
    df = mining.relabelled(spark.createDataFrame(rows, SCHEMA))
    got = sorted(tuple(r) for r in mining.mine(df, F.col("vec_id") % 100 == 0, how=how).collect())
    assert got == brute(rows) and len(got) > 100


def test_odd_rows(spark):
    rows = vectors(300, 4, 5)
    nan, inf = float("nan"), float("inf")
    rows += [(400, None, 1), (500, [1.0] * 4, None), (600, [nan, 1.0, 1.0, 1.0], 1), (700, [inf] * 4, 1), (None, [1.0] * 4, 1), (800, [None, 1.0, 1.0, 1.0], 1)]
    rows += [(900, [0.5] * 3, 2), (901, [0.5] * 3, 2), (902, [0.5, 0.25, 0.5], 4), (1000, [], 1), (1001, [], 1), (1002, [], 1), (1100, [0.0] * 4, 6)]
    rows += [rows[100], rows[100]]  # the same row again counts once
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, dim int")
    got = sorted(tuple(r) for r in mining.mine(mining.relabelled(df), F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows) and {900, 1000} <= {r[0] for r in got}
    assert mining.mine(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1)], SCHEMA)
    assert mining.mine(alone, F.col("vec_id") % 100 == 0).count() == 0


def test_huge_components_are_held(spark):
    rows = [(100, [1e30, 1.0], 1), (1, [1e30, 2.0], 1), (2, [1e29, 0.0], 2), (3, [-1e30, 0.0], 2)]
    got = [tuple(r) for r in mining.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 100 == 0).collect()]
    top = mining.limit(2)
    assert got == [(100, 1, 1, 2, top * top, top * top)] or got[0][3] == 2 and got[0][5] == top * top


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(8)
    x = np.floor(256 * 0.12 * rng.standard_normal((6000, 64))).astype(np.int64)
    q = x[:40] + np.floor(8 * rng.standard_normal((40, 64))).astype(np.int64)
    cells = mining.Cells(x.min(axis=0), x.max(axis=0), 6)
    number = cells.number(x)
    assert (np.take_along_axis(cells.first, number.T.astype(int), 1).T <= x).all() and (x <= np.take_along_axis(cells.last, number.T.astype(int), 1).T).all()
    low, high = (mining.bounds(number, t) for t in cells.tables(q))
    exact = x @ q.T
    assert (low <= exact).all() and (exact <= high).all()
    frame = lambda v, first: pd.DataFrame({"vec_id": np.arange(first, first + len(v)), "label": ["1"] * len(v), "key": [f"{first + i}" for i in range(len(v))], "ints": [r.tobytes() for r in v]})
    row, anchor, score, scored = mining.Block(frame(x, 0), frame(q, 100_000), cells, 16).positives(5)
    assert len(row) == 200 and scored < 0.1 * x.shape[0] * q.shape[0]  # most rows are told from their bounds alone
    for a in range(40):
        assert sorted(score[anchor == a])[::-1] == sorted(exact[:, a])[::-1][:5]
