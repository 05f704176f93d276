"""Nearest ranks without buffers, against sorting."""

import math
import random

from rulelens.operators import evaluation


def test_ranks_equal_sorting(spark):
    rng = random.Random(2)
    groups = {"one": [3.5], "ties": [1.0] * 40 + [2.0] * 60, "wide": [rng.uniform(-1, 1) * 10 ** rng.randrange(-300, 300) for _ in range(500)], "huge": [-1.7e308, 1.7e308, 0.0, 5e-324], None: [rng.gauss(0, 1) for _ in range(999)], "inf": [float("inf"), 1.0, float("-inf"), 2.0, float("inf")]}
    rows = [(g, v, "x") for g, vs in groups.items() for v in vs] + [("one", None, "x"), ("one", float("nan"), "x"), ("none", None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double, n string")
    quantiles = [0.0, 0.1, 0.5, 0.95, 1.0]
    got = {(r.g, r.quantile): (r.n, r.value) for r in evaluation.nearest_ranks(df, ["g"], "v", quantiles, parts=6).collect()}
    assert got == {(g, q): (len(vs), sorted(vs)[max(1, math.ceil(q * len(vs))) - 1]) for g, vs in groups.items() for q in quantiles}
    assert evaluation.nearest_ranks(df.limit(0), ["g"], "v", quantiles).count() == 0
