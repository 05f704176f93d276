"""Links between parts of credentials against a loop over pairs, and time in proportion to a text's length."""

import random
import re
import time

from rulelens.llm import secret_scan as scan

SCHEMA = "doc_id long, text string"


def spans(pattern, text, group=0, least=0):
    return [m.span() for m in re.finditer(pattern, text) if len(m[group]) >= least]


def brute(text, reach):
    """Spans by kind: every pair of parts of a paragraph is looked at."""
    base = {k: spans(p, text, g, n) for k, (p, g, n) in scan.BASE.items()}
    breaks = [m.span() for m in re.finditer(scan.BREAK, text)]
    secret, name = base["assign"] + base["hex"], base["access"]
    weak = {"linked_name": spans(scan.NAME, text), "linked_secret": spans(scan.WEAK, text), "linked_endpoint": spans(scan.ENDPOINT, text)}
    solid = base["assign"] + base["hex"] + base["access"]
    apart = lambda a, b: any(min(a[1], b[1]) <= x and y <= max(a[0], b[0]) for x, y in breaks)
    near = lambda a, group: any(b is not a and max(a[0], b[0]) - min(a[1], b[1]) <= reach and not apart(a, b) for b in group)
    names, secrets = weak["linked_name"] + name, weak["linked_secret"] + secret
    free = lambda a: all(a[1] <= b[0] or b[1] <= a[0] for b in solid)
    out = dict(base)
    out["linked_name"] = [a for a in weak["linked_name"] if free(a) and near(a, secrets)]
    out["linked_secret"] = [a for a in weak["linked_secret"] if free(a) and near(a, names)]
    out["linked_endpoint"] = [a for a in weak["linked_endpoint"] if free(a) and near(a, names) and near(a, secrets)]
    rows = sorted((s, scan.ORDER.index(k), e) for k, found in out.items() for s, e in found)
    return ",".join(f"{scan.ORDER[k]}:{s}:{e}" for s, k, e in rows)


def planted(seed, n):
    rng = random.Random(seed)
    bits = [lambda: f"user: bob{rng.randrange(99)}", lambda: f"password={rng.choice(['hunter2', 'letmein9', 'x' * 14])}", lambda: f"https://h{rng.randrange(9)}.example/p", lambda: "AKIA" + "Z9" * 8, lambda: "0123456789abcdef", lambda: "words " * rng.randrange(1, 30), lambda: "\n\n", lambda: ".\n"]
    return [" ; ".join(rng.choice(bits)() for _ in range(rng.randrange(1, 14))) for _ in range(n)]


def test_links_equal_a_loop_over_pairs(spark):
    texts = planted(5, 500)
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    for reach in (400, 60):
        got = {r.doc_id: r.spans for r in scan.report(df, reach).collect()}
        assert got == {i: brute(t, reach) for i, t in enumerate(texts)}
        kinds = " ".join(got.values())
        assert all(kinds.count(k) > 40 for k in ("linked_name", "linked_secret", "linked_endpoint"))


def dense(n):
    lines = "".join(f"user: bob{i} password=hunter{i} https://h{i}.example/x\n" for i in range(n // 48))
    return lines[:n]


def test_dense_texts_take_time_in_proportion(spark):
    def seconds(f, n):
        df = spark.createDataFrame([(1, dense(n))], SCHEMA).cache()
        df.count()
        took = []
        for _ in range(2):
            began = time.monotonic()
            f(df).write.format("noop").mode("overwrite").save()
            took.append(time.monotonic() - began)
        return min(took)

    for f in (scan.report, scan.redact):
        seconds(f, 50_000)  # warm
        short, long = seconds(f, 250_000), seconds(f, 1_000_000)
        assert long < 9 * short + 3, (f.__name__, short, long)  # four times the text; the square would be sixteen
