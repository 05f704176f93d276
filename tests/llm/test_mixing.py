"""Source mixing against a plain version that sorts, and its edge cases."""

import hashlib
import random

from rulelens.llm import mixing

SCHEMA = "doc_id long, text string, source string, size long, h string"


def words(text):
    out = text or ""
    for c in "\t\n\v\f\r":
        out = out.replace(c, " ")
    return len([w for w in out.split(" ") if w])


def brute_targets(sizes, share, repeats):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    budget, full = min(round(sum(sizes.values()) * share), repeats * sum(sizes.values())), set()
    while True:
        left = budget - sum(repeats * sizes[s] for s in full)
        total = sum(weight[s] for s in names if s not in full)
        target = {s: float(repeats * sizes[s]) if s in full else float(left) * weight[s] / float(total) for s in names}
        above = {s for s in names if s not in full and target[s] >= repeats * sizes[s]}
        if not above:
            return target
        full |= above


def brute(rows, share=1.0, repeats=3):
    size = {}
    for _, text, source in rows:
        size[source] = size.get(source, 0) + words(text)
    target = brute_targets(size, share, repeats)
    out = []
    for source in size:
        budget = int(target[source] + 0.5)
        whole, left = divmod(budget, max(size[source], 1))
        groups = {}
        for doc, text, own in rows:
            if own == source:
                mark = hashlib.md5(f"{'' if doc is None else doc}\n{text or ''}".encode()).hexdigest()[:15]
                groups.setdefault(int(mark, 16), []).append((doc, words(text)))
        for _, docs in sorted(groups.items()):
            total = sum(n for _, n in docs)
            for doc, n in docs:
                more = n if total <= left else min(n, left // len(docs)) if left > 0 else 0
                out.append((doc, n, size[source], target[source], n * whole + more))
            left -= total
    return out


def documents(rng, n):
    rows = []
    for i in range(n):
        source = rng.choice(["b", "B", "é", "z", None, "hot", "hot", "hot", "hot"])
        rows.append((i, " ".join("w" for _ in range(rng.choice([0, 1, 5, 40, 300] if source != "z" else [1]))) if rng.random() > 0.05 else None, source))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, -1, "x") for r in rows], SCHEMA)


def of(df, i=0):
    return sorted(((r.doc_id, r["size"], r.source_size, r.targets[i], r.taken[i]) for r in df.collect()), key=repr)


def test_equals_a_version_that_sorts(spark):
    rows = documents(random.Random(3), 900)
    rows += [(None, "a tie of six words here", "b")] * 5 + [(3, "x y", "b"), (3, "x y", "b")]
    df = mixing.mix(frame(spark, rows), shares=(1.0, 0.3, 2.5)).cache()
    for i, share in enumerate((1.0, 0.3, 2.5)):
        assert of(df, i) == sorted(brute(rows, share), key=repr), share
    assert any(t == 3 * s for _, _, s, t, _ in of(df)) and all(t <= 3 * n for _, n, _, _, t in of(df))


def test_thresholds_are_nested_and_targets_met(spark):
    rows = documents(random.Random(9), 400)
    shares = (0.1, 0.25, 0.7, 1.3)
    got = mixing.mix(frame(spark, rows), shares=shares).collect()
    for r in got:
        assert list(r.taken) == sorted(r.taken) and list(r.targets) == sorted(r.targets)
    for i in range(len(shares)):
        for source in {r.source for r in got}:
            own = [r for r in got if r.source == source]
            assert abs(sum(r.taken[i] for r in own) - own[0].targets[i]) <= 0.5
    again = mixing.mix(frame(spark, rows[::-1]).repartition(3), shares=shares).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in got)


def test_a_table_of_one_text_and_tables_without_words(spark):
    same = [(1, "one two three", "s")] * 50 + [(2, "four", "t")]
    got = of(mixing.mix(frame(spark, same), weigh=lambda rank: rank * 9 + 1))
    # t may give three words, s gives the rest; nothing tells its rows apart, so each gives the same
    assert got[-1] == (2, 1, 1, 3.0, 3) and {r[4] for r in got[:-1]} == {148 // 50}
    for rows in ([(1, None, None), (2, " \n", "a")], []):
        assert of(mixing.mix(frame(spark, rows))) == sorted(((d, 0, 0, 0.0, 0) for d, _, _ in rows), key=repr)
    long = [(1, "w " * 1_500_000, "a"), (2, "v", "b"), (3, None, "b")]
    assert of(mixing.mix(frame(spark, long))) == sorted(brute(long), key=repr)
