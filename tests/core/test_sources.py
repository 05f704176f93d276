"""Source selection as a fold over arrays, against a loop over one question's rows."""

import random

from pyspark.sql import functions as F
from rulelens.operators import answers


def _overlap(wanted: set, subject: set, held: set) -> float:
    """The share of an aspect's terms that a chunk has, those that are no question words counting 0.7."""
    whole = len(wanted & held) / max(1, len(wanted))
    return 0.70 * len(subject & held) / len(subject) + 0.30 * whole if subject else whole


def plain(rows: list[dict], aspects: list[dict], lookups: set, exception: bool) -> list[int]:
    """The rows, in retrieval order, that an answer cites."""
    asked = [i for i, r in enumerate(rows) if r["clause_id"] in lookups]
    if asked:
        return sorted(asked, key=lambda i: rows[i]["source_order"])
    picks: dict[int, None] = {}
    best = lambda key: max(range(len(rows)), key=key)
    for aspect in aspects:
        sections = {rows[i]["section_id"] for i in picks}
        fit = [_overlap(aspect["wide"], aspect["subject"], r["doc_terms"]) for r in rows]
        gain = [f + answers.SAME_SECTION * (r["section_id"] in sections) + answers.UNSEEN * (i not in picks) + answers.NUMERIC_FIT * (aspect["numeric"] and r["numeric"]) for i, (f, r) in enumerate(zip(fit, rows, strict=True))]
        i = best(lambda i: (gain[i], rows[i]["score"], rows[i]["ranking_score"]))
        if fit[i] > 0:
            picks[i] = None
    if not aspects:
        picks[best(lambda i: (rows[i]["score"], rows[i]["ranking_score"]))] = None
    strong = [i for i, r in enumerate(rows) if r["score"] >= answers.CARRIED]
    if exception:
        sections = {rows[i]["section_id"] for i in picks}
        picks |= dict.fromkeys(i for i in strong if rows[i]["section_id"] in sections)
    named = {ref for i in picks for ref in rows[i]["cross_references"]}
    picks |= dict.fromkeys(i for i in strong if rows[i]["clause_id"] in named or rows[i]["section_id"] in named)
    return list(picks or {best(lambda i: rows[i]["score"]): None})[:answers.LIMIT]


ROW = "struct<clause_id:string,section_id:string,cross_references:array<string>,source_order:int,score:double,ranking_score:double,doc_terms:array<string>,numeric:boolean>"
ASPECT = "struct<wide:array<string>,subject:array<string>,numeric:boolean>"


def native(spark, cases):
    """The numbers of the rows chosen in each (rows, aspects, lookups, exception)."""
    names = [f.split(":")[0] for f in ROW[7:-1].replace("array<string>", "array").split(",")]
    listed = lambda v: sorted(v) if isinstance(v, set) else v
    data = [
        (k, [tuple(listed(r[n]) for n in names) for r in rows], [(sorted(a["wide"]), sorted(a["subject"]), a["numeric"]) for a in aspects], sorted(lookups), exception)
        for k, (rows, aspects, lookups, exception) in enumerate(cases)
    ]
    df = spark.createDataFrame(data, f"k int, rows array<{ROW}>, aspects array<{ASPECT}>, lookups array<string>, exception boolean")
    out = df.select("k", answers.chosen_rows(F.col("rows"), F.col("aspects"), F.col("lookups"), F.col("exception")).alias("x"))
    return [list(r.x) for r in out.orderBy("k").collect()]


def case(rng):
    words = ["rent", "water", "plot", "list", "days", "many"]
    some = lambda most: set(rng.sample(words, rng.randrange(most + 1)))
    rows = [
        {"clause_id": f"{s}.{i}", "section_id": s, "cross_references": set(rng.sample(["1.1", "2.1", "1.1.0", "2.1.3"], rng.randrange(3))), "source_order": rng.randrange(20), "score": rng.choice([0.5, 0.58, 0.7, 0.7, 0.9]),
         "ranking_score": rng.choice([0.1, 0.4, 0.4]), "doc_terms": some(4), "numeric": rng.random() < 0.4}
        for i in range(rng.randrange(1, 13)) for s in [rng.choice(["1.1", "2.1", "3.1"])]
    ]
    aspects = []
    for _ in range(rng.choice([0, 0, 1, 2, 4])):
        wide = some(5)
        aspects.append({"wide": wide, "subject": wide - {"many", "days"}, "numeric": rng.random() < 0.4})
    lookups = {rng.choice(rows)["clause_id"]} if rng.random() < 0.1 else set()
    return rows, aspects, lookups, rng.random() < 0.3


def test_equals_a_loop_on_random_cases(spark):
    rng = random.Random(21)
    cases = [case(rng) for _ in range(1500)]
    got = native(spark, cases)
    for c, g in zip(cases, got, strict=True):
        want = plain(*c)
        # equal source orders of looked-up rows go by place in both
        assert g == want, c
    assert max(map(len, got)) == answers.LIMIT and len({tuple(g) for g in got}) > 200


def test_no_python_and_no_rows(spark):
    direct = spark.createDataFrame([(1, "c1", "1.1.1", "1.1", ["2.1"], 1, 1, 0.9, 0.5, ["rent"], True), (1, "c2", "2.1.1", "2.1", None, 2, 2, 0.8, 0.4, None, False)],
                                   "qid int, chunk_id string, clause_id string, section_id string, cross_references array<string>, source_order int, pos int, score double, ranking_score double, doc_terms array<string>, numeric boolean")
    parts = spark.createDataFrame([(1, "How much rent, and how long?", ["How much rent", "how long"])], "qid int, question string, aspects array<string>")
    out = answers.sources_by_aspect(direct, parts)
    assert [(r.chunk_id, r.pick) for r in out.orderBy("pick").collect()] == [("c1", 1), ("c2", 2)]
    assert "Pandas" not in out._jdf.queryExecution().executedPlan().toString()
    assert answers.sources_by_aspect(direct.limit(0), parts).count() == 0
    assert answers.sources_by_aspect(direct, parts.limit(0)).count() == 2
