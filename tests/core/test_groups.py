"""Groups and folds against plain loops, and corrections against a comparison of every pair."""

import random

import pytest
from pyspark.sql import functions as F
from rulelens.functions import settling
from rulelens.functions import text as T
from rulelens.operators import evaluation, groups, retrieval

GOLD = "case_id long, clause string"


def by_search(pairs, nodes):
    near = {x: set() for x in nodes}
    for a, b in pairs:
        near[a].add(b), near[b].add(a)
    lead = {}
    for x in sorted(nodes):
        todo = [] if x in lead else [x]
        while todo:
            y = todo.pop()
            if lead.setdefault(y, x) == x:
                todo += [z for z in near[y] if z not in lead]
    return lead


def test_groups_equal_a_search(spark):
    rnd = random.Random(7)
    nodes = list(range(300))
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)] + [(0, k) for k in range(200, 230)] + [(5, 5)]
    n = spark.createDataFrame([(x,) for x in [*nodes, None, 3]], "node long")
    e = spark.createDataFrame([*pairs, (None, 4), (9, None)], "a long, b long")
    assert {r.node: r.lead for r in groups.components(n, e).collect()} == by_search(pairs, nodes)
    assert groups.components(n.limit(0), e.limit(0)).count() == 0


def test_rounds_grow_with_the_logarithm_of_a_chain(spark, monkeypatch):
    size, settled, real = 10_000, [], groups.settled_table
    names = list(range(size))
    random.Random(1).shuffle(names)
    e = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    monkeypatch.setattr(groups, "settled_table", lambda df: settled.append(1) or real(df))
    got = groups.components(spark.range(size).withColumnRenamed("id", "node"), e)
    assert got.where("lead <> 0").isEmpty() and got.count() == size
    assert len(settled) - 2 <= 20


@pytest.mark.parametrize("n", [2, 5])
def test_folds_are_evenly_full(spark, n):
    rnd = random.Random(n)
    sizes = [(lead, rnd.choice([1, 1, 1, 2, 3, 7, 40])) for lead in range(500)]
    got = groups.packed(spark.createDataFrame(sizes, "lead long, size long"), n, 3).collect()
    loads = [sum(r["size"] for r in got if r.fold == f) for f in range(n)]
    assert len(got) == 500 and max(loads) - min(loads) <= 40
    assert groups.packed(spark.createDataFrame([], "lead long, size long"), n, 3).count() == 0


def test_cases_without_clauses_have_folds(spark):
    cases = spark.createDataFrame([("a", ["x", None]), ("b", ["x"]), ("c", []), ("d", None)], "case_id string, expected_evidence_clause_ids array<string>")
    got = {r.case_id: r.fold for r in evaluation.disjoint_folds(cases, n=2).collect()}
    assert got.keys() == {"a", "b", "c", "d"} and got["a"] == got["b"]


def test_corrections_equal_a_comparison_of_all_pairs(spark):
    rnd = random.Random(3)
    base = ["".join(rnd.choice("abc") for _ in range(rnd.randint(4, 9))) for _ in range(60)] + ["x" + "".join(rnd.choice("ab") for _ in range(n)) for n in (37, 38, 39, 40, 41, 42, 90)]

    def bent(w):
        i = rnd.randrange(1, len(w) - 1)
        return rnd.choice([w[:i] + w[i + 1 :], w[:i] + "c" + w[i:], w[:i] + "d" + w[i + 1 :], w[: i - 1] + w[i] + w[i - 1] + w[i + 1 :]])

    terms = sorted({bent(w) for w in base for _ in range(6)} | {"é" * 6, "12345", ""})
    words = spark.createDataFrame([(w,) for w in base], "tok string").distinct()
    asked = spark.createDataFrame([(k % 9, t) for k, t in enumerate(terms)] + [(0, None)], "qid int, tok string")
    roots = asked.withColumn("root", T.stem(F.col("tok"))).where("length(root) >= 5 and root not rlike '^[0-9]+$'").join(words.withColumnRenamed("tok", "root"), "root", "left_anti")
    all_pairs = roots.crossJoin(words.withColumnRenamed("tok", "word")).where(T.one_edit_apart(F.col("root"), F.col("word")) & (F.substring("root", 1, 1) == F.substring("word", 1, 1)))
    want = all_pairs.groupBy("qid", "tok").agg(F.count_distinct("word").alias("n"), F.min("word").alias("correction")).where("n = 1").drop("n")
    got = retrieval.corrections(asked, words)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 60
    assert any(len(r.tok) > 38 for r in got.collect())


def test_parts_of_groups_follow_their_rows(spark, monkeypatch):
    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    usual, seen, real = [spark.conf.get(k) for k in keys], [], groups.settled_table
    monkeypatch.setattr(settling, "ROWS_A_PART", 100)
    monkeypatch.setattr(groups, "settled_table", lambda df: seen.append([spark.conf.get(k) for k in keys]) or real(df))
    cases = spark.range(3000).selectExpr("id as case_id", "cast(id div 3 as string) as clause")
    leads = evaluation.case_groups(cases)
    assert seen and all(x == ["30", "4m"] for x in seen)
    got = groups.in_folds(leads, 5, 1)
    assert got.count() == 3000 and got.where("size <> 3 or lead <> case_id - case_id % 3").isEmpty()
    assert {x[1] for x in seen} == {"4m"} and [spark.conf.get(k) for k in keys] == usual


def test_many_groups_of_one_size_are_not_dealt_by_size(spark):
    sizes = spark.range(500).selectExpr("id as lead", "1 + id % 2 as size")
    plan = groups.packed(sizes, 5, 1)._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "Join [" in line and "bucket" not in line]
    assert joins and all("BroadcastHashJoin" in line for line in joins)
