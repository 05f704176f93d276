"""Registered queries of the catalogue over small tables, and against their SQL."""

import duckdb
from rulelens.functions import text as T
from rulelens.functions import vectors as V
from rulelens.operators import evaluation, retrieval
from rulelens.plans import catalog
from rulelens.sources import companions


def written(spark, folder, texts):
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def rows_of(spark, folder, name):
    """A query's rows and its SQL's, each sorted."""
    df = catalog.QUERIES[name](spark, folder)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return sorted(tuple(r) for r in df.collect()), sorted(con.execute(catalog.ORACLE[name]).fetchall())


def test_actions_of_all_documents(spark, tmp_path):
    texts = ["x " * 500 + "Members MUST pay and may not be refused. They must not delay; they must pay.", "shall be\nheard, may  not leave", "nothing", ""]
    got, want = rows_of(spark, written(spark, tmp_path, texts), "document_actions")
    assert got == want
    assert [r for r in got if r[0] >= 0] == [
        (0, "negative", "delay"), (0, "negative", "refused"), (0, "positive", "pay"), (1, "positive", "heard"),
    ]
    assert {r[0] for r in got if r[0] < 0} == {-1, -2, -3}


def test_slugs_of_whole_texts(spark, tmp_path):
    start = "One opening, of sixty characters or more, that many documents have"
    texts = [f"{start}: the first", f"{start}: the second!", "--", "", "Ünder  Ä_1"]
    got, want = rows_of(spark, written(spark, tmp_path, texts), "document_slug")
    assert got == want
    slug = "one-opening-of-sixty-characters-or-more-that-many-documents-have"
    assert got == [(0, f"{slug}-the-first"), (1, f"{slug}-the-second"), (2, ""), (3, ""), (4, "nder-1")]


def test_decisions_keep_leading_instructions_as_their_sql(spark, tmp_path):
    texts = [
        "The thin ndonsh, of. Is the was that of.", "Read this. Is it allowed?", "Note. Show clause 4.3.2", "Show clause 4.3.2", "what does clause 4.3.2 say?", "is\vit so", "Is itä here", "they mustä pay", "ümust pay",
        "please  READ provision §1.2.3 ?!\n", "a\nHow. what limit", "the \u017fhall", "This i\u017f not", "", None,
    ]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{tmp_path}/benchmark.parquet/*.parquet')")
    want = sorted(con.execute(catalog.ORACLE["decision_cascade"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["decision_cascade"](spark, str(tmp_path)).collect())) == want and (0, "open") in want


def test_postings_are_dealt_by_bytes_of_text(spark, monkeypatch):
    texts = spark.createDataFrame([(k, f"word{k % 3} " * 200) for k in range(40)], "chunk_id long, text string")
    usual = sorted(map(tuple, retrieval.postings(texts, texts.text).collect()))
    monkeypatch.setattr(retrieval, "TEXT_A_PART", 2_000)
    small = retrieval.postings(texts, texts.text)
    assert small.rdd.getNumPartitions() == 24 and sorted(map(tuple, small.collect())) == usual
    assert retrieval.postings(texts.limit(0), texts.text).count() == 0


def test_cases_are_folded_by_one_worker_a_task(spark):
    kinds = "id string, expected_decision string, expected_clause_ids array<string>, expected_evidence_clause_ids array<string>, expected_facts array<string>, forbidden_claims array<string>"
    cases = spark.createDataFrame([(str(k), "ANSWER", ["1.1"], ["1.1"], ["ＲＥＮＴ", None] if k == 1 else ["RENT  due"], ["Straße"]) for k in range(4)], kinds)
    found = "id string, decision string, answer string, next_step string, trace_decision string, retrieved array<string>, cited array<string>, excerpts array<string>, elapsed_ms double"
    row = lambda k, answer, excerpts: (k, "ANSWER", answer, "", "ANSWER", ["1.1"], ["1.1"], excerpts, 1.0)
    results = spark.createDataFrame([row("0", "The rent   due", ["THE RENT"]), row("1", "rent STRASSE", []), row("2", None, None)], found)
    scored = evaluation.score_cases(cases, results)
    got = {r.id: (r.missing_facts, r.forbidden_found, r.checks.grounding) for r in scored.collect()}
    assert got["0"] == ([], [], True) and got["1"] == ([], ["Straße"], True) and got["2"][0] == ["RENT  due"] and got["3"][2] is False
    assert scored._jdf.queryExecution().sparkPlan().toString().count("ArrowEvalPython") == 1


def test_scores_are_dealt_by_pairs_of_questions_and_postings(spark, monkeypatch):
    post = spark.createDataFrame([(k, f"w{j}", 1 + k % 2) for k in range(40) for j in range(3)], "chunk_id long, tok string, tf long")
    dl = spark.createDataFrame([(k, 3 + 3 * (k % 2)) for k in range(40)], "chunk_id long, dl long")
    terms = spark.createDataFrame([(1, "w0"), (1, "w1"), (2, "w1"), (2, "w1"), (2, "none")], "qid long, tok string")
    usual = sorted(map(tuple, retrieval.bm25_scores(terms, post, dl).collect()))
    monkeypatch.setattr(retrieval, "PAIRS_A_PART", 5)
    small = retrieval.bm25_scores(terms, post, dl)
    assert small.rdd.getNumPartitions() == 24 and sorted(map(tuple, small.collect())) == usual and len(usual) == 80
    rows, parts = retrieval.asked_postings(terms, post)
    assert (retrieval.by_question(rows, terms, parts).count(), parts) == (120, 24)
    assert retrieval.bm25_scores(terms, post, dl, asked=(rows, parts)).count() == 80
    monkeypatch.setattr(retrieval, "FEW_TERMS", 0)
    assert sorted(map(tuple, retrieval.bm25_scores(terms, post, dl).collect())) == usual
    assert retrieval.bm25_scores(terms.limit(0), post, dl).count() == 0


def test_hash_embedding_has_the_default_dimension(spark, tmp_path):
    folder = written(spark, tmp_path, ["a few words about the limit", "others"])
    got = {r.doc_id: r.embedding for r in catalog.QUERIES["hash_embedding"](spark, folder).collect()}
    text = spark.createDataFrame([("a few words about the limit",)], "text string")
    want = text.select(V.hash_features(768)(T.feature_words(text.text)).alias("e")).first().e
    assert {len(v) for v in got.values()} == {companions.Settings().dimension} == {768} and got[0] == want


def test_engine_queries_equal_their_sql(spark):
    import os

    import pytest
    from rulelens.plans import engine_queries

    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in engine_queries._TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    for name in ("context_expand", "decisions", "built_answers", "case_scores", "calibration"):
        df = catalog.QUERIES[name](spark, folder)
        columns = sorted(df.columns)
        want = con.execute(catalog.ORACLE[name])
        at = [[d[0] for d in want.description].index(c) for c in columns]
        rows = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
        assert rows and sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == rows, name


def test_vectors_leave_a_worker_in_pieces():
    import pandas as pd

    pieces = list(V._hashing(8, str.split).func(iter([pd.Series(["a b", None] * 600), pd.Series(["c"])])))
    assert [len(p) for p in pieces] == [512, 512, 176, 1] and pieces[0].iloc[1].sum() == 0 and (pieces[0].iloc[0] == pieces[2].iloc[0]).all()
