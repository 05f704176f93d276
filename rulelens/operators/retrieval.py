"""Hybrid retrieval over tables of questions and chunks.

Questions are ``(qid, question)`` and chunks ``(chunk_id, text, source_order, …)``. All of a workload's questions go through
one plan: postings are joined to question terms by term, so a document that shares no term is never met, and top-k windows
are cut by rank before and after their shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intents import LIST_QUESTION, NUMERIC_PASSAGE, NUMERIC_QUESTION
from ..functions.lexicon import DEFAULT, Lexicon
from ..functions.settling import settled_table, written_table
from ..functions.text import one_edit_apart, policy_ids, raw_tokens, stem, stem_column, term_set, tokenize
from ..functions.vectors import bm25, clamp, squash
from .models import Scorer, scored, usable_logits


@dataclass(frozen=True)
class RetrievalConfig:
    dense_k: int = 18
    lexical_k: int = 18
    final_k: int = 6
    rerank_k: int = 8
    rrf: int = 60
    #: (lexical, dense, reciprocal rank) weights of hashed and of learnt embeddings.
    hashing_weights: tuple[float, float, float] = (0.84, 0.10, 0.06)
    learnt_weights: tuple[float, float, float] = (0.56, 0.34, 0.10)
    hashing: bool = True


#: Up to so many candidates are broadcast to the texts that they are of; each is a row of two keys, six numbers and a question.
FEW = 20_000


#: Up to so many (question, term) pairs are broadcast to the postings; a distinct term's frequency comes along.
FEW_TERMS = 200_000


#: So many bytes of text are cut into tokens by one task.
TEXT_A_PART = 12 << 20


#: So many postings, counted once for each question that asks for their term, are scored by one task.
PAIRS_A_PART = 1_000_000


#: Words of more letters are compared by thirds, as their left-out strings would be as many as their letters.
LONG_WORD = 40


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer parts, as dear work on each row would leave the others idle.

    A table of many parts, which is any large one, stays as it is and is not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def dealt_texts(texts: DataFrame, key: str) -> DataFrame:
    """texts(key, text) dealt by ``key`` into as many parts as their bytes ask for.

    A task then holds the tokens of about ``TEXT_A_PART`` bytes of text however large the table is; left to itself Spark sizes parts by
    their compressed bytes, of which tokens in memory are some fifty times.
    """
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return texts.repartition(max(texts.sparkSession.sparkContext.defaultParallelism, -(-size // TEXT_A_PART)), key)


def postings(chunks: DataFrame, text: Column, key: str = "chunk_id", lexicon: Lexicon = DEFAULT) -> DataFrame:
    """G1: (chunk, token, tf).

    Texts are dealt once, by chunk, and every later count is by chunk and something more, so it finds its rows where they are:
    tokens are never shuffled. They are exploded as they stand and counted; stop words and stems are then plain columns over
    distinct tokens of a chunk, inside generated code, instead of functions over arrays.
    """
    raw = dealt_texts(chunks.select(key, text.alias("text")), key).select(key, F.explode(raw_tokens(F.col("text"))).alias("raw")).groupBy(key, "raw").agg(F.count(F.lit(1)).alias("n"))
    stemmed = raw.select(key, "raw", "n", stem_column(F.col("raw")).alias("tok"))
    if lexicon.stop_words:
        stop = sorted(lexicon.stop_words)
        stemmed = stemmed.where(~F.col("raw").isin(stop) & ~F.col("tok").isin(stop))
    return stemmed.groupBy(key, "tok").agg(F.sum("n").alias("tf"))


def lengths(chunks: DataFrame, text: Column, key: str = "chunk_id", lexicon: Lexicon = DEFAULT, post: DataFrame | None = None) -> DataFrame:
    """(chunk, dl) of every chunk, empty ones included; from ``post`` where it is at hand, so that texts are cut into tokens once."""
    if post is None:
        return chunks.select(key, F.size(tokenize(text, lexicon=lexicon)).cast("long").alias("dl"))
    held = post.groupBy(key).agg(F.sum("tf").cast("long").alias("dl"))
    return chunks.select(key).join(held, key, "left").select(key, F.coalesce("dl", F.lit(0)).cast("long").alias("dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    """(tok, df); postings hold a token once for each chunk."""
    return post.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))


def collection_stats(dl: DataFrame) -> DataFrame:
    """One row of (n, avgdl), empty chunks counting."""
    return dl.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))


def broadcast_if_few(terms: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A hint for tables of terms' size: to be broadcast where there are few."""
    return F.broadcast if terms.limit(FEW_TERMS + 1).count() <= FEW_TERMS else (lambda df: df)


def asked_postings(terms: DataFrame, post: DataFrame, key: str = "chunk_id") -> tuple[DataFrame, int]:
    """((chunk, tok, tf, df) of the terms(qid, tok), how many parts they are dealt into by chunk).

    Parts follow the pairs of a question and a posting, which are known from the frequencies, as each may become a sum of its own in
    memory. Left to itself Spark makes as many parts of any table, or parts of as many compressed bytes, which postings multiply.
    """
    terms = terms.distinct()
    small = broadcast_if_few(terms)
    frequency = settled_table(document_frequency(post.join(small(terms.select("tok").distinct()), "tok", "left_semi")))
    pairs = terms.join(frequency, "tok").agg(F.sum("df")).first()[0] or 0
    parts = max(post.sparkSession.sparkContext.defaultParallelism, -(-pairs // PAIRS_A_PART))
    return post.join(small(frequency), "tok").select(key, "tok", "tf", "df").repartition(parts, key), parts


def by_question(rows: DataFrame, terms: DataFrame, parts: int, key: str = "chunk_id") -> DataFrame:
    """``rows`` of ``asked_postings`` once for each question of terms(qid, tok), dealt by chunk still."""
    terms = terms.distinct()
    small = broadcast_if_few(terms)
    met = rows.join(small(terms), "tok")
    return met if small is F.broadcast else met.repartition(parts, key)


def bm25_scores(terms: DataFrame, post: DataFrame, dl: DataFrame, key: str = "chunk_id", places: int = 9, asked: tuple[DataFrame, int] | None = None) -> DataFrame:
    """(qid, chunk, score) for distinct query terms(qid, tok); rounding makes sums in any order one value.

    Only postings of query terms go on (``asked``, where they are at hand). Where the terms are few they and their frequencies are
    broadcast, so postings are dealt once, by document, to meet lengths, and are summed where they are. The statistics are one row,
    broadcast as such.
    """
    needed, parts = asked_postings(terms, post, key) if asked is None else asked
    # lengths are dealt alike: a join would otherwise deal the postings again as the lengths happen to lie
    weighed = needed.join(dl.repartition(parts, key), key).join(F.broadcast(collection_stats(dl)))
    part = weighed.select(key, "tok", bm25(F.col("tf"), F.col("df"), F.col("dl"), F.col("n"), F.col("avgdl")).alias("part"))
    return by_question(part, terms, parts, key).groupBy("qid", key).agg(F.round(F.sum("part"), places).alias("score")).where("score > 0")


def top_k(scores: DataFrame, k: int, score: str = "score", tie: str = "source_order", rank: str = "rank") -> DataFrame:
    """The best k of each question, ranked; ties go by ``tie``."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col(tie))
    return scores.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def lexical_candidates(questions: DataFrame, chunks: DataFrame, text: Column, k: int, lexicon: Lexicon = DEFAULT, vocabulary_fix: bool = True) -> DataFrame:
    """(qid, chunk_id, lexical_score, lexical_rank), scores over each question's best; R3: no terms, no rows.

    The postings are written once: lengths, vocabulary, frequencies and scores read them, and none cuts the texts anew.
    """
    post = written_table(postings(chunks, text, lexicon=lexicon))
    dl = lengths(chunks, text, lexicon=lexicon, post=post)
    terms = questions.select("qid", F.explode(term_set(F.col("question"), True, lexicon)).alias("tok"))
    if vocabulary_fix:
        fixed = corrections(terms.select("qid", "tok"), written_table(post.select("tok").distinct()))
        # scoring reads the terms several times; settled, they do not meet the vocabulary anew each time
        terms = settled_table(terms.unionByName(fixed.select("qid", F.col("correction").alias("tok"))))
    scored = bm25_scores(terms, post, dl).join(chunks.select("chunk_id", "source_order"), "chunk_id")
    best = top_k(scored, k, rank="lexical_rank")
    top = F.max("score").over(Window.partitionBy("qid"))
    return best.select("qid", "chunk_id", (F.col("score") / top).alias("lexical_score"), "lexical_rank")


def edit_keys(word: Column, reach: tuple[int, ...] = (0,)) -> Column:
    """Hashes under which two words meet that have the same first letter and are an edit or a swap of neighbours apart.

    Up to ``LONG_WORD`` letters these are the word and each string with one letter left out, but for the first: words an
    insertion apart meet under the shorter one, words a letter or a swap apart under what is left without it. Longer words
    would make as many strings as they have letters, so they meet under their first or last third, one of which an edit
    leaves alone; a third depends on the length, and ``reach`` gives the lengths to be met.
    """
    n = F.length(word)
    left_out = F.transform(F.sequence(F.lit(2), F.greatest(n, F.lit(2))), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, n)))
    short = F.transform(F.array_distinct(F.concat(F.array(word), left_out)), lambda s: F.xxhash64(s))
    third = lambda d: F.floor((n + d) / 3).cast("int")
    thirds = [F.xxhash64(F.lit(side), n + d, piece) for d in reach for side, piece in (("first", F.substring(word, F.lit(1), third(d))), ("last", F.substring(word, n - third(d) + 1, third(d))))]
    # a word one letter longer than a short one is long: at that seam words carry the keys of both kinds
    return F.when(n < LONG_WORD, short).when(n <= LONG_WORD + 1, F.concat(short, F.array(*thirds))).otherwise(F.array(*thirds))


def corrections(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(qid, tok, correction) of unknown terms that one word alone of the vocabulary is an edit away from.

    Distinct roots meet words under strings with one letter left out (``edit_keys``), so only near words share a key however
    large the vocabulary; a pair that shares several is compared once. Few keys are broadcast, and words stay where they are.
    """
    unknown = (
        terms.withColumn("root", stem(F.col("tok")))
        .where((F.length("root") >= 5) & ~F.replace(F.col("root"), F.lit("."), F.lit("")).rlike("^[0-9]+$"))
        .join(vocabulary.select(F.col("tok").alias("root")), "root", "left_anti")
    )
    unknown = settled_table(unknown.select("qid", "tok", "root").distinct())
    keys = unknown.select("root").distinct().select("root", F.explode(edit_keys(F.col("root"), (-1, 0, 1))).alias("key"))
    few = keys.limit(FEW_TERMS + 1).count() <= FEW_TERMS
    words_ = vocabulary.select(F.col("tok").alias("word")).where("length(word) >= 4").select("word", F.explode(edit_keys(F.col("word"))).alias("key"))
    met = words_.join(F.broadcast(keys) if few else keys, "key").where(F.substring("root", 1, 1) == F.substring("word", 1, 1)).select("root", "word").distinct()
    near = met.where(one_edit_apart(F.col("root"), F.col("word"))).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("word").alias("correction")).where("n = 1")
    return unknown.join(near, "root").select("qid", "tok", "correction")


def dense_candidates(questions: DataFrame, chunks: DataFrame, k: int, places: int = 9, cell_rows: int = 8192, block_rows: int = 1024) -> DataFrame:
    """(qid, chunk_id, vector_score, vector_rank), exact inner products of unit vectors.

    The questions are a stated set that meets every chunk, so both sides are dealt over a grid: questions by hash into
    blocks of about ``block_rows`` and copied to every cell, chunks by hash into cells of about ``cell_rows`` and copied to every
    block (of which a usual question set has one). The number of cells follows that of the chunks. A task multiplies one block
    with one cell as matrices and lets only the best k of each question leave; neither side is broadcast or gathered.
    """
    blocks, cells = max(1, -(-questions.count() // block_rows)), max(1, -(-chunks.count() // cell_rows))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = questions.select(cell("qid", blocks).alias("block"), "qid", F.col("embedding").cast("array<double>").alias("qv")).withColumn("cell", all_of(cells))
    c = chunks.select("chunk_id", "source_order", F.col("embedding").cast("array<double>").alias("v"), cell("chunk_id", cells).alias("cell")).withColumn("block", all_of(blocks))
    kinds = {name: df.schema[name].dataType.simpleString() for df, name in ((questions, "qid"), (chunks, "chunk_id"), (chunks, "source_order"))}

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("source_order", kind="stable").reset_index(drop=True)
            x, y = np.stack(left["qv"].to_numpy()), np.stack(right["v"].to_numpy())
            names, orders = right["chunk_id"].to_numpy(), right["source_order"].to_numpy()
            for at in range(0, len(x), 64):
                for qid, row in zip(left["qid"].iloc[at : at + 64], x[at : at + 64] @ y.T, strict=True):
                    score = np.round(row, places)
                    # the sort is stable over rows in source order, so ties go by it
                    first = np.argsort(-score, kind="stable")[:k]
                    out.append(pd.DataFrame({"qid": qid, "chunk_id": names[first], "source_order": orders[first], "score": score[first]}))
        return pd.concat(out) if out else pd.DataFrame({"qid": left["qid"][:0], "chunk_id": right["chunk_id"][:0], "source_order": right["source_order"][:0], "score": np.zeros(0)})

    scored = q.groupBy("block", "cell").cogroup(c.groupBy("block", "cell")).applyInPandas(meet, ", ".join(f"{n} {t}" for n, t in kinds.items()) + ", score double")
    return top_k(scored, k, rank="vector_rank").select("qid", "chunk_id", clamp(F.col("score")).alias("vector_score"), "vector_rank")


def fuse(dense: DataFrame, lexical: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """Outer-joined candidates with ``rrf`` and ``fused_score`` before any boost; whoever uses the score rounds it, once."""
    both = dense.join(lexical, ["qid", "chunk_id"], "full")
    one = lambda c: F.coalesce(1 / (F.lit(float(config.rrf)) + F.col(c)), F.lit(0.0))
    rrf = (one("vector_rank") + one("lexical_rank")) / F.lit(2.0 / (config.rrf + 1))
    lex, vec, rec = config.hashing_weights if config.hashing else config.learnt_weights
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = both.withColumn("rrf", F.round(rrf, 9))
    return both.withColumn("fused_score", lex * zero("lexical_score") + vec * zero("vector_score") + rec * F.col("rrf"))


def intent_boost(question: Column, text: Column, raw: Column, title: Column, clause: Column, section: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """What a question's wording adds to a chunk's score."""
    refs = policy_ids(question)
    exact = F.coalesce(F.array_contains(refs, clause), F.lit(False)) | F.coalesce(F.array_contains(refs, section), F.lit(False))
    shared = F.size(F.array_intersect(term_set(question, True, lexicon), term_set(F.coalesce(title, F.lit("")), lexicon=lexicon)))
    gain = lambda c, v: F.when(c, F.lit(v)).otherwise(F.lit(0.0))
    return (
        gain(exact, 0.35)
        + gain(question.rlike(NUMERIC_QUESTION) & text.rlike(NUMERIC_PASSAGE), 0.08)
        + gain(question.rlike(LIST_QUESTION) & (F.contains(text, F.lit("(a)")) | F.contains(raw, F.lit("|"))), 0.06)
        + F.least(F.lit(0.16), 0.08 * shared)
        + gain(F.array_contains(term_set(question, True, lexicon), "appeal") & (F.lower(title) == "right of appeal"), 0.18)
    )


def ranked(candidates: DataFrame, score: str = "ranking_score", rank: str = "pos") -> DataFrame:
    """By falling score; ties keep dense candidates first, in their order, then the lexical ones."""
    w = Window.partitionBy("qid").orderBy(F.col(score).desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "chunk_id")
    return candidates.withColumn(rank, F.row_number().over(w))


def rerank(candidates: DataFrame, logit: Column, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """The first ``rerank_k`` by fused score are rescored with a cross-encoder's logit; the rest keep theirs."""
    head = ranked(candidates, "fused_score", "pos")
    score = F.when(F.col("pos") <= config.rerank_k, 0.65 * squash(logit) + 0.35 * F.col("fused_score"))
    return head.withColumn("reranker_score", score).drop("pos")


def ranking_score() -> Column:
    return F.coalesce("reranker_score", "fused_score", F.greatest(F.coalesce("vector_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))))


def final_selection(candidates: DataFrame, pins: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """The lexical anchor kept within the cut, exact references first, then the best ``final_k``.

    ``pins`` are (qid, clause_id, pin_pos); a pinned chunk need not be a candidate.
    """
    k = config.final_k
    by = ranked(candidates)
    anchored = by.withColumn(
        "slot",
        F.when((F.col("lexical_rank") == 1) & (F.col("pos") > k), F.lit(k - 0.5)).otherwise(F.col("pos").cast("double")),
    )
    exact = pins.join(chunks.select("chunk_id", "clause_id"), "clause_id").groupBy("qid", "chunk_id").agg(F.min(F.struct("pin_pos", "clause_id")).alias("pin"))
    joined = anchored.join(exact, ["qid", "chunk_id"], "full")
    pinned = F.col("pin").isNotNull()
    joined = joined.withColumns(
        {
            "fused_score": F.when(pinned, 1.0).otherwise(F.col("fused_score")),
            "reranker_score": F.when(~pinned, F.col("reranker_score")),
            "neighbor_of": F.when(pinned, F.concat(F.lit("exact:"), F.col("pin.clause_id"))),
        }
    ).withColumn("ranking_score", ranking_score())
    w = Window.partitionBy("qid").orderBy(F.col("pin.pin_pos").asc_nulls_last(), F.col("slot").asc_nulls_last(), "chunk_id")
    return joined.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= k).drop("pin", "slot")


def pins_of(questions: DataFrame) -> DataFrame:
    """(qid, clause_id, pin_pos) of the identifiers that questions name."""
    return questions.select("qid", F.posexplode(policy_ids(F.col("question"))).alias("pin_pos", "clause_id"))


def pairs_to_score(candidates: DataFrame, questions: DataFrame, chunks: DataFrame, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """X11: (qid, chunk_id, question, passage) of the head of each question's candidates, which alone a cross-encoder sees."""
    head = ranked(candidates, "fused_score", "pos").where(F.col("pos") <= config.rerank_k).select("qid", "chunk_id")
    passage = F.concat(F.coalesce("section_title", F.lit("None")), F.lit(". "), "text")
    return head.join(questions.select("qid", "question"), "qid").join(chunks.select("chunk_id", passage.alias("passage")), "chunk_id")


def hybrid(
    questions: DataFrame,
    chunks: DataFrame,
    config: RetrievalConfig = RetrievalConfig(),
    lexicon: Lexicon = DEFAULT,
    logits: DataFrame | None = None,
    scorer: Scorer | None = None,
    required: bool = False,
    settle: Callable[[DataFrame], DataFrame] = lambda df: df,
    vectors: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(all candidates, final selection) of questions(qid, question, embedding) over chunks with embeddings.

    Embeddings may come apart, as ``vectors(chunk_id, embedding)``, so that texts need not be dealt to them. A ``scorer`` rescores the head, as ``logits`` of another origin do. Where it fails a question keeps its order, or the job
    stops if the scorer is ``required``. ``settle`` materialises what a model was asked, so that it is asked once.
    """
    text = F.coalesce("index_text", "text")
    dense = dense_candidates(questions, chunks if vectors is None else chunks.select("chunk_id", "source_order").join(vectors, "chunk_id"), config.dense_k)
    lexical = lexical_candidates(questions, chunks, text, config.lexical_k, lexicon)
    facts = chunks.select("chunk_id", "text", "raw_text", "section_title", "clause_id", "section_id", "source_order")
    c = fuse(dense, lexical, config).join(questions.select("qid", "question"), "qid")
    # so many candidates at most: where they are few they go to the texts, and the texts stay where they are
    few = questions.count() * (config.dense_k + config.lexical_k) <= FEW
    c = facts.join(F.broadcast(settle(c)), "chunk_id") if few else c.join(facts, "chunk_id")
    boost = intent_boost(F.col("question"), F.col("text"), F.col("raw_text"), F.col("section_title"), F.col("clause_id"), F.col("section_id"), lexicon)
    c = c.withColumn("fused_score", F.round(F.least(F.lit(1.0), F.col("fused_score") + boost), 9))
    if scorer is not None:
        c = settle(c)
        pairs = pairs_to_score(c, questions, chunks, config)
        logits = usable_logits(settle(scored(pairs, F.col("question"), F.col("passage"), scorer, required)), required)
    if logits is None:
        c = c.withColumn("reranker_score", F.lit(None).cast("double"))
    else:
        c = rerank(c.join(logits, ["qid", "chunk_id"], "left"), F.col("logit"), config).drop("logit")
    keep = ["qid", "chunk_id", "vector_score", "vector_rank", "lexical_score", "lexical_rank", "rrf", "fused_score", "reranker_score"]
    c = c.select(*keep).withColumn("ranking_score", ranking_score())
    return c, final_selection(c, pins_of(questions), chunks, config)
