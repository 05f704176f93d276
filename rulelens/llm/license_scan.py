"""Licence scan by a positional rare-token index, in built-in column functions only.

Texts are lower-cased (A-Z) and cut into words at every other ASCII non-letter, non-digit. Base places are where a phrase's
words stand consecutively. Beyond them, each template whose mandatory key phrases all stand in a text has its own rarest
words (highest inverse document frequency over the whole corpus) looked up there, wherever they stand; a word of template
place t met at text place i votes for the alignment i - t, and a template whose alignment gathers enough of these words adds
its label. What else a text holds takes nothing from a template, so one that stands in it word for word is always found.

The templates, hence the vocabulary, its frequencies and the postings, are fixed and small whatever the corpus: only they
are broadcast or come to the driver. Texts are not shuffled; only the looked-up words of likely files are.

Defined results: null and wordless texts have no words, no places, empty labels and score 0; a licence that is named twice
counts every place and one label; repeated rows get equal results each; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Base phrases and their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Template: label, wording, mandatory key phrases (fixed values; short notices in their public wording).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "version 2"]),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("lgpl", "licensed under the gnu lesser general public license", ["gnu lesser general public license"]),
    ("agpl-3", "licensed under the gnu affero general public license version 3", ["gnu affero general public license"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0"]),
    ("proprietary", "all rights reserved no part may be reproduced without prior written permission", ["all rights reserved"]),
]
#: How many of a template's rarest words are looked up, and the share of them that must align.
RARE, SHARE = 8, 0.6

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def padded_words(text: Column) -> Column:
    """The words of a text between single blanks, with one before and after; a single blank without words."""
    line = F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS, " "))
    return F.when(line == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), line, F.lit(" ")))


def _blanks(col: Column) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit(" ")))).cast("long")


def places(line: Column, n_words: Column, phrase: str) -> tuple[Column, Column, Column]:
    """(number, first, last) of the places where a phrase stands; none of the phrases can overlap itself."""
    parts = F.split(line, f"(?<= ){phrase}(?= )", -1)
    there = F.contains(line, F.lit(f" {phrase} "))
    size = len(phrase.split())
    number = F.when(there, F.size(parts).cast("long") - 1).otherwise(F.lit(0).cast("long"))
    first = F.when(there, _blanks(F.element_at(parts, 1)) - 1)
    last = F.when(there, n_words - (_blanks(F.element_at(parts, -1)) - 1) - size)
    return number, first, last


def _vocabulary() -> list[str]:
    return sorted({w for _, wording, _ in TEMPLATES for w in wording.split()})


def _literal_set(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def word_weights(lines: DataFrame) -> tuple[int, dict[str, float]]:
    """(documents, inverse document frequency of each licence word), counted over all of ``lines(line)``."""
    vocabulary = _literal_set(_vocabulary())
    own = F.array_intersect(F.split("line", " "), vocabulary)
    counted = lines.select(F.explode(F.array_append(own, F.lit(""))).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    found = {r["w"]: r["n"] for r in counted.collect()}  # at most one row for each word of the templates
    total = found.pop("", 0)
    return total, {w: math.log((total + 1) / (found.get(w, 0) + 1)) for w in _vocabulary()}


def _key() -> Column:
    return F.struct(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("i"), F.xxhash64("text").alias("h"))


def aligned(docs: DataFrame, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """(key, label, score): templates that align with a text and whose key phrases stand in it."""
    spark = docs.sparkSession
    lines = docs.select(_key().alias("key"), padded_words(F.col("text")).alias("line"))
    _, weight = word_weights(lines.select("line"))
    ranked = sorted(weight, key=lambda w: (-weight[w], w))
    postings, tops = [], []
    for t, (_, wording, _) in enumerate(TEMPLATES):
        words = wording.split()
        top = sorted(set(words), key=ranked.index)[:rare]
        tops.append(_literal_set(top))
        postings += [(w, t, i) for i, w in enumerate(words) if w in top]
    index = spark.createDataFrame(postings, "word string, template int, place int")

    # the line is bound once, not spelt out for each phrase; most texts go by a pattern over the plain text before that
    met_by = lambda line: F.array_compact(F.array(*[F.when(_all_in(line, keys), F.lit(t)) for t, (_, _, keys) in enumerate(TEMPLATES)]))
    likely = docs.where(F.col("text").rlike(_likely())).select(_key().alias("key"), padded_words(F.col("text")).alias("line"))
    likely = likely.withColumn("ready", F.transform(F.array("line"), met_by)[0]).where(F.size("ready") > 0)
    # every ready template looks up its own words, so templates and other licence words take no places from each other
    chosen = F.array_distinct(F.flatten(F.transform("ready", lambda t: F.get(F.array(*tops), t))))
    words = F.split(F.substring(F.col("line"), F.lit(2), F.length("line")), " ")
    numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    met = likely.withColumn("chosen", chosen).select(
        "key", "ready", F.explode(F.filter(numbered, lambda x: F.array_contains(F.col("chosen"), x["w"]))).alias("m")
    )
    votes = (
        met.select("key", "ready", F.col("m.w").alias("word"), F.col("m.i").alias("i"))
        .join(F.broadcast(index), "word")
        .where(F.array_contains("ready", F.col("template")))
        .groupBy("key", "template", (F.col("i") - F.col("place")).alias("shift"))
        .agg(F.countDistinct("place").alias("hits"))
        .groupBy("key", "template")
        .agg(F.max("hits").alias("hits"))
    )
    info = spark.createDataFrame(
        [(t, label, len([p for p in postings if p[1] == t])) for t, (label, _, _) in enumerate(TEMPLATES)],
        "template int, label string, posted int",
    )
    scored = votes.join(F.broadcast(info), "template").withColumn("score", F.least(F.lit(1.0), F.col("hits") / F.col("posted")))
    return scored.where(F.col("score") >= share).groupBy("key", "label").agg(F.max("score").alias("score"))


def _likely() -> str:
    """A pattern that every text with some template's key phrases matches: the longest word of each first phrase."""
    words = sorted({max(keys[0].split(), key=len) for _, _, keys in TEMPLATES})
    return f"(?i)(?<![A-Za-z0-9])(?:{'|'.join(words)})(?![A-Za-z0-9])"


def _all_in(line: Column, phrases: list[str]) -> Column:
    out = F.lit(True)
    for p in phrases:
        out = out & F.contains(line, F.lit(f" {p} "))
    return out


def scan(docs: DataFrame, rare: int = RARE, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs(doc_id, text)."""
    line = docs.select("doc_id", _key().alias("key"), padded_words(F.col("text")).alias("line"))
    line = line.withColumn("n_words", F.greatest(_blanks(F.col("line")) - 1, F.lit(0).cast("long")))
    each = {label: places(F.col("line"), F.col("n_words"), phrase) for phrase, label in PHRASES.items()}
    number = sum((n for n, _, _ in each.values()), F.lit(0).cast("long"))
    base = line.select(
        "doc_id",
        "key",
        "n_words",
        number.alias("n_base"),
        F.least(*[f for _, f, _ in each.values()]).alias("first_word"),
        F.greatest(*[x for _, _, x in each.values()]).alias("last_word"),
        F.array_compact(F.array(*[F.when(n > 0, F.lit(k)) for k, (n, _, _) in each.items()])).alias("own"),
    )
    more = aligned(docs, rare, share).groupBy("key").agg(F.collect_set("label").alias("more"), F.max("score").alias("found"))
    return base.join(more, "key", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("own"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("own") > 0, F.lit(1.0)).otherwise(F.coalesce("found", F.lit(0.0))).alias("score"),
    )
