"""Text algebra as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import DEFAULT, Lexicon

#: Token and number patterns (fixed values), over lower-cased text.
TOKEN = r"§?[0-9]+(?:\.[0-9]+)+|\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?|[a-z][a-z'-]*"
NUMBER = r"\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?%?"
FEATURE_WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
SECTION_REF = r"§([0-9]+\.[0-9]+(?:\.[0-9]+[A-Z]?)?)"
POLICY_ID = r"§?([0-9]+\.[0-9]+(?:\.[0-9]+)?)"
QUANTITY = r"(?i)(\$?[0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)\s*(calendar\s+days?|working\s+days?|days?|weeks?|months?|years?|per\s+cent|percent|%)"
POSITIVE_ACTION = r"(?i)\b(?:must|shall|may)\s+(?!not\b)(?:be\s+)?([a-z]+)"
NEGATIVE_ACTION = r"(?i)\b(?:must not|shall not|may not)\s+(?:be\s+)?([a-z]+)"
ASPECT_CUT = r"(?i)\s*,\s*|\s+and\s+|\s+including\s+"
ASPECT_HINT = r"(?i),|\band\b|\bincluding\b"
LEADING_INSTRUCTION = r"(?i)^.*?\.\s*(?=(?:how|what|when|where|which|who|can|could|does|do|is|are|may|must|will|would)\b)"


def extract_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(values) -> Column:
    """A literal array of strings, in a stable order."""
    values = sorted(values)
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def display_text(text: Column) -> Column:
    """Without emphasis and code marks, trimmed."""
    return F.trim(F.replace(F.replace(text, F.lit("**"), F.lit("")), F.lit("`"), F.lit("")))


def normalized_text(text: Column) -> Column:
    """P1 with runs of white space collapsed."""
    return F.trim(F.regexp_replace(display_text(text), r"\s+", " "))


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable stands for it, so that plans stay small."""
    return F.transform(F.array(value), use)[0]


def _bare(token: Column) -> Column:
    return F.when(F.endswith(token, F.lit("'s")), F.substring(token, F.lit(1), F.length(token) - 2)).otherwise(token)


def _suffix(t: Column) -> Column:
    n = F.length(t)
    cut = lambda k: F.substring(t, F.lit(1), n - k)
    twice = F.substring(t, n - 3, F.lit(1)) == F.substring(t, n - 4, F.lit(1))
    return (
        F.when((n > 5) & t.rlike("i(?:es|ed)$"), F.concat(cut(3), F.lit("y")))
        .when((n > 5) & F.endswith(t, F.lit("ing")), F.when(twice, cut(4)).otherwise(cut(3)))
        .when((n > 4) & F.endswith(t, F.lit("ed")), cut(2))
        .when((n > 3) & t.rlike("[^s]s$"), cut(1))
        .otherwise(t)
    )


def stems(tokens: Column) -> Column:
    """T3 over an array: the first suffix rule that applies to each, after a possessive is dropped."""
    return F.transform(F.transform(tokens, _bare), _suffix)


def stem(token: Column) -> Column:
    """T3 of one token."""
    return stems(F.array(token))[0]


def stem_column(token: Column) -> Column:
    """T3 of a column of tokens, as one expression that runs in generated code."""
    return _suffix(_bare(token))


def raw_tokens(text: Column) -> Column:
    """Tokens of the lower-cased text, without section and dollar signs or thousands commas."""
    found = extract_all(F.lower(text), TOKEN)
    return F.transform(found, lambda t: F.replace(F.regexp_replace(t, r"^[§$]+|[§$]+$", ""), F.lit(","), F.lit("")))


def _expansion_map(lexicon: Lexicon) -> Column:
    pairs = []
    for k in sorted(lexicon.synonyms):
        pairs += [F.lit(k), F.array(*map(F.lit, lexicon.synonyms[k]))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,array<string>>")


def tokenize(text: Column, expand: bool = False, keep_stop_words: bool = False, lexicon: Lexicon = DEFAULT) -> Column:
    """Stems, repeats kept; a token goes if it or its stem is a stop word; expansions follow at the end."""
    empty = F.array().cast("array<string>")
    stop = words(lexicon.stop_words)
    pairs = let(raw_tokens(text), lambda raw: F.zip_with(raw, stems(raw), lambda r, s: F.struct(r.alias("r"), s.alias("s"))))
    if not keep_stop_words:
        pairs = F.filter(pairs, lambda p: ~F.array_contains(stop, p["r"]) & ~F.array_contains(stop, p["s"]))
    if not expand:
        return F.coalesce(F.transform(pairs, lambda p: p["s"]), empty)
    table = _expansion_map(lexicon)
    look = lambda t: F.coalesce(F.element_at(table, t), empty)
    own = let(pairs, lambda ps: F.concat(F.transform(ps, lambda p: p["s"]), stems(F.flatten(F.transform(ps, lambda p: F.concat(look(p["r"]), look(p["s"])))))))
    said = F.array(*[F.struct(F.lit(k).alias("k"), F.array(*map(F.lit, v)).alias("v")) for k, v in lexicon.phrases.items()])
    phrased = let(F.lower(text), lambda low: stems(F.flatten(F.transform(F.filter(said, lambda x: F.contains(low, x["k"])), lambda x: x["v"]))))
    return F.coalesce(F.concat(own, phrased) if lexicon.phrases else own, empty)


def term_set(text: Column, expand: bool = False, lexicon: Lexicon = DEFAULT) -> Column:
    return F.array_distinct(tokenize(text, expand, lexicon=lexicon))


def one_edit_apart(a: Column, b: Column) -> Column:
    """One insertion, deletion or substitution, or two neighbours swapped."""
    same_length = F.length(a) == F.length(b)
    marks = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y)
    at = F.array_position(marks, False).cast("int")
    swapped = (
        (F.size(F.filter(marks, lambda m: ~m)) == 2)
        & (F.substring(a, at, F.lit(2)) == F.reverse(F.substring(b, at, F.lit(2))))
    )
    return (F.levenshtein(a, b) == 1) | (same_length & (F.levenshtein(a, b) == 2) & swapped)


def feature_words(text: Column) -> Column:
    """Words, and pairs of neighbours joined by two colons."""
    w = extract_all(F.lower(text), FEATURE_WORD)
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.concat(w, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat(a, F.lit("::"), b)))


def focus_question(question: Column) -> Column:
    """Without a leading instruction sentence."""
    return F.regexp_replace(F.trim(question), LEADING_INSTRUCTION, "")


def policy_ids(question: Column) -> Column:
    """Distinct identifiers in the order of the question."""
    return F.array_distinct(extract_all(question, POLICY_ID, 1))


def aspects(question: Column, lexicon: Lexicon = DEFAULT) -> Column:
    """The parts of a compound question that carry terms; none unless there are two."""
    parts = F.split(focus_question(question), ASPECT_CUT)
    clean = F.transform(parts, lambda p: F.regexp_replace(F.regexp_replace(p, r"^[ ?.!]+|[ ?.!]+$", ""), r"(?i)^(?:and|including)\s+", ""))
    clean = F.filter(clean, lambda p: (p != "") & (F.size(tokenize(p, True, lexicon=lexicon)) > 0))
    some = question.rlike(ASPECT_HINT) & (F.size(clean) > 1)
    return F.when(some, clean).otherwise(F.array().cast("array<string>"))


def quantities(text: Column) -> Column:
    """Distinct (unit, value) pairs, units canonical, values bare."""
    value = F.transform(extract_all(text, QUANTITY, 1), lambda v: F.replace(F.replace(v, F.lit("$"), F.lit("")), F.lit(","), F.lit("")))
    unit = F.transform(extract_all(text, QUANTITY, 2), lambda u: canonical_unit(F.lower(u)))
    return F.array_sort(F.array_distinct(F.zip_with(unit, value, lambda u, v: F.struct(u.alias("unit"), v.alias("value")))))


def canonical_unit(unit: Column) -> Column:
    return (
        F.when(F.contains(unit, F.lit("day")), "days")
        .when(F.contains(unit, F.lit("week")), "weeks")
        .when(F.contains(unit, F.lit("month")), "months")
        .when(F.contains(unit, F.lit("year")), "years")
        .otherwise("percent")
    )


def actions(text: Column, negative: bool) -> Column:
    """The verbs that a modal commands or forbids."""
    return F.array_distinct(F.transform(extract_all(text, NEGATIVE_ACTION if negative else POSITIVE_ACTION, 1), F.lower))


def numbers(text: Column) -> Column:
    """Number tokens."""
    return extract_all(text, NUMBER)


def section_refs(text: Column) -> Column:
    """Sorted distinct section and clause references."""
    return F.array_sort(F.array_distinct(extract_all(text, SECTION_REF, 1)))


def money(amount: Column) -> Column:
    """A dollar amount with thousands commas, cents only where there are any."""
    whole = F.concat(F.lit("$"), F.format_number(amount.cast("double"), 0))
    return F.when(amount == F.floor(amount), whole).otherwise(F.concat(F.lit("$"), F.format_number(amount.cast("double"), 2)))


def long_date(day: Column) -> Column:
    return F.date_format(day, "d MMMM yyyy")


#: Number words (fixed values).
_COUNTS = "one two three four five six seven eight nine ten".split()


def household_size(question: Column) -> Column:
    """A household's size in digits or number words, or null."""
    pattern = rf"(?i)\b(?:household|family)\s+(?:size\s+)?(?:of|with|has)\s+([0-9]{{1,2}}|{'|'.join(_COUNTS)})\b|\b([0-9]{{1,2}}|{'|'.join(_COUNTS)})[- ](?:person|member|people)\b"
    found = F.lower(F.concat(F.regexp_extract(question, pattern, 1), F.regexp_extract(question, pattern, 2)))
    spelt = F.array_position(F.array(*map(F.lit, _COUNTS)), found)
    return F.when(spelt > 0, spelt.cast("int")).otherwise(F.try_to_number(F.nullif(found, F.lit("")), F.lit("99")).cast("int"))


def markdown_cell(text: Column) -> Column:
    """Safe in a cell of a Markdown table."""
    return F.regexp_replace(F.replace(text, F.lit("|"), F.lit("\\|")), r"\r?\n", " ")


def fill_template(template: str, **values: Column) -> Column:
    """Literal placeholders replaced by columns; a value's own braces are never looked at again."""
    parts: list[Column] = []
    rest = template
    while rest:
        at = min((i for i in (rest.find("{" + k + "}") for k in values) if i >= 0), default=-1)
        if at < 0:
            parts.append(F.lit(rest))
            break
        name = next(k for k in values if rest.startswith("{" + k + "}", at))
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")
