"""Personal data: keyed surrogates of the same type, format, script and gender, in built-in column functions only.

Entities (emails, IPv4 addresses, IBANs, social security and card numbers, phones, names after a title or a cue or with a
known given name) are marked in the text by one pattern. An entity's canonical form (digits alone, lower case) and the key
give its surrogate through SHA-256, so all mentions of one entity, however they are written, get one replacement, laid out as
the mention is: separators, digits per group, spaces and case stay, card numbers keep their Luhn parity, emails go to the
reserved domain ``example``.

Names are replaced word by word: given names by given names of the same gender and script, surnames by surnames of the same
script, so that ``Mr Peter Smith``, ``Mr Smith`` and ``SMITH`` after a title keep one surname. A given name's gender is the
known one, else that of most titles before it anywhere in the corpus, else open.

Collision checks run over the table of distinct entities: a surrogate that two entities share, or that is itself an entity of
the corpus, is drawn again for all but the smallest entity (for all of them in the second case) until none is left, so distinct
entities stay distinct. Numbers of all types are checked together, as are the words of names. Each further draw of a name is
from a wider space. The tables hold one row for each distinct entity and mention; only texts that hold entities meet them, by
a join that AQE may split. All others pass by one cheap pattern and are never shuffled.

Names without a title, a cue or a known given name are not found; an address with empty host labels counts as an email; scripts
other than Latin, Cyrillic, Greek and Armenian have Latin surrogates. Defined results: null and empty texts stay; texts without
entities stay as they are; repeated rows get equal results; other columns are kept, whatever their names, but an input column
``n_entities`` gives way; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

_L = r"\p{L}\p{M}"
#: Given names (fixed values): gender (n is open) and script decide which list replaces which.
GIVEN = {
    ("f", "latin"): "Anna Maria Julia Laura Sofia Emma Clara Elena Alice Nina Rosa Marta Lucia Irene Paula Vera Jane Mary Sarah Susan Linda Emily Helen Karen Lisa Nancy Ruth Olivia Grace Hannah".split(),
    ("m", "latin"): "Peter Paul Jonas Lukas David Simon Marco Bruno Oscar Felix Hugo Anton Victor Martin Carlos Leon Tom John James Robert William Thomas George Henry Michael Daniel Andrew Philip Walter Stefan".split(),
    ("n", "latin"): "Robin Kim Alex Sam Jules Noa Charlie Toni".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Ирина Нина Вера Софья".split(),
    ("m", "cyrillic"): "Иван Пётр Олег Антон Павел Борис Лев Марк".split(),
    ("n", "cyrillic"): "Саша Женя Валя Слава".split(),
    ("f", "greek"): "Μαρία Ελένη Άννα Σοφία Κατερίνα Ιωάννα Βασιλική Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Πέτρος Ανδρέας Μιχάλης Δημήτρης Κώστας Σπύρος".split(),
    ("n", "greek"): "Άλεξ Ρόμπιν Κιμ Νοά".split(),
}
#: Titles, of people of either gender last, and what announces a name (fixed values).
_TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Mme", "Sra", "Lady", "Г-жа", "Κα"],
    "m": ["Mr", "Herr", "Mister", "Sr", "Don", "Sir", "Г-н", "Κος"],
    "n": ["Dr", "Prof", "Professor", "Doctor", "Mx", "Rev", "Judge"],
}
_CUES = ["My name is", "my name is", "Signed by", "signed by"]
#: What stands between the words of a name and stays (fixed values).
_PARTICLES = "van von de der den di da del la le bin al ter zu".split()
_CONSONANTS, _VOWELS = ("bdklmnrs", "бдклмнрс", "βδκλμνρσ", "բդկլմնրս"), ("aeio", "аеио", "αειο", "աեիո")
_SCRIPTS = {"latin": "Latin", "cyrillic": "Cyrillic", "greek": "Greek", "armenian": "Armenian"}
_SYLLABLES = {script: [c + v for c in cs for v in vs] for script, cs, vs in zip(_SCRIPTS, _CONSONANTS, _VOWELS, strict=True)}


def _any(words: list[str]) -> str:
    """An alternation of words, dealt by their first letter so that few are tried at a place."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[0], []).append(w[1:])
    return "|".join(f"{c}(?:{'|'.join(sorted(tails, reverse=True))})" for c, tails in sorted(by.items()))


_WORD = rf"\p{{Lu}}[{_L}'’-]+"
_ANY_TITLE, _ANY_CUE = _any([t for ts in _TITLES.values() for t in ts]), _any(_CUES)
_ANY_GIVEN = _any(sorted({g for gs in GIVEN.values() for g in gs}))
#: What stands before the words of a name.
_BEFORE = rf"(?:(?:{_ANY_TITLE})\.?\x20){{1,2}}|(?:{_ANY_CUE})\x20"
_REST = rf"(?:\x20(?:{'|'.join(_PARTICLES)})){{0,2}}\x20{_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: Types in order of precedence, and their patterns; runs of any length are flat character classes, which match without recursion.
PATTERNS = {
    "email": rf"(?<![{_L}\p{{N}}._%+-])[{_L}\p{{N}}._%+-]+@[{_L}\p{{N}}-][{_L}\p{{N}}.-]*\.\p{{L}}{{2,}}",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[\x20-]?\d){12,18}(?!\d)",
    "phone": r"(?<![\p{L}\d.])(?:\+\d{1,3}[\x20.-]?(?:\(\d{2,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,4}|\(\d{3}\)\x20?\d{3}-\d{4}|\d{3}-\d{3}-\d{4})(?!\d)",
    "name": rf"(?<!\p{{L}})(?:(?:{_BEFORE}){_WORD}(?:{_REST})?|(?:{_ANY_GIVEN}){_REST})",
}
UNION = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds: two digits in a row or about one blank, dot or hyphen, an at sign between characters, or a title, cue or known given name before a blank.
HINT = rf"[0-9][\x20.-]?[0-9]|\S@\S|(?<!\p{{L}})(?:{_ANY_TITLE}|{_ANY_CUE}|{_ANY_GIVEN})\.?\x20"


def _kind(value: Column) -> Column:
    out = None
    for k, p in PATTERNS.items():
        # look-around holds at the edges of a cut-out value, so each type is told by a whole match
        here = value.rlike(f"^(?:{p})$")
        out = F.when(here, F.lit(k)) if out is None else out.when(here, F.lit(k))
    return out.otherwise(F.lit("phone"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def canonical(kind: Column, value: Column) -> Column:
    """What all mentions of one entity share; the words of names are taken apart by ``parts``."""
    return (
        F.when(kind.isin("ssn", "card", "phone"), _digits(value))
        .when(kind == "iban", F.replace(value, F.lit(" ")))
        .when(kind == "email", F.lower(value))
        .otherwise(value)
    )


def _listed_gender(word: Column) -> Column:
    """f or m of a known given name in lower case, else null."""
    out = None
    for g in ("f", "m"):
        known = word.isin([n.lower() for (s, _), names in GIVEN.items() if s == g for n in names])
        out = F.when(known, F.lit(g)) if out is None else out.when(known, F.lit(g))
    return out


def parts(values: DataFrame) -> DataFrame:
    """(value, kind, pos, piece, canon) of distinct values: one row for a number or address, one for each word of a name.

    A name's canon is its gender and the word, ``s`` standing for surnames; kind is ``keep`` for particles, which stay.
    """
    value = F.col("value")
    typed = values.select("value", _kind(value).alias("kind"), F.regexp_extract(value, f"^(?:{_BEFORE})", 0).alias("before"))
    words = F.split(F.substring(value, F.length("before") + 1, F.length(value)), " ")
    told = F.when(F.col("before").rlike(f"(?:^|\\x20)(?:{_any(_TITLES['f'])})\\.?\\x20"), F.lit("f")).when(F.col("before").rlike(f"(?:^|\\x20)(?:{_any(_TITLES['m'])})\\.?\\x20"), F.lit("m"))
    named = F.transform(words, lambda w, i: F.struct(i.alias("pos"), w.alias("piece"), F.lower(F.regexp_replace(w, "['’]s$", "")).alias("canon")))
    whole = F.array(F.struct(F.lit(0).alias("pos"), value.alias("piece"), canonical(F.col("kind"), value).alias("canon")))
    p = typed.select("value", "kind", told.alias("told"), F.size(words).alias("n"), F.explode(F.when(F.col("kind") == "name", named).otherwise(whole)).alias("p"))
    p = p.select("value", "kind", "told", "n", "p.*")
    known = _listed_gender(F.col("canon"))
    role = F.when(F.col("piece").isin(_PARTICLES), "keep").when((F.col("n") > 1) & (F.col("pos") == 0) | (F.col("n") == 1) & known.isNotNull(), "given").otherwise("family")
    p = cut(p.withColumn("role", F.when(F.col("kind") == "name", role)))
    given = p.where("role = 'given'").groupBy("canon").agg(F.count_if(F.col("told") == "f").alias("f"), F.count_if(F.col("told") == "m").alias("m"))
    gender = F.coalesce(known, F.when(F.col("f") > F.col("m"), "f").when(F.col("m") > F.col("f"), "m").otherwise("n"))
    p = p.join(given.select("canon", gender.alias("gender")), "canon", "left")
    letter = F.when(F.col("role") == "family", "s").when(F.col("role") == "given", F.col("gender"))
    kind = F.when(F.col("role") == "keep", "keep").otherwise(F.col("kind"))
    return p.select("value", kind.alias("kind"), "pos", "piece", F.when(letter.isNotNull(), F.concat(letter, F.lit(":"), "canon")).otherwise(F.col("canon")).alias("canon"))


def _stream(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """128 hexadecimal digits of keyed hash."""
    seed = F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"))
    return F.concat(F.sha2(seed.cast("binary"), 256), F.sha2(F.concat(seed, F.lit("|+")).cast("binary"), 256))


def _draw(stream: Column, i: Column, size: int) -> Column:
    at = (i % 31) * 4 + 1
    return F.conv(F.substring(stream, at.cast("int"), F.lit(4)), 16, 10).cast("int") % size


_ALPHABETS = [("0123456789", r"^[0-9]$"), ("abcdefghijklmnopqrstuvwxyz", r"^[a-zß-öø-ÿ]$"), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", r"^[A-ZÀ-ÖØ-Þ]$"), ("абвгдежзиклмнопрстуфхцчшэюя", r"^\p{IsCyrillic}$"), ("αβγδεζηθικλμνξοπρστυφχψω", r"^\p{IsGreek}$"), ("բգդզթժլկհղճմյնչպջռսվտրփքօ", r"^\p{IsArmenian}$"), ("abcdefghijklmnopqrstuvwxyz", r"^\p{L}$")]


def _by_class(value: Column, stream: Column) -> Column:
    """Each character replaced by one of its own alphabet; others stay."""

    def one(c: Column, i: Column) -> Column:
        out = None
        for letters, pattern in _ALPHABETS:
            new = F.substring(F.lit(letters), (_draw(stream, i, len(letters)) + 1), F.lit(1))
            out = F.when(c.rlike(pattern), new) if out is None else out.when(c.rlike(pattern), new)
        return out.otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one counting once."""
    n = F.length(digits)

    def value(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when((n - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), value), F.lit(0), lambda a, x: a + x)


def surrogate(key: str, kind: Column, value: Column, attempt: Column) -> Column:
    """The replacement of a canonical form."""
    s = _stream(key, kind, value, attempt)
    drawn = _by_class(value, s)
    body = F.concat(F.lit("9"), F.substring(drawn, F.lit(2), F.length(value) - 2), F.lit("0"))
    parity = _luhn(body) % 10
    fixed = F.concat(F.substring(body, F.lit(1), F.length(value) - 1), ((10 - parity) % 10).cast("string"))
    odd = F.concat(F.substring(body, F.lit(1), F.length(value) - 1), ((11 - parity) % 10).cast("string"))
    card = F.when(_luhn(value) % 10 == 0, fixed).otherwise(odd)
    ip = F.array_join(F.array(*[(_draw(s, F.lit(i), 254) + 1).cast("string") for i in range(4)]), ".")
    local = F.split(value, "@")[0]
    label = F.array_join(F.array(*[F.element_at(F.array(*map(F.lit, _SYLLABLES["latin"])), _draw(s, F.lit(20 + i), 32) + 1) for i in range(4)]), "")
    email = F.concat(_by_class(local, s), F.lit("@"), label, F.lit(".example"))
    letter, words = F.substring(value, 1, 1), F.split(F.substring(value, F.lit(3), F.length(value)), " ")

    def sounds(script: str, first: int, number: Column) -> Column:
        """So many syllables of a script."""
        own = F.array(*map(F.lit, _SYLLABLES[script]))
        return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), number), lambda i: F.element_at(own, _draw(s, i + first, 32) + 1)), ""))

    def person(script: str) -> Column:
        family = sounds(script, 9, F.least(attempt, F.lit(16)) + 4)
        if ("f", script) in GIVEN:
            pick = lambda g, i: F.element_at(F.array(*map(F.lit, GIVEN[g, script])), _draw(s, F.lit(i), len(GIVEN[g, script])) + 1)
            of = lambda i: F.when(letter == "f", pick("f", i)).when(letter == "m", pick("m", i)).otherwise(pick("n", i))
            # first a name of the list, then two of them, then one with ever more syllables
            given = F.when(attempt < 2, of(9)).when(attempt < 4, F.concat_ws("-", of(9), of(8))).otherwise(F.concat_ws("-", of(9), sounds(script, 10, F.least(attempt, F.lit(16)))))
        else:
            given = sounds(script, 10, F.least(attempt, F.lit(16)) + 2)
        return F.when(F.size(words) > 1, F.concat_ws(" ", given, family)).when(letter == "s", family).otherwise(given)

    name = None
    for script, property_ in _SCRIPTS.items():
        here = value.rlike(rf"\p{{Is{property_}}}") if script != "latin" else F.lit(False)
        name = F.when(here, person(script)) if name is None else name.when(here, person(script))
    # the letter before the colon is Latin, so the other scripts are asked first
    name = name.otherwise(person("latin"))
    iban = F.concat(F.substring(value, 1, 2), F.substring(_by_class(value, s), F.lit(3), F.length(value)))
    phone = F.concat(F.substring(value, 1, 1), F.substring(drawn, F.lit(2), F.length(value)))
    return F.when(kind == "card", card).when(kind == "ip", ip).when(kind == "email", email).when(kind == "name", name).when(kind == "iban", iban).when(kind == "phone", phone).otherwise(drawn)


def lay_out(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate written as its mention is."""
    place = lambda pattern: F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(c.rlike(pattern), F.substring(new, F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), f"(?!{pattern}).", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )
    suffix = F.regexp_extract(value, "['’]s$", 0)
    bare = F.regexp_replace(value, "['’]s$", "")
    loud = lambda c: (F.upper(c) == c) & (F.lower(c) != c)
    # the local part is drawn letter by letter, so that each letter's case can be kept
    own, drawn = F.split(F.substring_index(value, "@", 1), ""), F.split(F.substring_index(new, "@", 1), "")
    local = F.array_join(F.zip_with(own, drawn, lambda c, d: F.when(loud(c), F.upper(d)).otherwise(d)), "")
    host = F.substring_index(new, "@", -1)
    return (
        F.when(kind.isin("ssn", "card", "phone"), place("[0-9]"))
        .when(kind == "iban", place("[A-Z0-9]"))
        .when(kind == "name", F.concat(F.when(loud(bare), F.upper(new)).otherwise(new), suffix))
        .when(kind == "email", F.concat(local, F.lit("@"), F.when(loud(F.substring_index(value, "@", -1)), F.upper(host)).otherwise(host)))
        .otherwise(new)
    )


#: Marks the edges of entities in a text that does not hold it.
_EDGE = "\ue000\x01"


def pieces(text: Column) -> Column:
    """A text cut at its entities: those stand at odd places, what is between them at even ones."""
    marked = F.split(F.regexp_replace(text, f"(?:{UNION})", f"{_EDGE}$0{_EDGE}"), _EDGE, -1)
    found = F.regexp_extract_all(text, F.lit(UNION), F.lit(0))
    gaps = F.split(text, UNION, -1)
    laid = F.flatten(F.transform(gaps, lambda g, i: F.when(i < F.size(found), F.array(g, F.get(found, i))).otherwise(F.array(g))))
    return F.when(F.contains(text, F.lit(_EDGE[0])) | F.contains(text, F.lit(_EDGE[1])), laid).otherwise(marked)


def entity_table(found: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """(kind, canon, new) of each distinct entity of found(kind, canon), all ``new`` distinct and no entity of the corpus."""
    settled = cut(found.distinct().withColumn("attempt", F.lit(0)).withColumn("new", surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))))
    # numbers of all types share one space, as do given names of one gender; a surname must be no surname of the corpus
    space = F.when(F.col("kind").isin("ssn", "card", "phone"), "digits").otherwise(F.col("kind"))
    known = settled.select(space.alias("space"), F.lower("canon").alias("form"))
    formed = F.when(F.col("kind") == "name", F.concat(F.lit("s:"), F.lower("new"))).otherwise(F.lower("new"))
    for _ in range(rounds):
        placed = settled.withColumn("space", space)
        shared = placed.groupBy("space", "new").agg(F.min(F.struct("kind", "canon")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("space", "new", "first")
        real = placed.withColumn("form", formed).join(known, ["space", "form"], "left_semi").select("kind", "canon").withColumn("again", F.lit(True))
        clash = placed.join(shared, ["space", "new"]).where(F.struct("kind", "canon") != F.col("first")).select("kind", "canon").withColumn("again", F.lit(True))
        again = cut(real.unionByName(clash).distinct())
        if again.isEmpty():
            return settled.select("kind", "canon", "new")
        moved = settled.join(again, ["kind", "canon"], "left").withColumn("attempt", F.col("attempt") + F.when(F.col("again"), 1).otherwise(0))
        fresh = F.when(F.col("again"), surrogate(key, F.col("kind"), F.col("canon"), F.col("attempt"))).otherwise(F.col("new"))
        settled = cut(moved.select("kind", "canon", "attempt", fresh.alias("new")))
    raise RuntimeError("surrogates of some type keep colliding: too few of its format for its entities")


def replacements(values: DataFrame, key: str) -> DataFrame:
    """(value, out) of distinct mentions."""
    each = cut(parts(values))
    table = entity_table(each.where("kind <> 'keep'").select("kind", "canon"), key)
    written = F.coalesce(lay_out(F.col("kind"), F.col("piece"), F.col("new")), F.col("piece"))
    laid = each.join(table, ["kind", "canon"], "left").select("value", F.struct("pos", written.alias("w")).alias("p"))
    rows = laid.groupBy("value").agg(F.array_join(F.transform(F.array_sort(F.collect_set("p")), lambda p: p["w"]), " ").alias("out"))
    before = F.regexp_extract("value", f"^(?:{_BEFORE})", 0)
    # what a title stands before is a name, and no other type begins with a title
    return rows.select("value", F.concat(before, "out").alias("out"))


def anonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and ``n_entities``."""
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the full pattern is dear, so it runs once and only over texts that may hold an entity
    found = cut(docs.where(hinted).select(whole.alias("row"), pieces(F.col("text")).alias("pieces")))
    ident = F.struct(F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")).alias("i"), F.xxhash64("row.text").alias("h"))
    some = found.where(F.size("pieces") > 1).withColumn("k", ident)
    each = cut(some.select("k", F.explode(F.array_distinct(F.filter("pieces", lambda x, i: i % 2 == 1))).alias("value")).distinct())
    out = replacements(each.select("value").distinct(), key)
    to = each.join(out, "value").groupBy("k").agg(F.map_from_entries(F.collect_set(F.struct("value", "out"))).alias("to"))
    filled = F.array_join(F.transform("pieces", lambda x, i: F.when(i % 2 == 1, F.element_at("to", x)).otherwise(x)), "")
    names = [c for c in docs.columns if c != "n_entities"]
    number = ((F.size("pieces") - 1) / 2).cast("long").alias("n_entities")
    done = some.join(to, "k").select(*[filled.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in names], number)
    bare = found.where(F.size("pieces") <= 1).select(*[F.col(f"row.`{c}`") for c in names], number)
    rest = docs.where(~hinted).select(*[F.col(f"`{c}`") for c in names], F.lit(0).cast("long").alias("n_entities"))
    return done.unionByName(bare).unionByName(rest)
