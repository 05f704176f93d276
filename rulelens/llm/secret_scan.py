"""Secret scan by multipart credential linking, in built-in column functions only.

Three base patterns report what is a secret by itself. Weak parts (names of accounts, short or merely random-looking
values, endpoints) say little alone; they are interval-joined within a scope, which is a paragraph (text between blank
lines) and at most ``reach`` code points from part to part, and reported only beside what completes them: a name beside a
secret, a weak secret beside a name or access identifier, an endpoint beside both. The join is one pass forwards and one
backwards over the sorted parts of a text, so it takes time in proportion to them and moves no text between machines.

Defined results: null texts are empty and have no secrets; offsets are code points, ends exclusive; weak parts that overlap
a base span are dropped and base spans always stay; repeated rows are each scanned; other columns are ignored or, when
redacting, kept, whatever their names; no rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns (fixed values): pattern, the group whose length counts, and the least length.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
_VALUE = "A-Za-z0-9+/_-"
#: The weak parts.
NAME = r"""(?i:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}"""
WEAK = (
    rf"""(?i:password|passwd|pwd|secret|pin)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{{4,11}}(?![A-Za-z0-9+/_.=-])"""
    rf"|(?<![{_VALUE}])(?=[{_VALUE}]*[0-9])(?=[{_VALUE}]*[a-z])(?=[{_VALUE}]*[A-Z])[{_VALUE}]{{20,}}"
)
ENDPOINT = r"""(?i:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[^\s"'<>]+|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.-]{3,}"""
BREAK = r"\n[\x20\t\r]*\n"

_SPANS = "array<struct<start:bigint,end:bigint>>"
#: Kinds in the order in which spans of one start are listed.
ORDER = ["assign", "access", "hex", "linked_name", "linked_secret", "linked_endpoint"]


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Code-point spans of the leftmost non-overlapping matches whose ``group`` has ``least`` characters or more."""
    p = F.lit(pattern)
    size = lambda x: F.length(x).cast("long")
    found = F.transform(F.regexp_extract_all(text, p, F.lit(0)), size)
    sized = F.transform(F.regexp_extract_all(text, p, F.lit(group)), size) if group else None
    gaps = F.transform(F.split(text, pattern, -1), size)
    # one gap more than there are matches, and its size is not asked for
    rows = F.filter(
        F.zip_with(F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"))), sized, lambda r, s: F.struct(r["g"].alias("g"), r["m"].alias("m"), s.alias("s")))
        if group
        else F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("g"), m.alias("m"), m.alias("s"))),
        lambda r: r["m"].isNotNull(),
    )

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["g"]
        span = F.array(F.struct(start.alias("start"), (start + r["m"]).alias("end")))
        return F.struct(
            (start + r["m"]).alias("at"),
            F.when(r["s"] >= least, F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    def stretch(acc: Column, part: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), F.array().cast(_SPANS).alias("out"))
        return F.aggregate(part, own, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_SPANS}>").alias("out"))
    whole = let(rows, lambda r: F.aggregate(stretches(r), first, stretch, lambda a: F.flatten(a["out"])))
    return F.when(text.rlike(pattern), whole).otherwise(F.array().cast(_SPANS))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a function over an array, a plain expression is computed for each element."""
    return F.transform(F.array(value), use)[0]


#: How many rows of a text a pass appends to one array before it starts another, so that appending stays cheap.
STRETCH = 256


def stretches(rows: Column) -> Column:
    """A bound array cut into arrays of at most ``STRETCH``; one empty array for an empty one."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(STRETCH)), lambda k: F.slice(rows, k + 1, F.lit(STRETCH)))


_PART = "struct<start:bigint,end:bigint,kind:int>"
#: Part kinds: break, weak name, base secret, weak secret, endpoint, access identifier.
_BREAK, _NAME, _BASE, _WEAK, _END, _ACCESS = range(6)


def _parts(spans_: Column, kind: int) -> Column:
    return F.transform(spans_, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def _pass(parts: str, forwards: bool, reach: int) -> str:
    """SQL for one pass: of each part, whether a name and a secret stand within reach behind it, and whether a base span overlaps it."""
    far = "cast(null as bigint)"
    gap = (lambda c: f"p.start - acc.{c} <= {reach}") if forwards else (lambda c: f"acc.{c} - p.`end` <= {reach}")
    mark = "p.`end`" if forwards else "p.start"
    wider = "greatest" if forwards else "least"
    over = "p.start < acc.b" if forwards else "acc.b < p.`end`"
    rows = parts  # a column: the parts, or the reversed parts
    keep = lambda c, kinds: f"case when p.kind = {_BREAK} then {far} when p.kind in ({kinds}) then {wider}(coalesce(acc.{c}, {mark}), {mark}) else acc.{c} end as {c}"
    base = f"case when p.kind in ({_BASE}, {_ACCESS}) then {wider}(coalesce(acc.b, {mark}), {mark}) else acc.b end as b"
    seen = f"struct(coalesce({gap('n')}, false) as n, coalesce({gap('s')}, false) as s, coalesce({over}, false) as b)"
    marks = "array<struct<n:boolean,s:boolean,b:boolean>>"
    cuts = f"transform(sequence(0, greatest(size({rows}) - 1, 0), {STRETCH}), k -> slice({rows}, k + 1, {STRETCH}))"
    inner = (
        f"aggregate(part, struct(whole.n as n, whole.s as s, whole.b as b, cast(array() as {marks}) as o), "
        f"(acc, p) -> struct({keep('n', f'{_NAME}, {_ACCESS}')}, {keep('s', f'{_BASE}, {_WEAK}')}, {base}, concat(acc.o, array({seen})) as o), "
        f"acc -> struct(acc.n as n, acc.s as s, acc.b as b, concat(whole.o, array(acc.o)) as o))"
    )
    out = f"aggregate({cuts}, struct({far} as n, {far} as s, {far} as b, cast(array() as array<{marks}>) as o), (whole, part) -> {inner}, whole -> flatten(whole.o))"
    return out if forwards else f"reverse({out})"


def _scanned(docs: DataFrame, reach: int) -> DataFrame:
    """(row, found): each row as a struct, so that no column of it can clash, and the spans of each kind; no shuffle."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(whole.alias("row"), text.alias("text"), F.struct(*[spans(text, *v).alias(k) for k, v in BASE.items()]).alias("_base"))
    text = F.col("text")
    named = (F.size("_base.access") > 0) | text.rlike(NAME)
    armed = (F.size("_base.assign") > 0) | (F.size("_base.hex") > 0) | text.rlike(WEAK)
    parts = F.array_sort(
        F.concat(
            _parts(spans(text, BREAK), _BREAK),
            _parts(spans(text, NAME), _NAME),
            _parts(F.col("_base.assign"), _BASE),
            _parts(F.col("_base.hex"), _BASE),
            _parts(spans(text, WEAK), _WEAK),
            _parts(spans(text, ENDPOINT), _END),
            _parts(F.col("_base.access"), _ACCESS),
        )
    )
    linked = base.withColumn("_parts", F.when(named & armed, parts).otherwise(F.array().cast(f"array<{_PART}>")))
    linked = linked.withColumn("_back", F.reverse("_parts"))
    seen = F.arrays_zip("_parts", F.expr(_pass("_parts", True, reach)).alias("f"), F.expr(_pass("_back", False, reach)).alias("w"))
    linked = linked.withColumn("_seen", seen)

    def reported(kind: int, needs) -> Column:
        chosen = F.filter(
            F.col("_seen"),
            lambda x: (x["_parts"]["kind"] == kind) & ~x["f"]["b"] & ~x["w"]["b"] & needs(x["f"]["n"] | x["w"]["n"], x["f"]["s"] | x["w"]["s"]),
        )
        return F.transform(chosen, lambda x: F.struct(x["_parts"]["start"].alias("start"), x["_parts"]["end"].alias("end")))

    found = F.struct(
        *[F.col(f"_base.{k}").alias(k) for k in BASE],
        reported(_NAME, lambda n, s: s).alias("linked_name"),
        reported(_WEAK, lambda n, s: n).alias("linked_secret"),
        reported(_END, lambda n, s: n & s).alias("linked_endpoint"),
    )
    return linked.select("row", found.alias("found"))


def scan(docs: DataFrame, reach: int = 400) -> DataFrame:
    """``docs`` with ``found``, a struct of the spans of each kind; an input column of that name gives way."""
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c != "found"]
    return _scanned(docs, reach).select(*kept, "found")


def _listed(kinds: list[str]) -> Column:
    """kind:start:end of all spans, by start and then by kind as listed."""

    def ranked(i: int, k: str) -> Column:
        return F.transform(F.col(f"found.{k}"), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("k"), s["end"].alias("end")))

    rows = [ranked(i, k) for i, k in enumerate(kinds)]
    names = F.array(*map(F.lit, kinds))
    return F.array_join(
        F.transform(
            F.array_sort(F.concat(*rows)),
            lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def report(docs: DataFrame, reach: int = 400) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    found = _scanned(docs.select("doc_id", "text"), reach)
    return found.select(
        "row.doc_id",
        *[F.size(f"found.{k}").cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(list(BASE)).cast("binary"), 256).alias("base_sha256"),
        _listed(ORDER).alias("spans"),
    )


def redact(docs: DataFrame, mark: str = "[SECRET]", reach: int = 400) -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; texts without secrets, and nulls, stay as they are."""
    found = _scanned(docs, reach)
    text = F.col("row.text")
    every = F.array_sort(F.concat(*[F.col(f"found.{k}") for k in ORDER]))

    empty = F.array().cast("array<string>")

    def step(piece: Column, base: Column):
        # places are looked up in the stretch's own piece, as finding one takes a walk from the beginning
        def of(acc: Column, s: Column) -> Column:
            gap = F.substring(piece, (acc["at"] - base).cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
            more = F.concat(acc["out"], F.array(gap, F.lit(mark)))
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], more).otherwise(acc["out"]).alias("out"))

        return of

    def stretch(acc: Column, part: Column) -> Column:
        reach_ = F.array_max(F.transform(part, lambda s: s["end"])) - acc["at"]
        joined = lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(a["out"], ""))).alias("out"))
        own = F.struct(acc["at"].alias("at"), empty.alias("out"))
        return let(F.substring(text, acc["at"].cast("int") + 1, reach_.cast("int")), lambda piece: F.aggregate(part, own, step(piece, acc["at"]), joined))

    first = F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out"))
    joined_up = lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"].cast("int") + 1, F.length(text)))
    whole = let(every, lambda spans_: F.when(F.size(spans_) > 0, F.aggregate(stretches(spans_), first, stretch, joined_up)))
    clean = F.coalesce(whole, text)
    return found.select(*[clean.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
