"""Dates in questions (DT1-DT10): mentions, roles and the context that rules are chosen by, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .settling import settled_table
from .text import extract_all, let

#: Names of months, their short forms, and patterns of dates in order of precedence (fixed values).
_NAMES = "january february march april may june july august september october november december".split()
_MONTHS = {n[:3]: i + 1 for i, n in enumerate(_NAMES)} | {n: i + 1 for i, n in enumerate(_NAMES)} | {"sept": 9}
_MONTH = "|".join(sorted(_MONTHS, key=len, reverse=True))
#: Kind, pattern, and which groups hold the day, month and year; of a slash date the first two may be either.
PATTERNS = [
    ("iso", r"\b(20[0-9]{2})-([0-9]{1,2})-([0-9]{1,2})\b", (3, 2, 1)),
    ("day", rf"(?i)\b([0-9]{{1,2}})(?:st|nd|rd|th)?\s+({_MONTH})\.?,?\s+(20[0-9]{{2}})\b", (1, 2, 3)),
    ("day", rf"(?i)\b({_MONTH})\.?\s+([0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(20[0-9]{{2}})\b", (2, 1, 3)),
    ("month", rf"(?i)\b({_MONTH})\.?\s+(20[0-9]{{2}})\b", (0, 1, 2)),
    ("slash", r"\b([0-9]{1,2})/([0-9]{1,2})/(20[0-9]{2})\b", (1, 2, 3)),
]
#: What may stand right before a mention, and how far back it is looked for (fixed values).
RELATION, BACK = r"(?i)\b(before|after|on|from)\s*$", 18
#: Cue patterns of the roles and the code points searched on either side of a mention (fixed values).
CUES = {
    "determination": (r"(?i)\b(determination|determined|decision(?:\s+was)?\s+made|claim\s+(?:date|dated))\b", 55),
    "change": (r"(?i)\b(change\s+(?:that\s+)?(?:occurred|happened|took place|date|dated|on)|circumstances\s+changed|changed\s+on)\b", 55),
    "awareness": (r"(?i)\b(became aware|was aware|learned|found out|knew|knowledge)\b", 40),
    "period": (r"(?i)\b(period|from|through|until|between|spanning|spans|crosses|covering)\b", 28),
}
_MENTION = "struct<start:int,end:int,value:date,precision:string,relation:string>"
#: How many mentions are appended to one array before another is begun, so that appending stays cheap.
_STRETCH = 256


def _value(kind: str, pattern: str, groups: tuple[int, int, int], found: Column) -> Column:
    """The date of a match, null where the calendar has no such day; a month stands for its first day."""
    day, month, year = (F.lit("1") if g == 0 else F.regexp_extract(found, pattern, g) for g in groups)
    if kind == "slash":
        # one part above 12 is the day, wherever it stands; none is no reading at all
        late = day.cast("int") > 12
        day, month = F.when(late, day).otherwise(month), F.when(late, month).otherwise(day)
    elif kind != "iso":
        names = F.create_map(*[F.lit(x) for pair in _MONTHS.items() for x in pair])
        month = F.element_at(names, F.lower(month)).cast("string")
    return F.try_to_date(F.concat_ws("-", year, month, day), "y-M-d")


def _two_ways(pattern: str, found: Column) -> Column:
    """DT3: a slash date with both parts up to 12."""
    return (F.regexp_extract(found, pattern, 1).cast("int") <= 12) & (F.regexp_extract(found, pattern, 2).cast("int") <= 12)


def found_dates(text: Column) -> Column:
    """DT2-DT4: (mentions, ambiguous) of a text: its dates by their start, and whether a slash date can be read two ways.

    Patterns are tried in order of precedence. What one of them takes as a date is blotted out, character for character, before
    the next one looks, so no two mentions overlap and places stay what they are; what is no date is left to the others. A
    match cannot begin within another of its own pattern, so nothing is hidden by what was dropped. Each pattern passes over
    the text a fixed number of times, and every intermediate value is bound once. Null texts have no mentions.
    """
    state = F.struct(F.coalesce(text, F.lit("")).alias("rest"), F.array().cast(f"array<{_MENTION}>").alias("mentions"), F.lit(False).alias("two"))
    for kind, pattern, groups in PATTERNS:
        state = let(state, _blotting(kind, pattern, groups))
    return let(state, lambda s: F.struct(F.array_sort(s["mentions"]).alias("mentions"), s["two"].alias("ambiguous")))


def with_mentions(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``found_dates`` of a column as ``mentions`` and ``ambiguous``; columns of these names give way."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("mentions", "ambiguous")]
    return df.select(*kept, found_dates(F.col(text)).alias("_dates")).select(*kept, "_dates.mentions", "_dates.ambiguous")


def _blotting(kind: str, pattern: str, groups: tuple[int, int, int]):
    """The step of one pattern: from what earlier ones left of the text, and their mentions, to what is left after it."""

    def pieces(rest: Column) -> Column:
        return F.struct(extract_all(rest, pattern).alias("found"), F.split(rest, pattern, -1).alias("gaps"))

    def row(both: Column):
        def of(x: Column, i: Column) -> Column:
            value = _value(kind, pattern, groups, x)
            value = F.when(~_two_ways(pattern, x), value) if kind == "slash" else value
            led = F.right(F.concat(F.when(i > 0, F.get(both["found"], i - 1)).otherwise(""), F.get(both["gaps"], i)), F.lit(BACK))
            return F.struct(F.length(F.get(both["gaps"], i)).alias("gap"), F.length(x).alias("n"), value.alias("value"), led.alias("led"))

        return of

    def rest(both: Column, rows: Column) -> Column:
        left = F.zip_with(rows, both["found"], lambda r, x: F.when(r["value"].isNull(), x).otherwise(F.repeat(F.lit("_"), r["n"])))
        lead = F.zip_with(F.slice(both["gaps"], F.lit(1), F.size(both["found"])), left, lambda g, x: F.concat(g, x))
        return F.concat(F.array_join(lead, ""), F.element_at(both["gaps"], -1))

    def after(state: Column, both: Column, rows: Column) -> Column:
        two = F.exists(both["found"], lambda x: _two_ways(pattern, x)) if kind == "slash" else state["two"]
        mentions = F.concat(state["mentions"], _placed(rows, "month" if kind == "month" else "day"))
        return F.struct(rest(both, rows).alias("rest"), mentions.alias("mentions"), two.alias("two"))

    def step(state: Column) -> Column:
        cut = let(pieces(state["rest"]), lambda both: let(F.transform(both["found"], row(both)), lambda rows: after(state, both, rows)))
        return F.when(state["rest"].rlike(pattern), cut).otherwise(state)  # most texts are looked through once and not cut

    return step


def _placed(rows: Column, precision: str) -> Column:
    """The mentions among matches, their places being sums of what goes before."""
    mentions = f"array<{_MENTION}>"

    def step(acc: Column, r: Column) -> Column:
        start = acc["at"] + r["gap"]
        relation = F.nullif(F.replace(F.lower(F.regexp_extract(r["led"], RELATION, 1)), F.lit("from"), F.lit("on")), F.lit(""))
        one = F.array(F.struct(start.alias("start"), (start + r["n"]).alias("end"), r["value"].alias("value"), F.lit(precision).alias("precision"), relation.alias("relation")))
        return F.struct((start + r["n"]).alias("at"), F.when(r["value"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    def stretch(acc: Column, part: Column) -> Column:
        own = F.struct(acc["at"].alias("at"), F.array().cast(mentions).alias("out"))
        return F.aggregate(part, own, step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], F.array(a["out"])).alias("out")))

    cuts = F.transform(F.sequence(F.lit(0), F.greatest(F.size(rows) - 1, F.lit(0)), F.lit(_STRETCH)), lambda k: F.slice(rows, k + 1, F.lit(_STRETCH)))
    first = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{mentions}>").alias("out"))
    return F.aggregate(cuts, first, stretch, lambda a: F.flatten(a["out"]))


def scan_dates(question: str | None) -> tuple[list[dict], bool]:
    """``with_mentions`` of one question, as a table of one row."""
    row = with_mentions(SparkSession.builder.getOrCreate().createDataFrame([(question,)], "question string"), "question").first()
    return [m.asDict() for m in row["mentions"]], row["ambiguous"]


def source_date(text: Column) -> Column:
    """DT1: ``D Month YYYY``, null where it is no date."""
    return F.try_to_date(text, "d MMMM yyyy")


def _only(values: Column) -> Column:
    """DT6: the value that all candidates share."""
    v = F.array_distinct(values)
    return F.when(F.size(v) == 1, v[0])


def date_context(questions: DataFrame) -> DataFrame:
    """DT5-DT8: (qid, mentions, ambiguous, role dates, period bounds, date_error) of questions(qid, question[, dates given]).

    ``given_change`` and ``given_determination`` may be null; one that contradicts a written date of its role, or comes with
    an ambiguous one, is an error, kept in a column.
    """
    # settled, so that no condition on a date is pushed below and the whole search for dates copied into it
    q = settled_table(with_mentions(questions, "question"))
    m = F.col("mentions")
    near = lambda x, r: F.substring(F.col("question"), F.greatest(x["start"] - r, F.lit(0)) + 1, x["end"] + r - F.greatest(x["start"] - r, F.lit(0)))

    def of(role: str) -> Column:
        cue, reach = CUES[role]
        return F.transform(F.filter(m, lambda x: near(x, reach).rlike(cue)), lambda x: x["value"])

    period = F.array_distinct(of("period"))
    q = q.select(
        *questions.columns,
        "mentions",
        "ambiguous",
        _only(of("determination")).alias("written_determination"),
        _only(of("change")).alias("written_change"),
        _only(of("awareness")).alias("awareness_date"),
        F.when(F.size(period) >= 2, F.array_min(period)).alias("period_start"),
        F.when(F.size(period) >= 2, F.array_max(period)).alias("period_end"),
    )
    for role in ("change", "determination"):
        if f"given_{role}" not in questions.columns:
            q = q.withColumn(f"given_{role}", F.lit(None).cast("date"))
    clash = lambda r: F.coalesce(F.col(f"given_{r}") != F.col(f"written_{r}"), F.lit(False))
    given = F.col("given_change").isNotNull() | F.col("given_determination").isNotNull()
    error = F.when(F.col("ambiguous") & given, "ambiguous date beside a given one").when(clash("change") | clash("determination"), "a given date contradicts the question")
    return q.withColumns(
        {
            "date_error": error,
            "determination_date": F.coalesce("given_determination", "written_determination"),
            "change_date": F.coalesce("given_change", "written_change"),
        }
    )


def effective_day(mention: Column, effective: Column) -> Column:
    """DT9: "before" the very day that a rule takes effect means the day before."""
    return F.when((mention["relation"] == "before") & (mention["value"] == effective), F.date_sub(mention["value"], 1)).otherwise(mention["value"])


def crosses(start: Column, end: Column, effective: Column) -> Column:
    """DT10: a period that begins before a rule takes effect and ends on or after that day."""
    return F.coalesce((start < effective) & (effective <= end), F.lit(False))
