"""Date mentions against a version that looks at one match after the other, and roles of dates."""

import random
import re
from datetime import date

from pyspark.sql import functions as F
from rulelens.functions import dates

MONTHS = "january february march april may june july august september october november december".split()
NUMBER = {n: i + 1 for i, n in enumerate(MONTHS)} | {n[:3]: i + 1 for i, n in enumerate(MONTHS)} | {"sept": 9}


def plain(text):
    """Every candidate with its rank, then candidates by rank and place, each kept if it is free and a date."""
    some = "|".join(sorted(NUMBER, key=lambda n: -len(n)))
    forms = [
        rf"\b(?P<y>20[0-9]{{2}})-(?P<m>[0-9]{{1,2}})-(?P<d>[0-9]{{1,2}})\b",
        rf"(?i)\b(?P<d>[0-9]{{1,2}})(?:st|nd|rd|th)?\s+(?P<n>{some})\.?,?\s+(?P<y>20[0-9]{{2}})\b",
        rf"(?i)\b(?P<n>{some})\.?\s+(?P<d>[0-9]{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>20[0-9]{{2}})\b",
        rf"(?i)\b(?P<n>{some})\.?\s+(?P<y>20[0-9]{{2}})\b",
        r"\b(?P<a>[0-9]{1,2})/(?P<b>[0-9]{1,2})/(?P<y>20[0-9]{2})\b",
    ]
    free, out, two = [True] * len(text), [], False
    for rank, m in sorted(((r, m) for r, f in enumerate(forms) for m in re.finditer(f, text)), key=lambda x: (x[0], x[1].start())):
        g, span = m.groupdict(), range(*m.span())
        if not all(free[i] for i in span):
            continue
        if rank == 4:
            a, b = int(g["a"]), int(g["b"])
            if a <= 12 and b <= 12:
                two = True
                continue
            month, day = (b, a) if a > 12 else (a, b)
        else:
            month, day = (NUMBER[g["n"].lower()] if g.get("n") else int(g["m"])), int(g.get("d") or 1)
        try:
            value = date(int(g["y"]), month, day)
        except ValueError:
            continue
        for i in span:
            free[i] = False
        lead = re.search(r"\b(before|after|on|from)\s*$", text[max(0, m.start() - 18) : m.start()].lower())
        out.append((m.start(), m.end(), value, "month" if rank == 3 else "day", {"from": "on"}.get(lead[1], lead[1]) if lead else None))
    return sorted(out), two


def texts(n, seed):
    rng = random.Random(seed)
    day = lambda: rng.choice(["1", "3rd", "29", "30", "31", "02", "12th", "45"])
    name = lambda: rng.choice([*MONTHS, "Feb", "SEPT", "Mar", "May", "june"])
    year = lambda: rng.choice(["2024", "2026", "2000", "1999"])
    forms = [
        lambda: f"{year()}-{rng.randrange(1, 14)}-{rng.randrange(1, 33)}", lambda: f"{day()} {name()} {year()}", lambda: f"{name()}. {day()}, {year()}", lambda: f"{name()} {year()}",
        lambda: f"{rng.randrange(1, 32)}/{rng.randrange(1, 32)}/{year()}", lambda: rng.choice(["before ", "after", "on  ", "from\n", "x", ", ", " ", "§", "12 ", "é", "-", "/"]),
    ]
    return ["".join(rng.choice(forms)() + rng.choice(["", " ", " and "]) for _ in range(rng.randrange(1, 9))) for _ in range(n)]


def test_mentions_equal_a_plain_search(spark):
    cases = [*texts(2500, 6), "12 March 2026-05-01", "5 March 2026-03-01 May 2026", "30 February 2026", "5/5/2026", "31/31/2026 and 13/1/2026", "", "no date"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate([*cases, None])], "id int, t string, mentions string, other string")
    got = {r.id: ([tuple(m) for m in r.mentions], r.ambiguous) for r in dates.with_mentions(df, "t").collect()}
    assert got.pop(len(cases)) == ([], False)
    for i, t in enumerate(cases):
        assert got[i] == plain(t), t
    assert sum(len(m) > 1 for m, _ in got.values()) > 500 and any(a for _, a in got.values())
    assert dates.with_mentions(df.limit(0), "t").count() == 0


def test_long_texts_and_no_python(spark):
    text = " ".join(f"on {i % 28 + 1} May 2026, 2026-02-{i % 31 + 1:02d};" for i in range(4000))
    df = spark.createDataFrame([(text,)], "t string")
    out = dates.with_mentions(df, "t")
    assert [tuple(m) for m in out.first().mentions] == plain(text)[0]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()


def test_roles_by_nearness(spark):
    rows = [
        (1, "The determination was made on 2 March 2026, and the change occurred on 2026-02-20; they became aware 2026-02-25."),
        (2, "For a claim period from 1 February 2026 through 31 March 2026, what applies?"),
        (3, "determined 1 March 2026 or determined 2 March 2026"),
        (4, "determined on 5/5/2026"),
    ]
    q = spark.createDataFrame([(*r, None, None) for r in rows], "qid int, question string, given_change date, given_determination date")
    got = {r.qid: r for r in dates.date_context(q).collect()}
    assert (got[2].period_start, got[2].period_end) == (date(2026, 2, 1), date(2026, 3, 31))
    assert got[3].determination_date is None and got[4].ambiguous and got[4].mentions == []
    assert got[1].mentions[0].relation == "on" and len(got[1].mentions) == 3
    given = q.where("qid = 4").withColumn("given_change", F.lit("2026-05-05").cast("date"))
    assert dates.date_context(given).first().date_error == "ambiguous date beside a given one"
