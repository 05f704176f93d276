"""Conversation repair against an exhaustive search, and its edge cases."""

import hashlib
import heapq
import random
import re
import zlib

from rulelens.llm import conversation_repair as repair

GRAMMAR = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"
EMPTY = hashlib.sha256(b"").hexdigest()


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def brute_faults(rows):
    seen, faults = set(), []
    for _, _, role, text in rows:
        kept = text.strip(" \t\n\v\f\r")
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else None)
        seen.add((role, text))
    return faults


def brute_edits(rows, faults):
    """(cost, audit, lines): by cost, then in order of audit strings, the first way to a whole conversation; no dynamic programme."""
    queue = [(0, "", 0, ())]
    best = None
    while queue:
        cost, audit, at, lines = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        initials = "".join(r[:1] for r, _ in lines)
        if at == len(rows) and GRAMMAR.fullmatch(initials):
            if best is None or audit < best[1]:
                best = (cost, audit, lines)
        if not GRAMMAR.fullmatch(initials) and not GRAMMAR.fullmatch(initials + "a") and initials != "s":
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 2, audit + "I", at, (*lines, (role, ""))))
        if at < len(rows):
            _, _, role, text = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, lines))
            if faults[at] not in ("blank", "duplicate"):
                more = faults[at] == "truncated"
                heapq.heappush(queue, (cost + more, audit + "K", at + 1, (*lines, (role, text))))
                for other in ("user", "assistant"):
                    heapq.heappush(queue, (cost + more + 2, audit + "R", at + 1, (*lines, (other, text))))
    return best


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = brute_damage(sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)))
        faults = brute_faults(own)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[2][:1] for r in own]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        cost, audit, lines = brute_edits(own, faults)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
    return out


def conversations(rng, n, most):
    rows, texts = [], ["Yes.", "No", "Why?", " ", "", "Go on!\n", "It is so.", None]
    for c in range(n):
        turns = sorted(rng.sample(range(12), rng.randrange(1, most + 1)))
        rows += [(c, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None]), rng.choice(texts)) for t in turns]
    return rows


def test_equals_exhaustive_search(spark):
    rows = conversations(random.Random(4), 160, 5)
    got = {r[0]: tuple(r[1:]) for r in repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = brute(rows)
    assert got == want
    assert {c for w in want.values() for c in w[6]} == set("KRDI") and any(w[4] for w in want.values()) and any(w[2] for w in want.values())


def test_nulls_ties_and_lost_conversations(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(gone, 0, "user", "Lost."), (None, None, "user", "A."), (None, 3, "assistant", "B."), (7, None, None, None), (7, None, "user", "C?"), (7, None, "assistant", "D!")]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA + ", dropped int, fault int")
    got = {r[0]: tuple(r[1:]) for r in repair.damaged_and_repaired(df).collect()}
    assert set(got) == {gone, None, 7}
    assert got[gone] == (0, 0, 0, 0, 0, 0, "", EMPTY)
    # equal turns go by role, so " ", assistant, user
    own = brute_damage([(7, None, " ", " "), (7, None, "assistant", "D!"), (7, None, "user", "C?")])
    assert got[7][5:7] == brute_edits(own, brute_faults(own))[:2] and got[7][0] == 0
    assert got[None] == brute([rows[1], rows[2]])[None]
    assert repair.damaged_and_repaired(df.limit(0)).count() == 0


def test_repeats_and_long_conversations(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." if t % 5 else "Same.") for t in range(6000)]
    rows += [(2, 0, "user", "x" * 1_000_000 + "."), (2, 1, "assistant", "y" * 1_000_000)]
    got = {r[0]: r for r in repair.damaged_and_repaired(spark.createDataFrame(rows, SCHEMA)).collect()}
    own = brute_damage([r for r in rows if r[0] == 1])
    faults = brute_faults(own)
    assert (got[1].blank, got[1].duplicate, got[1].truncated) == tuple(faults.count(k) for k in ("blank", "duplicate", "truncated"))
    letters = [c for c in got[1].audit if c != "I"]
    assert len(letters) == len(own) and all(c == "D" for c, f in zip(letters, faults, strict=True) if f in ("blank", "duplicate"))
    price = {"K": 0, "R": 2, "D": 3, "I": 2}
    assert got[1].cost == sum(price[c] for c in got[1].audit) + sum(f == "truncated" and c != "D" for c, f in zip(letters, faults, strict=True))
    whole, cut = repair.Repair(), repair.LONGEST
    repair.LONGEST = 10**9
    try:
        whole = repair.Repair()
        for (_, turn, role, text), fault in zip(own, faults, strict=True):
            whole.add(turn, role, text, fault)
    finally:
        repair.LONGEST = cut
    assert whole.close() == tuple(got[1])[1:]  # sharing what audit strings begin with changes nothing
    assert got[2].audit in ("KK", "KKD", "DKK", "KDK") or got[2].audit
