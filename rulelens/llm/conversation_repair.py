"""Conversation structure repair: a forward Viterbi pass over four grammar states for each conversation.

A repaired conversation is empty, or an optional system turn followed by pairs of a user and an assistant turn. Rows are edited
by Keep (free), Rerole to user or assistant (2), Delete (3, and the only choice for blank and duplicate rows) and Insert of an
empty user or assistant turn (2, anywhere); a truncated row that is not deleted adds 1. Of the cheapest edits those whose
initials make the least string in ASCII order are taken.

The states are: nothing yet, after the system turn, after a user turn, after an assistant turn. Each carries the least (cost,
audit string) that leads to it, and the digest of what is repaired so far. A turn's layer is closed by two rounds of insert
transitions, as a third insert in a row only leads back. The cost of a prefix is told by its audit string, so of two prefixes
of one state and equal cost neither continues the other: the smaller stays smaller whatever follows, and one for each state is
enough.

Rows go by conversation to one shuffle, are sorted there on disk if need be, and pass through the states one at a time: what is
held of a conversation is its audit string, whose beginning the states soon share, never its rows or texts. Earlier sightings
of a row are told by a window over the same shuffle. A conversation of very many rows is one sequential pass, in time
proportional to them, as its digest and its audit string are one value each; its rows are not collected.

Defined results: null roles and texts are a single space, as are nulls in the damage key; a null conv_id is a conversation of
its own; rows of equal turns go by role, then by digest of the text, null turns first; a conversation without rows after damage
has zeros, an empty audit and the digest of the empty string; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship

#: Costs of the edits, and of a truncated row that stays (fixed values).
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Length of audit strings from which their common beginning is kept apart.
LONGEST = 256
_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
#: For each state, the initial of the role that may follow and the state it leads to.
NEXT = {_EMPTY: {"s": _SYSTEM, "u": _USER}, _SYSTEM: {"u": _USER}, _USER: {"a": _ASSISTANT}, _ASSISTANT: {"u": _USER}}
ROLES = {"u": "user", "a": "assistant"}
_LEGAL = {"su", "ua", "au"}


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped): every row by the crc32 of its ``conv_id:turn`` modulo 20, dropped ones marked.

    0 drops a row, 1 empties its text, 2 takes out its ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(filled("conv_id"), F.lit(":"), filled("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    keyed = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return keyed.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """``rows(conv_id, turn, role, text, dropped)`` with ``fault``, the first of blank, duplicate and truncated that applies, or null.

    Rows are in one partition for each conversation and in order there, dropped ones first.
    """
    digest = F.sha2(F.col("text").cast("binary"), 256)
    order: list[Column] = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    seen = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    placed = rows.withColumn("digest", digest).repartition("conv_id").withColumn("sighting", F.row_number().over(seen))
    ends = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    fault = F.when(ends == "", "blank").when(F.col("sighting") > 1, "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    return placed.withColumn("fault", fault).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("dropped").desc(), *order, "sighting")


class Repair:
    """The pass over one conversation: rows in order, then ``close``."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.lowest = self.highest = self.turn = self.initial = None
        self.turns = 0
        #: What all states' audit strings begin with, kept apart from them, and how long they may be before it is looked for again.
        self.shared: list[str] = []
        self.longest = LONGEST
        #: For each reachable state: cost, the rest of the audit string, digest, and whether anything is in the digest.
        self.states: dict[int, tuple] = {_EMPTY: (0, "", hashlib.sha256(), False)}
        self._inserts()

    def add(self, turn: int | None, role: str, text: str, fault: str | None) -> None:
        if turn is not None and turn != self.turn:
            self.turns, self.turn = self.turns + 1, turn
            self.lowest = turn if self.lowest is None else self.lowest
            self.highest = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in _LEGAL:
            self.illegal += 1
        self.initial = initial
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        before, self.states = self.states, {}
        stays = fault not in ("blank", "duplicate")
        extra = TRUNCATED if fault == "truncated" else 0
        for state, (cost, audit, digest, some) in before.items():
            self._offer(state, cost + DELETE, audit + "D", digest, some, None)
            if stays:
                for letter, then in NEXT[state].items():
                    if letter == initial:
                        self._offer(then, cost + extra, audit + "K", digest, some, (role, text))
                    elif letter in ROLES:
                        self._offer(then, cost + extra + REROLE, audit + "R", digest, some, (ROLES[letter], text))
        self._settle()
        self._inserts()
        self._share()

    def _share(self) -> None:
        if max(len(x[1]) for x in self.states.values()) > self.longest:
            n = len(start := commonprefix([x[1] for x in self.states.values()]))
            self.shared.append(start)
            self.states = {k: (cost, audit[n:], *rest) for k, (cost, audit, *rest) in self.states.items()}
            self.longest = max(LONGEST, 2 * max(len(x[1]) for x in self.states.values()))

    def _offer(self, state: int, cost: int, audit: str, digest, some: bool, line: tuple[str, str] | None) -> None:
        held = self.states.get(state)
        if held is None or (cost, audit) < held[:2]:
            self.states[state] = (cost, audit, digest, some, line)

    def _settle(self) -> None:
        """Digests are made only for the offers that were taken."""
        for state, held in self.states.items():
            if len(held) == 5:
                cost, audit, digest, some, line = held
                if line is not None:
                    digest = digest.copy()
                    digest.update((("\n" if some else "") + f"{line[0]}:{line[1]}").encode("utf-8", "surrogatepass"))
                    some = True
                self.states[state] = (cost, audit, digest, some)

    def _inserts(self) -> None:
        for _ in range(2):
            for state, (cost, audit, digest, some) in list(self.states.items()):
                for letter, then in NEXT[state].items():
                    if letter in ROLES:
                        self._offer(then, cost + INSERT, audit + "I", digest, some, (ROLES[letter], ""))
            self._settle()

    def close(self) -> tuple:
        cost, audit, digest, _ = min((self.states[s] for s in (_EMPTY, _ASSISTANT) if s in self.states), key=lambda x: x[:2])
        gaps = 0 if self.lowest is None else self.highest - self.lowest + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join([*self.shared, audit]), digest.hexdigest()


_OUT = ["gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string"]
_ARROW = {"long": pa.int64(), "string": pa.string()}


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256 of every conversation of ``rows``."""
    ship(rows.sparkSession)
    names = ["conv", *[c.split()[0] for c in _OUT]]
    shape = pa.schema([(c, _ARROW[t]) for c, t in (x.split() for x in ["conv string", *_OUT])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, own = None, None
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "dropped", "fault")), strict=True):
                if own is None or row[0] != at:
                    if own is not None:
                        done.append((at, *own.close()))
                    at, own = row[0], Repair()
                if not row[4]:
                    own.add(row[1], row[2], row[3], row[5])
            yield flushed(done)
            done = []
        if own is not None:
            yield flushed([(at, *own.close())])

    def flushed(done: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], schema=shape)

    kind = rows.schema["conv_id"].dataType
    put = faulty(rows).select(F.col("conv_id").cast("string").alias("conv"), "turn", "role", "text", "dropped", "fault")
    found = put.mapInArrow(run, "conv string, " + ", ".join(_OUT))
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *names[1:])


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """What ``repair`` gives for ``conversations(conv_id, turn, role, text)`` after ``damage``."""
    return repair(damage(conversations))
