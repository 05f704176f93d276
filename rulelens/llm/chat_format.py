"""Preference formatting: the common turns of a chosen and a rejected conversation once, then two masked completions.

Turns are compared as (role, text). The longest common prefix is rendered as the prompt; what follows of either conversation
is its completion, with the code-point spans that a loss counts: the text and end mark of assistant turns, nothing else.
Each turn is rendered as ``<|im_start|>role``, its text, ``<|im_end|>``; marks that occur inside texts are defused.

Defined results: null roles and texts are empty; a turn that is repeated as a whole counts once, and turns of one number go by
role and text; equal conversations have empty completions and are marked by ``differs``, which is false only for them, since
they teach no preference; a conversation that is a prefix of the other has one empty completion; rows
without a conversation id belong to none and are left out; other columns are ignored; no rows give no rows. A pair is one
row of the result, so it is gathered into one row, and nothing larger ever is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns) of rows(conv_id, turn, role, text), turns in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        rows.where("conv_id is not null")
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_set(turn)).alias("t"))
        .select("conv_id", F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def common_turns(a: Column, b: Column) -> Column:
    """The number of leading turns that two conversations share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first.cast("int") - 1)


def _defused(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("< |im_"))


def rendered(turns: Column) -> Column:
    head = lambda t: F.concat(F.lit(START), _defused(t["role"]), F.lit("\n"), _defused(t["text"]), F.lit(END + "\n"))
    return F.array_join(F.transform(turns, head), "")


def loss_spans(turns: Column) -> Column:
    """start:end of the assistant's text and end mark in a rendered completion, comma-joined."""

    def step(acc: Column, t: Column) -> Column:
        before = F.lit(len(START) + 1) + F.length(_defused(t["role"]))
        start = acc["at"] + before
        stop = start + F.length(_defused(t["text"])) + len(END)
        span = F.array(F.concat_ws(":", start.cast("string"), stop.cast("string")))
        return F.struct(
            (stop + 1).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(turns, first, step, lambda a: F.array_join(a["out"], ","))


def format_pairs(pairs: DataFrame, key: str = "conv_id") -> DataFrame:
    """The emitted pair of each row of pairs(key, chosen, rejected), both arrays of (role, text)."""
    p = pairs.select(F.col(key).alias("key"), "chosen", "rejected", common_turns(F.col("chosen"), F.col("rejected")).alias("n"))
    rest = lambda c: F.slice(F.col(c), F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    p = p.withColumns({"_c": rest("chosen"), "_r": rest("rejected")})
    return p.select(
        F.col("key").alias(key),
        F.col("n").cast("long").alias("n_common"),
        F.size("_c").cast("long").alias("n_chosen"),
        F.size("_r").cast("long").alias("n_rejected"),
        rendered(F.slice("chosen", F.lit(1), F.col("n"))).alias("prompt"),
        rendered(F.col("_c")).alias("chosen"),
        rendered(F.col("_r")).alias("rejected"),
        loss_spans(F.col("_c")).alias("chosen_loss"),
        loss_spans(F.col("_r")).alias("rejected_loss"),
        ((F.size("_c") > 0) | (F.size("_r") > 0)).alias("differs"),
    )


def stale_reply(turns: Column) -> Column:
    """A rejected variant: the last assistant turn says again what the assistant said before it, or nothing."""
    last = F.size(turns) - F.array_position(F.reverse(F.transform(turns, lambda t: t["role"] == "assistant")), True).cast("int")
    said = F.transform(F.filter(F.slice(turns, F.lit(1), F.greatest(last, F.lit(0))), lambda t: t["role"] == "assistant"), lambda t: t["text"])
    earlier = F.coalesce(F.get(said, F.size(said) - 1), F.lit(""))
    swapped = F.transform(turns, lambda t, i: F.struct(t["role"].alias("role"), F.when(i == last, earlier).otherwise(t["text"]).alias("text")))
    return F.when(F.exists(turns, lambda t: t["role"] == "assistant"), swapped).otherwise(turns)


def stale_reply_pairs(rows: DataFrame) -> DataFrame:
    """Preference pairs of every conversation against the variant whose last reply is stale."""
    whole = conversations(rows)
    return format_pairs(whole.select("conv_id", F.col("turns").alias("chosen"), stale_reply(F.col("turns")).alias("rejected")))
