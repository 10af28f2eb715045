"""Preference formatting: pairs of conversations as one prompt and two masked completions.

The prompt is the longest common prefix of turns (role and text) of the chosen and the rejected conversation, rendered
once; each side's remaining turns are its completion. A completion's mask lists the spans, as character offsets in it,
that count in a loss: the bodies of assistant turns with their end marks. The rest of a completion is masked.

A conversation becomes one row of its turns in order, so what meets in a task is one pair of conversations; all of it is
built-in expressions.

Defined cases: null roles and texts count as empty; a pair that lacks a side has no common prefix and an empty
completion there; turns of one number are ordered by role and text; turns of a null pair are left out; a common prefix
may be all of one side, whose completion is then empty; turns repeated in one conversation all count; an empty table
gives an empty table; a conversation of any length is one row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END_MARK = "<|end|>\n"


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit(END_MARK))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t))), "")


def mask(turns: Column, learned: str = "assistant") -> Column:
    """array<struct<start, end>>: where the bodies of the learned role stand in render(turns)."""
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        first = state["at"] + F.length(_head(turn))
        last = first + F.length(_body(turn))
        span = F.array(F.struct(first.alias("start"), last.alias("end")))
        return F.struct(last.alias("at"), F.when(turn["role"] == learned, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda s: s["spans"])


def format_preferences(turns: DataFrame, pair_col: str, chosen_col: str, turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: str = "assistant") -> DataFrame:
    """Per pair: pair_col, prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask."""
    empty = F.lit("")
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text"))
    side = lambda on: F.array_sort(F.collect_list(F.when(on, turn)))
    pairs = (
        turns.where(F.col(pair_col).isNotNull())
        .groupBy(pair_col)
        .agg(side(F.col(chosen_col)).alias("a"), side(~F.col(chosen_col)).alias("b"))
    )
    shared = F.least(F.size("a"), F.size("b"))
    same = F.transform(
        F.slice(F.arrays_zip("a", "b"), F.lit(1), shared),
        lambda z: (z["a"]["role"] == z["b"]["role"]) & (z["a"]["text"] == z["b"]["text"]),
    )
    differ = F.array_position(same, False)
    pairs = pairs.withColumn("prompt_turns", F.when(differ > 0, differ - 1).otherwise(shared).cast("long"))
    first = F.col("prompt_turns").cast("int")
    rest = lambda c: F.slice(c, first + 1, F.size(c))
    return pairs.select(
        pair_col,
        "prompt_turns",
        render(F.slice("a", F.lit(1), first)).alias("prompt"),
        render(rest("a")).alias("chosen"),
        render(rest("b")).alias("rejected"),
        mask(rest("a"), learned).alias("chosen_mask"),
        mask(rest("b"), learned).alias("rejected_mask"),
    )
