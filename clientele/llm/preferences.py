"""Preference formatting: one prompt and two completions from a chosen and a rejected conversation.

The longest common prefix of both conversations' turns is rendered once as the prompt; what follows in
each becomes its completion.  A completion comes with the spans of its characters that a model is to
learn from: the texts of the trained role, up to the mark that ends the turn.  Everything is DataFrame
expressions; one shuffle brings the turns of a pair together.

Defined cases: turns go by number, those of one number by role and text; null roles and texts count as
empty, and equal each other; null pair ids take no part.  Equal conversations give a prompt and two empty
completions; a side without turns gives an empty prompt and an empty completion; empty tables give an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts around a turn: before the role, between role and text, and after the text.
OPEN, BETWEEN, CLOSE = "<|", "|>\n", "\n<|end|>\n"
TRAINED = "assistant"


def _turns(turns: DataFrame, pair: str, side: int) -> DataFrame:
    return turns.where(F.col(pair).isNotNull()).select(
        F.col(pair).alias("pair_id"),
        F.lit(side).alias("side"),
        F.struct(
            F.col("turn").cast("bigint").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("said"),
    )


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(BETWEEN), turn["text"], F.lit(CLOSE))


def _common(one: Column, two: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    equal = F.zip_with(
        one, two, lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    )
    first = F.array_position(equal, False)
    return F.when(first == 0, F.size(equal)).otherwise(first - 1).cast("int")


def _spans(turns: Column, trained: str) -> Column:
    """Half-open character spans of the trained texts, the closing mark included, in the joined rendering."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("spans"))
    mark = len(CLOSE.rstrip("\n"))

    def add(done: Column, turn: Column) -> Column:
        first = done["at"] + F.length(turn["role"]) + F.lit(len(OPEN) + len(BETWEEN))
        last = first + F.length(turn["text"])
        span = F.struct(first.alias("first"), (last + F.lit(mark)).alias("last"))
        return F.struct(
            (last + F.lit(len(CLOSE))).alias("at"),
            F.when(turn["role"] == trained, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, add, lambda done: done["spans"])


def format_preferences(
    chosen: DataFrame, rejected: DataFrame, pair: str = "conv_id", trained: str = TRAINED
) -> DataFrame:
    """One row per pair of conversations ``(pair, turn, role, text)``.

    Returns ``(pair_id, prompt_turns, prompt, chosen, rejected, chosen_spans, rejected_spans)``.
    """
    both = _turns(chosen, pair, 0).unionByName(_turns(rejected, pair, 1))
    # One sorted list per side; a conversation is one row of the result in any case.
    sides = both.groupBy("pair_id").agg(
        *[F.sort_array(F.collect_list(F.when(F.col("side") == side, F.col("said")))).alias(f"_{side}") for side in (0, 1)]
    )
    counted = sides.withColumn("prompt_turns", _common(F.col("_0"), F.col("_1")))

    def rest(side: int) -> Column:
        return F.slice(f"_{side}", F.col("prompt_turns") + 1, F.greatest(F.size(f"_{side}") - F.col("prompt_turns"), F.lit(0)))

    parted = counted.select(
        "pair_id", "prompt_turns", F.slice("_0", 1, F.col("prompt_turns")).alias("_prompt"),
        rest(0).alias("_chosen"), rest(1).alias("_rejected"),
    )
    return parted.select(
        "pair_id",
        "prompt_turns",
        *[F.array_join(F.transform(f"_{name}", _rendered), "").alias(name) for name in ("prompt", "chosen", "rejected")],
        *[_spans(F.col(f"_{name}"), trained).alias(f"{name}_spans") for name in ("chosen", "rejected")],
    )


def shortened_replies(turns: DataFrame, key: str = "conv_id", trained: str = TRAINED) -> DataFrame:
    """A rejected side for conversations that have none: from the middle on, replies break off half-way.

    The middle is the mean of the first and the last turn number of a conversation, rounded down.
    """
    middles = turns.groupBy(key).agg(F.floor((F.min("turn") + F.max("turn")) / 2).alias("_middle"))
    late = (F.col("turn") >= F.col("_middle")) & (F.col("role") == trained)
    half = F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    return turns.join(middles, key).withColumn("text", F.when(late, half).otherwise(F.col("text"))).drop("_middle")
