"""Multi-party perspective rotation of dialogues, with DataFrame functions only.

For every participant of a conversation the dialogue is rendered once: that speaker is the assistant, every
other speaker a user with a name, system turns stay system turns. A mask holds the character ranges that
the assistant has to learn: its turns' text with the closing mark.

A dialogue is rendered in blocks of ``BLOCK_TURNS`` turn numbers, so that no group grows with a
conversation; the blocks of one perspective, in order, make up the whole text. The usual dialogue is one
block.

Defined results: a null text is an empty turn; a null or blank role speaks as ``unknown``; a null turn
number comes first; turns of equal number follow in order of role and text; rows that repeat stay; a conversation of
system turns only has no perspective; a null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_TURNS = 64
SYSTEM = "system"
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _rendered(turns: Column, speaker: Column) -> Column:
    """Struct of ``at`` (length so far), ``text`` and ``spans`` over the sorted turns."""

    def step(done: Column, turn: Column) -> Column:
        own = turn["role"] == speaker
        head = F.concat(
            F.lit(OPEN),
            F.when(own, "assistant").when(turn["role"] == SYSTEM, SYSTEM).otherwise(F.concat(F.lit("user name="), turn["role"])),
            F.lit("\n"),
        )
        body = F.concat(turn["text"], F.lit(CLOSE))
        begin = done["at"] + F.length(head)
        end = begin + F.length(body)
        return F.struct(
            (end + 1).alias("at"),
            F.concat(done["parts"], F.array(F.concat(head, body, F.lit("\n")))).alias("parts"),
            F.when(own, F.concat(done["spans"], F.array(F.struct(begin.alias("begin"), end.alias("end"))))).otherwise(done["spans"]).alias("spans"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.array().cast("array<string>").alias("parts"),
        F.array().cast("array<struct<begin:int,end:int>>").alias("spans"),
    )
    return F.aggregate(turns, start, step, lambda done: F.struct(F.array_join(done["parts"], "").alias("text"), done["spans"].alias("spans")))


def rotate(conversations: DataFrame) -> DataFrame:
    """``conv_id, speaker, block, n_turns, text, mask``: a row per perspective and block of turns.

    ``mask`` is an array of ``begin, end`` in characters of ``text``, end exclusive.
    """
    turn = F.col("turn").cast("long")
    turns = conversations.select(
        # Two plain keys instead of one that may be null: then the join needs no other partitioning than the grouping.
        F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv"),
        F.col("conv_id").isNull().alias("nameless"),
        F.coalesce(F.floor(turn / BLOCK_TURNS), F.lit(-(2**62))).cast("long").alias("block"),
        turn.alias("turn"),
        F.coalesce(F.nullif(F.trim(F.col("role").cast("string")), F.lit("")), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    conversation = ["conv", "nameless"]
    speakers = turns.filter(F.col("role") != SYSTEM).select(*conversation, F.col("role").alias("speaker")).distinct()
    # Ids only: which perspectives a block needs. The turns themselves are shuffled once, by block.
    wanted = turns.select(*conversation, "block").distinct().join(speakers, conversation)
    gathered = turns.groupBy(*conversation, "block").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    joined = gathered.join(wanted, [*conversation, "block"])
    made = joined.withColumn("made", _rendered(F.col("turns"), F.col("speaker")))
    return made.select(
        F.when(~F.col("nameless"), F.col("conv")).alias("conv_id"),
        "speaker",
        F.when(F.col("block") != -(2**62), F.col("block")).alias("block"),
        F.size("turns").cast("long").alias("n_turns"),
        F.col("made.text").alias("text"),
        F.col("made.spans").alias("mask"),
    )
