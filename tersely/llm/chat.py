"""Chat formatting with perspective rotation.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users. The mask lists the parts to learn from:
the assistant's texts, each with its closing mark.

A conversation may be of any length, so it is rendered in blocks of ``turns`` turn
numbers; an ordinary conversation is one block. Where a text of a turn begins in its own
speaker's rendering follows from two running sums over the block (all lengths, and the
speaker's own turns), so offsets are known before the turns are gathered.

A null role is the speaker ``unknown``; a null text is empty; turns without a number
come first, in a block of their own; turns with equal numbers are ordered by role and
text. Repeated rows are repeated turns. Rows without a conversation id form one
conversation. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the rendering (fixed values).
ASSISTANT, USER, NAMED, CLOSE = "<|assistant|>\n", "<|user|>", "\n", "<|end|>\n"
UNKNOWN = "unknown"


def perspectives(conversations: DataFrame, turns: int = 256) -> DataFrame:
    """conv_id, block, speaker, n_turns, text, mask (array of start, end in code points of text)."""
    conversation = F.col("conv_id")
    rows = conversations.select(
        conversation.alias("conv_id"),
        F.floor(F.col("turn") / turns).cast("long").alias("block"),
        "turn",
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    speakers = rows.select(F.col("conv_id").alias("of"), F.col("role").alias("speaker")).distinct()
    named = F.length("text") + F.length("role") + len(USER) + 1 + len(NAMED) + len(CLOSE)
    shorter = F.length("role") + len(USER) + 1 + len(NAMED) - len(ASSISTANT)
    block = Window.partitionBy("conv_id", "block")
    numbered = rows.withColumn("at", F.row_number().over(block.orderBy("turn", "role", "text")))
    before = block.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "block", "role").orderBy("at")
    so_far = F.coalesce(F.sum(named).over(before), F.lit(0))
    start = so_far - (F.row_number().over(own) - 1) * shorter + len(ASSISTANT)
    placed = numbered.withColumn("start", start.cast("long"))
    blocks = placed.groupBy("conv_id", "block").agg(
        F.sort_array(F.collect_list(F.struct("at", "role", "text", "start"))).alias("turns")
    )
    line = F.transform(
        "turns",
        lambda t: F.concat(
            F.when(t["role"] == F.col("speaker"), F.lit(ASSISTANT)).otherwise(
                F.concat(F.lit(f"{USER} "), t["role"], F.lit(NAMED))
            ),
            t["text"],
            F.lit(CLOSE),
        ),
    )
    spoken = F.filter("turns", lambda t: t["role"] == F.col("speaker"))
    mask = F.transform(
        spoken,
        lambda t: F.struct(
            t["start"].alias("start"),
            (t["start"] + F.length(t["text"]) + len(CLOSE)).alias("end"),
        ),
    )
    return blocks.join(speakers, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id",
        "block",
        "speaker",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(line, "").alias("text"),
        mask.alias("mask"),
    )
