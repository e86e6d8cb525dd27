"""Chat formatting from the view of every participant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
SYSTEM = "system"
UNNAMED = "unknown"
BLOCK = 1024  # turn numbers a block


def rendered(head: Column, text: Column) -> Column:
    """One turn between its marks; marks inside the text are broken by a blank."""
    plain = F.replace(F.replace(text, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    return F.concat(F.lit(OPEN), head, F.lit("\n"), plain, F.lit(CLOSE + "\n"))


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text") -> DataFrame:
    """``conv_id``, ``assistant``, ``turn``, ``speaker``, ``piece``, ``start``, ``end``, ``trained``.

    A dialogue is rendered once for each of its participants, who speaks as the assistant while the
    others are named users; system turns stay what they are and are no participant. Each row is one
    turn of one such rendering: its text and the code points it takes in the whole, where ``piece`` of
    all rows in order is the rendering and ``trained`` tells whether the loss counts it. Renderings
    stay in turns, so no dialogue has to fit into one row.

    Turns are ordered by number, speaker and text (nulls first; equal rows are each rendered).
    Offsets are summed in blocks of turn numbers and then over blocks, so a long dialogue is no single
    task. A null text is empty, a null speaker is ``unknown``; rows with a null conversation belong to
    no dialogue, and a dialogue of system turns has no view: both give no rows, as do empty tables.
    """
    rows = turns.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit(UNNAMED)).alias("speaker"),
        F.coalesce(F.col(text), F.lit("")).alias("text"))
    views = rows.where(F.col("speaker") != SYSTEM).select("conv_id", F.col("speaker").alias("assistant")).distinct()
    own = F.col("speaker") == F.col("assistant")
    head = F.when(F.col("speaker") == SYSTEM, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), F.col("speaker")))
    seen = rows.join(views, "conv_id").select("conv_id", "assistant", "turn", "speaker", "text", rendered(head, F.col("text")).alias("piece"), own.alias("trained"))
    seen = seen.withColumn("block", F.floor(F.col("turn") / BLOCK)).withColumn("size", F.length("piece").cast("long"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = seen.groupBy("conv_id", "assistant", "block").agg(F.sum("size").alias("block_size"))
    sums = sums.withColumn("base", F.coalesce(F.sum("block_size").over(before(Window.partitionBy("conv_id", "assistant").orderBy("block"))), F.lit(0)))
    sums = sums.select("conv_id", "assistant", F.coalesce("block", F.lit(-(2**62))).alias("block"), "base")
    placed = seen.withColumn("block", F.coalesce("block", F.lit(-(2**62)))).join(sums, ["conv_id", "assistant", "block"])
    inside = before(Window.partitionBy("conv_id", "assistant", "block").orderBy("turn", "speaker", "text"))
    start = F.col("base") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return placed.select("conv_id", "assistant", "turn", "speaker", "piece", start.alias("start"), (start + F.col("size")).alias("end"), "trained")
