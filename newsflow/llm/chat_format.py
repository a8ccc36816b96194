"""Chat formatting: cumulative-snapshot collapse, then rendering.  DataFrame functions only.

A log that snapshots a conversation after every turn stores each prefix as a conversation of its own.
Per conversation a rolling 128-bit hash is kept over its turns: the XOR of position-salted turn
hashes, a running window aggregate, so no conversation is gathered to be hashed.  A conversation whose
last hash occurs at the same position inside a longer conversation is a snapshot of it and goes (an
anti-join on distinct prefix keys); of equal conversations the least ``conv_id`` stays.  What is left is rendered.

Defined cases: turns are ordered by (turn, role, text), nulls first, repeated rows are turns of their
own; a null role reads ``unknown``, a null text is empty; rows with a null ``conv_id`` belong to no
conversation and are left out; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The markers of the rendered form.
TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"


def turns_with_hashes(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, n_turns, h1, h2): h1, h2 hash the turns up to and with ``pos``."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    within = Window.partitionBy("conv_id")
    ordered = within.orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("pos", F.row_number().over(ordered))
    running = within.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    salted = rows.withColumn("x1", F.xxhash64(F.lit(1), "pos", "role", "text")).withColumn(
        "x2", F.xxhash64(F.lit(2), "text", "role", "pos"))
    return salted.select("conv_id", "pos", "role", "text",
                         F.max("pos").over(within.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n_turns"),
                         F.bit_xor("x1").over(running).alias("h1"), F.bit_xor("x2").over(running).alias("h2"))


def collapse_snapshots(turns: DataFrame) -> DataFrame:
    """The conversations that are no prefix of a longer one: (conv_id, n_turns, n_copies)."""
    finals = (turns.where("pos = n_turns").groupBy("pos", "h1", "h2")
              .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies")))
    prefixes = turns.where("pos < n_turns").select("pos", "h1", "h2").distinct()
    return finals.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(
        "conv_id", F.col("pos").cast("int").alias("n_turns"), "n_copies")


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END), F.lit("\n"))


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, n_copies, rendered) of the maximal conversations."""
    turns = turns_with_hashes(conversations)
    kept = collapse_snapshots(turns)
    lines = turns.select("conv_id", "pos", render_turn(F.col("role"), F.col("text")).alias("line")).join(kept, "conv_id")
    return lines.groupBy("conv_id", "n_turns", "n_copies").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "").alias("rendered"))
