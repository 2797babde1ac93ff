"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A conversation becomes one formatted text of marked turns. Every assistant turn is an example of
its own: the text up to the end of the reply, of which only the reply is trainable. An example is
kept as two positions in the formatted text (``loss_start``, ``loss_end``), not as another copy of
all earlier turns, so the output grows with the conversations and not with the square of their
length; ``expand`` writes the copies out where a reader wants them.

Control strings inside a text are broken by a backslash and backslashes are doubled, so no text can
forge a marker and ``plain`` restores every text exactly. Positions are code points.

Turns are numbered and measured inside slices of ``SLICE`` turn numbers; the slices of a
conversation are then put in a row, so a conversation that holds a third of all rows is not ranked
by one task. Defined cases: null texts and roles are empty; rows are ordered by turn (null first),
role and text, and repeated rows stay; a conversation without an assistant has no example; a null id
is one conversation; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
CONTROL = ("<|", "</s>", "<s>", "<<", "[INST]", "[/INST]")
SLICE = 64


def marked(text: Column) -> Column:
    """Text in which no control string is left."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROL:
        text = F.replace(text, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return text


def plain(text: Column) -> Column:
    """The text that ``marked`` was given."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(conversations: DataFrame) -> DataFrame:
    """One row per turn: ``conv_id, position, role, segment, start, loss_start, loss_end, end``.

    ``start`` and ``end`` place the segment in the formatted conversation, ``loss_*`` the turn's own text.
    """
    turns = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    head = F.concat(F.lit(TURN), marked(F.col("role")), F.lit(TEXT))
    turns = turns.select("*", F.floor(F.col("turn") / SLICE).alias("slice"), F.concat(head, marked(F.col("text")), F.lit(END)).alias("segment"),
                         F.char_length(head).alias("head"))
    turns = turns.withColumn("chars", F.char_length("segment"))
    inside = Window.partitionBy("conv_id", "slice").orderBy("turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = turns.groupBy("conv_id", "slice").agg(F.count("*").alias("n"), F.sum("chars").alias("size"))
    totals = totals.select(F.col("conv_id").alias("c"), F.col("slice").alias("s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"),
                           F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    turns = turns.withColumns({"rank": F.row_number().over(inside),
                               "ends": F.sum("chars").over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    placed = turns.join(totals, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("slice").eqNullSafe(F.col("s")))
    end = F.col("base") + F.col("ends")
    return placed.select("conv_id", (F.col("earlier") + F.col("rank")).alias("position"), "role", "segment",
                         (end - F.col("chars")).alias("start"), (end - F.col("chars") + F.col("head")).alias("loss_start"),
                         (end - len(END)).alias("loss_end"), end.alias("end"))


def examples(parts: DataFrame, role: str = "assistant") -> DataFrame:
    """Every turn of ``role`` as an example: its place and the part of the formatted text that trains."""
    return parts.filter(F.col("role") == role).select("conv_id", "position", "loss_start", "loss_end")


def formatted(parts: DataFrame) -> DataFrame:
    """``conv_id`` and the whole formatted text."""
    rows = F.sort_array(F.collect_list(F.struct("position", "segment")))
    return parts.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["segment"]), "").alias("formatted"))


def expand(parts: DataFrame, role: str = "assistant") -> DataFrame:
    """Examples written out: all earlier turns and the reply in ``text``; only ``loss_start``..``loss_end`` trains."""
    chosen = examples(parts, role).withColumnRenamed("conv_id", "c")
    whole = formatted(parts)
    return chosen.join(whole, F.col("c").eqNullSafe(F.col("conv_id"))).select(
        "conv_id", "position", F.substring("formatted", F.lit(1), F.col("loss_end").cast("int")).alias("text"), "loss_start", "loss_end")


def read_back(parts: DataFrame) -> DataFrame:
    """Digests per conversation, parsed from the formatted text and from one row per example.

    Every example meets the formatted text of its conversation and keeps only its trainable part of it, so
    that no context is copied; the parts are then put in order again.
    """
    whole = formatted(parts)
    chosen = examples(parts).withColumnRenamed("conv_id", "c")
    reply = F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    replies = chosen.join(whole, F.col("c").eqNullSafe(F.col("conv_id"))).select("c", F.struct("position", plain(reply).alias("text")).alias("reply"))
    trained = replies.groupBy("c").agg(F.array_join(F.transform(F.array_sort(F.collect_list("reply")), lambda r: r["text"]), "").alias("trained"))
    pieces = F.slice(F.split("formatted", r"<\|end\|>\n"), 1, F.size(F.split("formatted", r"<\|end\|>\n")) - 1)
    read = whole.withColumn("turns", F.transform(pieces, lambda p: F.struct(
        plain(F.substring_index(F.substring(p, len(TURN) + 1, 2147483647), TEXT, 1)).alias("role"),
        plain(F.substring_index(p, TEXT, -1)).alias("text"))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.coalesce("trained", F.lit(""))
    return read.join(trained, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
