"""Chat formatting with DataFrame expressions only.

One string per conversation.  Adjacent turns of one role share a block; every turn keeps its own segment, so the output
can be read back turn by turn:

    <|role|>user<|text|>first<|next|>second<|end|>\\n<|role|>assistant<|text|>...<|end|>\\n

In roles and texts, each ``<``, backslashes, ``|`` gets one backslash more, so a marker never occurs inside a text and
unescaping takes that one backslash away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def format_chats(turns: DataFrame, block: int = 256) -> DataFrame:
    """(conv_id, formatted) from rows (conv_id, turn, role, text).

    Turns sort by turn, then role, then text; a null turn comes first; null roles and texts are empty; a null conv_id is a
    conversation of its own; repeated rows are repeated turns; other columns are ignored; no rows give no rows.  Turns are
    first gathered in spans of ``block`` turn numbers and the spans then joined, so that the rows of a very long
    conversation meet as a few arrays.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    span = F.floor(F.coalesce("turn", F.lit(-1)) / block)
    spans = turns.select("conv_id", span.alias("span"), F.struct(F.col("turn"), role.alias("role"), text.alias("text")).alias("t")).groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("t")).alias("part"))
    whole = spans.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("span", "part"))).alias("spans")).select("conv_id", F.flatten("spans.part").alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        same = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == t["role"])
        opening = F.concat(F.when(i > 0, "<|end|>\n").otherwise(""), F.lit("<|role|>"), escape(t["role"]), F.lit("<|text|>"))
        return F.concat(F.when(same, "<|next|>").otherwise(opening), escape(t["text"]))

    return whole.select("conv_id", F.concat(F.array_join(F.transform("turns", piece), ""), F.lit("<|end|>\n")).alias("formatted"))


def read_chats(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns): the turns as array<struct<role, text, loss>>, read back from ``formatted``.

    ``loss`` marks what the loss mask covers: the segments of the assistant's blocks.
    """
    blocks = F.filter(F.split("formatted", r"<\|end\|>\n"), lambda b: b != "")

    def segments(b: Column) -> Column:
        head = F.split(b, r"<\|text\|>", 2)
        role = unescape(F.regexp_replace(head[0], r"^<\|role\|>", ""))
        return F.transform(F.split(head[1], r"<\|next\|>"), lambda s: F.struct(role.alias("role"), unescape(s).alias("text"), (role == "assistant").alias("loss")))

    return formatted.select("conv_id", "formatted", F.flatten(F.transform(blocks, segments)).alias("turns"))


def digests(read: DataFrame) -> DataFrame:
    """One row of counts and digests per conversation, from the turns that were read back."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
