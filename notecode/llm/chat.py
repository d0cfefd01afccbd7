"""Chat formatting: turns of a conversation to one training text with a loss mask. Built-in functions only.

A turn is written ``<turn ROLE>`` text ``</turn>`` and a line feed; adjacent turns of one role share a
block, in which ``<part>`` stands between their texts. Inside texts and roles a backslash becomes
``\\b`` and the ``<`` of a control string becomes ``\\l``, so no text can end its own turn, and the
original comes back by the reverse replacements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONTROLS = ("<turn ", "</turn>", "<part>")
CHUNK = 512  # running totals are built in pieces of so many entries, so their cost stays linear


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    for control in CONTROLS:
        text = F.replace(text, F.lit(control), F.lit("\\l" + control[1:]))
    return text


def role_name(role: Column) -> Column:
    """An escaped role, in which ``>`` is escaped as well, since that sign ends it."""
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    for code, sign in (("\\l", "<"), ("\\g", ">"), ("\\b", "\\")):  # the backslash comes last
        text = F.replace(text, F.lit(code), F.lit(sign))
    return text


def _running(start: Column, values: Column) -> Column:
    """``start`` and then ``start`` plus the sum of the first, the first two, ... of ``values``."""
    zero = F.array(start.cast("long"))
    return F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))


def starts_of(lengths: Column) -> Column:
    """The sum of all earlier entries, for every entry of an array of numbers."""
    last = F.greatest(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK)).cast("int")
    chunks = F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(lengths, c * CHUNK + 1, F.lit(CHUNK)))
    sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, x: acc + x))
    offsets = _running(F.lit(0), sums)
    inside = F.transform(chunks, lambda c, i: F.slice(_running(F.get(offsets, i), c), 1, F.size(c)))
    return F.flatten(inside)


def format_chats(
    turns: DataFrame,
    id_col: str = "conv_id",
    order_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``(conv_id, formatted, loss_spans)``, one row per conversation.

    ``loss_spans`` lists the ``(start, end)`` code points of the formatted text, end exclusive, that
    hold texts of ``loss_role``. Turns are sorted by ``order_col``, ties by role and text, nulls first.
    Null text and null role count as empty. A null conversation id is a conversation of its own; a
    repeated row is a repeated turn. Other columns are ignored; no rows give no conversations. A
    conversation is one record of the result and so must fit in memory.
    """
    turn = F.struct(
        F.col(order_col).alias("t"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    grouped = turns.groupBy(F.col(id_col).alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def piece(x: Column, i: Column) -> Column:
        same_before = (i > 0) & (F.get(F.col("turns"), i - 1)["role"] == x["role"])
        same_after = F.coalesce(F.get(F.col("turns"), i + 1)["role"] == x["role"], F.lit(False))
        head = F.when(same_before, F.lit("")).otherwise(F.concat(F.lit("<turn "), role_name(x["role"]), F.lit(">")))
        tail = F.when(same_after, F.lit("<part>")).otherwise(F.lit("</turn>\n"))
        return F.struct(
            head.alias("head"), escape(x["text"]).alias("body"), tail.alias("tail"), (x["role"] == loss_role).alias("loss")
        )

    pieces = grouped.select("conv_id", F.transform("turns", piece).alias("pieces"))
    whole = lambda p: F.concat(p["head"], p["body"], p["tail"])
    measured = pieces.withColumn("starts", starts_of(F.transform("pieces", lambda p: F.length(whole(p)).cast("long"))))

    def span(p: Column, i: Column) -> Column:
        start = F.get(F.col("starts"), i) + F.length(p["head"])
        return F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end"), p["loss"].alias("loss"))

    spans = F.filter(F.transform("pieces", span), lambda s: s["loss"])
    return measured.select(
        "conv_id",
        F.array_join(F.transform("pieces", whole), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["end"])).alias("loss_spans"),
    )


def read_chats(chats: DataFrame) -> DataFrame:
    """``(conv_id, turns, n_blocks, formatted_chars, loss_text)`` read back from formatted texts and loss spans alone."""
    blocks = F.filter(F.split("formatted", "</turn>\n", -1), lambda b: b != "")

    def parts(block: Column) -> Column:
        role = unescape(F.substring_index(F.substring(block, len("<turn ") + 1, 1 << 30), ">", 1))
        body = F.substring(block, F.instr(block, F.lit(">")) + 1, F.lit(2**31 - 1))
        return F.transform(F.split(body, "<part>", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    inside = F.transform(
        "loss_spans",
        lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
    )
    return chats.select(
        "conv_id",
        F.flatten(F.transform(blocks, parts)).alias("turns"),
        F.size(blocks).cast("long").alias("n_blocks"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(inside, "").alias("loss_text"),
    )
