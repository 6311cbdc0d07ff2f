"""Conversations as training text, by Spark expressions only.

The template, where `T` is a text in its escaped form::

    <s> block block ...          one block for each run of neighbouring turns of one role
    [INST]T[/INST]               user
    [SYS]T[/SYS]                 system
    [OUT]T</s>                   assistant; T is under the loss mask, the marks are not
    [ROLE]r[/ROLE]T[/TURN]       any other role r

The texts of a run stand in one block with [NEXT] between them, so that each turn can be read back.  In texts and
roles a backslash is doubled, and one goes behind the first character of every control string; no mark holds a
backslash or its own first character twice, so marks are found only where the template put them.

All rows of a conversation meet in one exchange; order, runs and places come from window functions over it and each
run's texts from an array aggregation, so the cost is linear in the number of turns.  A conversation is one value of
the result, as a document is: that, not a group of conversations, bounds a task's memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The control strings, and each role's opening and closing mark.
BEGIN, NEXT = "<s>", "[NEXT]"
MARKS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[OUT]", "</s>")}
ROLE, END_ROLE, END_TURN = "[ROLE]", "[/ROLE]", "[/TURN]"
CONTROL = [BEGIN, NEXT, *(m for pair in MARKS.values() for m in pair), ROLE, END_ROLE, END_TURN]
LEARNT = "assistant"


def literal(mark: str) -> str:
    return "".join("\\" + c if c in "[]/<>" else c for c in mark)


CONTROL_RX = "([<\\[])(?=" + "|".join(literal(m[1:]) for m in CONTROL) + ")"
CLOSING_RX = "|".join(literal(m) for m in (*(pair[1] for pair in MARKS.values()), END_TURN))
OPENING_RX = "|".join((*(literal(pair[0]) for pair in MARKS.values()), f"{literal(ROLE)}.*?{literal(END_ROLE)}"))


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL_RX, "$1\\\\")


def unescape(text: Column) -> Column:
    """A backslash goes, and what stands behind it stays."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def by_role(role: Column, side: int, other: Column) -> Column:
    out = other
    for name, pair in MARKS.items():
        out = F.when(role == name, F.lit(pair[side])).otherwise(out)
    return out


def format_chat(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, loss: array<struct<start, length>>, the code points of `formatted` that are learnt, a span for each text.

    Turns are taken by turn number; rows of one number, repeated ones too, by role, then text.  A null turn comes
    first, a null role or text is empty.  A row without a conv_id is a conversation of its own, whose id is null.
    Other columns are left out; no rows give none.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.when(F.col(conv).isNull(), F.monotonically_increasing_id()).alias("own"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("raw"),
    )
    key = ("conv_id", "own")
    order = Window.partitionBy(*key).orderBy("turn", "role", "raw")
    near = rows.withColumns({"nth": F.row_number().over(order), "fresh": ~F.lag("role").over(order).eqNullSafe(F.col("role")), "last": ~F.lead("role").over(order).eqNullSafe(F.col("role"))})
    opening = by_role(F.col("role"), 0, F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(END_ROLE)))
    near = near.select(
        *key, "nth", "role", "fresh", escape(F.col("raw")).alias("text"), F.when(F.col("fresh"), opening).otherwise(NEXT).alias("head"), F.when(F.col("last"), by_role(F.col("role"), 1, F.lit(END_TURN))).otherwise("").alias("tail"),
    )
    before = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key).orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("head") + F.char_length("text") + F.char_length("tail")
    start = len(BEGIN) + F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")
    placed = near.withColumns({"block": F.sum(F.col("fresh").cast("int")).over(upto), "start": start})
    # neighbouring turns of one role become one block: the sorted structs of its turns, their texts joined
    own = F.array_sort(F.collect_list(F.struct("nth", "text", "head", "tail", F.col("start"), F.char_length("text").cast("long").alias("length"))))
    blocks = placed.groupBy(*key, "block", "role").agg(own.alias("turns"))
    blocks = blocks.select(
        *key, "block", F.concat(F.element_at("turns", 1)["head"], F.array_join(F.transform("turns", lambda t: t["text"]), NEXT), F.element_at("turns", -1)["tail"]).alias("piece"),
        F.when(F.col("role") == LEARNT, F.transform("turns", lambda t: F.struct(t["start"].alias("start"), t["length"].alias("length")))).otherwise(F.array().cast("array<struct<start:bigint,length:bigint>>")).alias("loss"),
    )
    whole = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "piece", "loss"))).alias("blocks"))
    return whole.select("conv_id", F.concat(F.lit(BEGIN), F.array_join(F.transform("blocks", lambda b: b["piece"]), "")).alias("formatted"), F.flatten(F.transform("blocks", lambda b: b["loss"])).alias("loss"))


def read_chat(formatted: DataFrame) -> DataFrame:
    """Rows of format_chat() -> conv_id, turns (array<struct<role, text>>), learnt (the texts under the mask, one after the other), formatted_chars."""

    def block(piece: Column) -> Column:
        role = F.lit(None).cast("string")
        for name, (mark, _) in MARKS.items():
            role = F.when(F.startswith(piece, F.lit(mark)), F.lit(name)).otherwise(role)
        role = F.coalesce(role, unescape(F.regexp_extract(piece, f"(?s)^{literal(ROLE)}(.*?){literal(END_ROLE)}", 1)))
        inner = F.regexp_replace(piece, f"(?s)^(?:{OPENING_RX})|(?:{CLOSING_RX})\\z", "")
        return F.transform(F.split(inner, literal(NEXT), -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    pieces = F.filter(F.split(F.substring("formatted", len(BEGIN) + 1, 2**31 - 1), f"(?<={CLOSING_RX})", -1), lambda p: p != "")
    # four bytes a code point: a span is cut out without walking through the text before it
    wide = F.encode("formatted", "UTF-32")
    learnt = F.transform("loss", lambda s: F.decode(F.substring(F.col("wide"), (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))
    return formatted.withColumn("wide", wide).select(
        "conv_id", F.flatten(F.transform(pieces, block)).alias("turns"), unescape(F.array_join(learnt, "")).alias("learnt"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def digest(read: DataFrame) -> DataFrame:
    """Rows of read_chat() -> the counts and SHA-256 digests of each conversation."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.char_length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars",
    )
