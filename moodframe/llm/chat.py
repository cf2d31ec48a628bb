"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted by turn, adjacent
turns of one role are merged under one header, and the pieces are joined:

    <|start|>ROLE<|message|>TEXT[<|next|>TEXT ...]<|end|>

Control strings inside a text or role are escaped by putting one more
backslash after their first character (``<|`` becomes ``<\\|``, ``<\\|``
becomes ``<\\\\|``), which is undone exactly when the output is read back.
The control strings of other common templates are escaped likewise.

Defined results: null text or role reads as empty; rows of one turn number go
by role, then text; repeated rows are separate turns; rows with null conv_id
form one conversation; an empty table gives no rows; other columns are
ignored.  A formatted conversation is one value, so its rows meet in one row
by definition; nothing larger than one conversation is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
#: first character, backslashes, rest of a control string
CONTROL = r"([<\[])(\\*)(\||/?s>|<SYS>|</SYS>|/?INST\])"
ESCAPED = r"([<\[])\\(\\*)(\||/?s>|<SYS>|</SYS>|/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2$3")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, ESCAPED, "$1$2$3")


def format_chat(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """(conv_id, segments, formatted): ``segments`` is an array of
    struct(piece, loss) whose pieces joined are ``formatted``; ``loss`` marks
    the texts of ``loss_role``."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("t"),
    )
    convs = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    role = lambda i: F.element_at("turns", i.cast("int"))["role"]  # noqa: E731  1-based
    n = F.size("turns")

    def pieces(t: Column, i: Column) -> Column:
        opens = F.when(i == 0, True).otherwise(role(F.greatest(i, F.lit(1))) != t["role"])
        closes = F.when(i == n - 1, True).otherwise(role(F.least(i + 2, n)) != t["role"])
        head = F.when(opens, F.concat(F.lit(START), escape(t["role"]), F.lit(MESSAGE))).otherwise(F.lit(NEXT))
        tail = F.when(closes, F.lit(END)).otherwise(F.lit(""))
        piece = lambda c, loss: F.struct(c.alias("piece"), loss.alias("loss"))
        no = F.lit(False)
        return F.array(piece(head, no), piece(escape(t["text"]), t["role"] == F.lit(loss_role)), piece(tail, no))

    segments = F.flatten(F.transform("turns", pieces))
    out = convs.select("conv_id", segments.alias("segments"))
    return out.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["piece"]), "").alias("formatted"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted_chars) parsed from the output:
    ``turns`` array of struct(role, text) in order; ``loss_text`` is the
    unescaped text of the segments under the loss mask."""
    blocks = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda b: F.startswith(b, F.lit(START)))

    def of(block: Column) -> Column:
        role = F.split_part(F.substring(block, len(START) + 1, 2**31 - 1), F.lit(MESSAGE), F.lit(1))
        body = F.substring(block, F.char_length(role) + (len(START) + len(MESSAGE) + 1), F.lit(2**31 - 1))
        return F.transform(
            F.split(body, r"<\|next\|>", -1),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["piece"]))
    return formatted.select(
        "conv_id",
        F.flatten(F.transform(blocks, of)).alias("turns"),
        F.array_join(loss, "").alias("loss_text"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """The registered query's columns, all read back from the output."""
    back = read_back(formatted)
    body = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(body.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
