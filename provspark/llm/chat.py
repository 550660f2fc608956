"""Chat formatting with Spark expressions only.

A conversation becomes one string. Each run of adjacent turns of one role is a block::

    <|im_start|>role\\n text <|im_part|> text ... <|im_end|>\\n

``<|im_part|>`` stands between the texts of a block, so that reading back gives every turn. Control
strings begin with ``<|``; inside texts and roles each ``<``, any backslashes, ``|`` gets one more
backslash, which is undone by taking one away: escaped text never contains ``<|``.

Defined cases: a null text or role is empty; a null turn sorts first; repeated rows and ties on the
turn number stay, ordered by role, then text; rows without a conversation id are one conversation
with a null id; no rows give no rows. Other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, PART, END, BREAK = "<|im_start|>", "<|im_part|>", "<|im_end|>\n", "<|im_break|>"


def escape(text: Column) -> Column:
    return F.when(F.instr(text, "<") > 0, F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(F.instr(text, "<") > 0, F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")).otherwise(text)


def format_chat(
    turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conversation, formatted, segments``.

    ``segments`` cuts ``formatted`` into pieces ``(text, loss)``: the pieces joined are the string,
    and ``loss`` marks those that a model is trained on (the texts of ``loss_role``). The only
    shuffle brings the turns of a conversation together, as its single output row needs.
    """
    row = F.struct(
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = turns.groupBy(F.col(conversation)).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    def pieces(x: Column, i: Column) -> Column:
        turns = F.col("turns")
        first = i == 0
        same = ~first & (F.get(turns, i - 1).role == x.role)
        head = F.concat(
            F.when(first, "").otherwise(END), F.lit(START), F.replace(escape(x.role), F.lit("\n"), F.lit(BREAK)), F.lit("\n")
        )
        return F.array(
            F.struct(F.when(same, PART).otherwise(head).alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(x.text).alias("text"), (x.role == loss_role).alias("loss")),
        )

    closing = F.array(F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")))
    rows = rows.select(conversation, F.concat(F.flatten(F.transform("turns", pieces)), closing).alias("segments"))
    formatted = F.array_join(F.transform("segments", lambda x: x.text), "")
    return rows.select(conversation, formatted.alias("formatted"), "segments")


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of ``(role, text)``, adjacent ones of a role apart again."""
    blocks = F.filter(F.split(formatted, F.lit(r"<\|im_end\|>\n"), -1), lambda b: b != "")

    def turns(block: Column) -> Column:
        body = F.substring(block, F.lit(len(START) + 1), F.char_length(block))
        role = F.substring_index(body, "\n", 1)
        texts = F.split(F.substring(body, F.char_length(role) + 2, F.char_length(body)), F.lit(r"<\|im_part\|>"), -1)
        role = unescape(F.replace(role, F.lit(BREAK), F.lit("\n")))
        return F.transform(texts, lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s.loss), lambda s: unescape(s.text)), "")
