"""Chat formatting with one training example for each assistant turn. DataFrame functions only.

A turn of the assistant is written ``<s>text</s>``, any other turn ``[INST]role`` newline ``text[/INST]``.
Inside roles and texts the characters ``<``, ``[`` and backslash are escaped, so that no control string can
come from a text, and every escape can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
#: Fixed values of the template: the escapes, backslash first.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\s"))
NEWLINE = ("\n", "\\n")


def escape(c: Column, in_role: bool = False) -> Column:
    for plain, written in (*ESCAPES, *((NEWLINE,) if in_role else ())):
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column, in_role: bool = False) -> Column:
    for plain, written in ((NEWLINE,) if in_role else ()) + ESCAPES[::-1]:
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def format_turn(role: Column, text: Column) -> Column:
    reply = F.concat(F.lit("<s>"), escape(text), F.lit("</s>"))
    other = F.concat(F.lit("[INST]"), escape(role, True), F.lit("\n"), escape(text), F.lit("[/INST]"))
    return F.when(role == ASSISTANT, reply).otherwise(other)


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example, as ``array<struct<role, text>>``."""
    pieces = F.filter(F.split(formatted, r"(?=\[INST\])|(?=<s>)", -1), lambda p: p != "")

    def turn(p: Column) -> Column:
        reply = F.startswith(p, F.lit("<s>"))
        body = F.when(reply, F.substring(p, 4, F.char_length(p) - 7)).otherwise(F.substring(p, 7, F.char_length(p) - 13))
        cut = F.instr(body, "\n")
        role = F.when(reply, F.lit(ASSISTANT)).otherwise(unescape(F.substring(body, F.lit(1), cut - 1), True))
        text = F.when(reply, body).otherwise(F.substring(body, cut + 1, F.char_length(body)))
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def prefix_targets(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Examples ``conv, target, formatted, loss_start, loss_length``: one for each assistant turn.

    ``target`` counts the turns of a conversation from 0 in order of ``turn`` (null first; equal turns by role,
    then text). ``formatted`` is every turn up to the target; the loss covers the code points from
    ``loss_start`` (from 0) for ``loss_length``, which are the target's own text. Where turns follow the last
    assistant turn, or there is none, one more example without loss (``loss_length`` 0) holds the whole conversation,
    so that the output keeps every turn. Null role or text is the empty string, a null conversation id is a conversation
    of its own. The output holds each turn once for every later reply: that is what the expansion asks for.
    """
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"),
    )
    held = rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # array_sort puts a null field first
    held = held.select("conv", "turns", F.transform("turns", lambda t: format_turn(t["role"], t["text"])).alias("written"))
    last = F.size("turns") - 1
    wanted = F.filter(F.sequence(F.lit(0), last), lambda i: (F.get(F.col("turns"), i)["role"] == ASSISTANT) | (i == last))
    each = held.select("conv", "turns", "written", F.explode(wanted).alias("target"))
    own = F.get(F.col("written"), F.col("target"))
    reply = F.get(F.col("turns"), F.col("target"))["role"] == ASSISTANT
    each = each.select(
        F.col("conv").alias(conv), "target", F.array_join(F.slice("written", F.lit(1), F.col("target") + 1), "").alias("formatted"),
        reply.alias("reply"), own.alias("own"),
    )
    length = F.when(F.col("reply"), F.char_length("own") - 7).otherwise(0)
    start = F.char_length("formatted") - F.when(F.col("reply"), length + 4).otherwise(0)
    return each.select(conv, "target", "formatted", start.cast("long").alias("loss_start"), length.cast("long").alias("loss_length"))


def masked_text(formatted: Column, start: Column, length: Column) -> Column:
    """What lies under the loss mask, unescaped."""
    return unescape(F.substring(formatted, start.cast("int") + 1, length.cast("int")))
