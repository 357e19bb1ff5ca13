"""Operator 6 [native]: chat formatting of typed content parts.

A turn's content is an array of parts (type, text, ref, tokens).  The visitor goes through them in order: a text part
is escaped; an image, audio or document part becomes a placeholder <|type|>, its reference is recorded with the turn
and its place among the conversation's attachments, and its expanded token count is its `tokens`, or the default of
its type.  The template marks turns: <|start|>role<|sep|>content<|end|>.

Escaping is reversible: a backslash is doubled, and behind the first character of every control string (those of the
template, the placeholders, and the usual <s>, </s>, [INST] and [/INST]) a backslash is put in.  Escaped text so
holds no control string, nor can one begin in it and end in a mark, so splitting at the marks reads the turns back.

The result has one row for each conversation: `segments` (text and whether the loss counts it) make up `formatted`;
`attachments`; and n_expanded_tokens over all attachments.  The loss counts what assistants say.

Cases: a null text, role or part is empty; a null conversation id is a conversation of its own; a null turn comes
first; rows of one turn are ordered by role and text; an unknown part type is an attachment with 0 tokens; other
columns are not read; an empty table gives an empty table.  One conversation is one row and so one value in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|start|>", "<|sep|>", "<|end|>"
#: Placeholders, and the tokens that one expands to where the part doesn't say.
ATTACHMENTS = {"image": 576, "audio": 1500, "document": 4096}
CONTROL = (START, SEP, END, *(f"<|{x}|>" for x in ATTACHMENTS), "<s>", "</s>", "[INST]", "[/INST]")
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """The content of a turn that is one text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("tokens")))


def _content(parts: Column) -> Column:
    """The visitor's text of a turn's parts."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), F.coalesce(p["type"], F.lit("document")), F.lit("|>")))), "", "")


def _attachments(parts: Column) -> Column:
    default = F.create_map(*(F.lit(x) for kv in ATTACHMENTS.items() for x in kv))
    found = F.filter(parts, lambda p: F.coalesce(p["type"] != "text", F.lit(True)))
    return F.transform(found, lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), F.coalesce(p["tokens"], default[p["type"]].cast("bigint"), F.lit(0)).alias("tokens")))


def format_conversations(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None) -> DataFrame:
    """(id, formatted, segments, attachments, n_expanded_tokens)."""
    parts = F.coalesce(F.filter(F.col(parts_col), lambda p: p.isNotNull()), F.array().cast(turns.schema[parts_col].dataType)) if parts_col else text_part(F.col(text_col).cast("string"))
    said = _content(parts)
    d = turns.select(
        F.col(id_col).alias("_c"),
        F.struct(F.col(turn_col).alias("turn"), escape(F.col(role_col).cast("string")).alias("role"), said.alias("said"), _attachments(parts).alias("att")).alias("x"),
    )
    d = d.groupBy("_c").agg(F.sort_array(F.collect_list("x")).alias("x"))
    turn = lambda t: F.array(
        F.struct(F.concat(F.lit(START), t["role"], F.lit(SEP)).alias("text"), F.lit(False).alias("loss")),
        F.struct(t["said"].alias("text"), (t["role"] == LOSS_ROLE).alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )
    flat = F.flatten(F.transform("x", lambda t, i: F.transform(t["att"], lambda a: F.struct(i.alias("turn_no"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    d = d.select(F.col("_c").alias(id_col), F.flatten(F.transform("x", turn)).alias("segments"), flat.alias("attachments"))
    total = F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"])
    return d.select(id_col, F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "attachments", total.alias("n_expanded_tokens"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from the output; placeholders stay in the text."""
    pieces = F.split(formatted, r"<\|end\|>")
    whole = F.slice(pieces, 1, F.size(pieces) - 1)
    one = lambda p: F.split(F.substr(p, F.lit(len(START) + 1)), r"<\|sep\|>")
    return F.transform(whole, lambda p: F.struct(unescape(one(p)[0]).alias("role"), unescape(one(p)[1]).alias("text")))


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
