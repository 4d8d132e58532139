"""Chat formatting: turns with typed content parts become one string per conversation, with a loss mask, and can be read back.

A turn is ``<|turn|>role<|body|>body<|end|>``. Inside texts a backslash becomes ``\\b`` and ``<`` becomes ``\\l``, so no text can hold a control string,
whatever it says, and reading back restores it exactly. Parts other than texts leave an ordered placeholder such as ``<|image|>`` in the body;
what they refer to and the tokens that they stand for are recorded beside it. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens for each unit of a part: a tile of an image, a second of audio, a page of a document.
TOKENS = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A plain text as a list with one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units")))


def visit(parts: Column, tokens: dict[str, int] | None = None) -> tuple[Column, Column]:
    """Body of a turn, and its attachments in order: type, ref, number of the part, expanded tokens.

    ``parts`` is an array of (type, text, ref, units). A null array has no parts; a null text is empty; a null type is taken for a text; null units
    count as one; a type without a rate leaves a placeholder that stands for no tokens.
    """
    rates = TOKENS if tokens is None else tokens
    parts = F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>"))

    def kind(p: Column) -> Column:
        return F.coalesce(p["type"], F.lit("text"))

    def rate(p: Column) -> Column:
        out = F.lit(0)
        for name, each in rates.items():
            out = F.when(kind(p) == name, F.lit(each)).otherwise(out)
        return out

    body = F.array_join(F.transform(parts, lambda p: F.when(kind(p) == "text", escape(p["text"])).otherwise(F.concat(F.lit("<|"), escape(kind(p)), F.lit("|>")))), "")
    numbered = F.transform(parts, lambda p, i: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), i.alias("part"), (F.coalesce(p["units"], F.lit(1)) * rate(p)).cast("long").alias("tokens")))
    return body, F.filter(numbered, lambda a: a["type"] != "text")


def format_chat(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", learn: tuple[str, ...] = ("assistant",), tokens: dict[str, int] | None = None) -> DataFrame:
    """One row per conversation: ``formatted``, ``loss_spans``, ``attachments``, ``expanded_tokens``.

    Turns stand in the order of their number, null first; equal numbers by role, then body. A null role is empty; a null conversation is one of its
    own. A loss span is (index of the turn, start in the turn from 0, length), in code points of the formatted string, so that a conversation of any length
    is read in one pass. Other columns of the input are not read; repeated rows are repeated turns. Rows meet once, by conversation.
    """
    body, attached = visit(F.col(parts), tokens)
    named = F.coalesce(F.col(role), F.lit(""))
    head = F.concat(F.lit(TURN), escape(named), F.lit(BODY))
    each = F.struct(F.col(turn).alias("turn"), named.alias("role"), body.alias("body"), head.alias("head"), attached.alias("attached"))
    said = rows.select(F.col(conversation).alias("__conv"), each.alias("__turn")).groupBy("__conv").agg(F.sort_array(F.collect_list("__turn")).alias("__turns"))
    turns = F.col("__turns")
    spans = F.transform(turns, lambda t, i: F.when(t["role"].isin(*learn), F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), F.length(t["body"]).alias("length"))))
    files = F.flatten(F.transform(turns, lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return said.select(
        F.col("__conv").alias(conversation), F.array_join(F.transform(turns, lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"))


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted string, without their end marks."""
    ended = F.split(formatted, r"<\|end\|>")
    return F.slice(ended, 1, F.size(ended) - 1)


def turns_of(formatted: Column) -> Column:
    """(role, text) of each turn, read back from the formatted string alone."""
    parts = F.transform(pieces_of(formatted), lambda p: F.split(p, r"<\|turn\|>|<\|body\|>", 3))
    return F.transform(parts, lambda p: F.struct(unescape(p[1]).alias("role"), unescape(p[2]).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    pieces = pieces_of(formatted)
    return unescape(F.array_join(F.transform(spans, lambda s: F.substring(F.element_at(pieces, (s["turn"] + 1).cast("int")), s["start"] + 1, s["length"])), ""))
