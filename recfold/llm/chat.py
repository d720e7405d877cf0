"""Chat formatting of typed content parts, with a reversible escape and a loss mask.

A message is a list of parts: text, image, audio or document. A visitor flattens the parts in order:
text is escaped, any other part becomes its kind's placeholder, and its reference and the number of
tokens that it will expand to are recorded. Turns are marked by control strings that begin with "<|";
inside texts, a backslash is written "\\s" and "<" is written "\\l", so no text, and no run of texts, can
hold a control string, and unescaping gives each back whole. The loss mask is a list of spans over the formatted string.

One window and one aggregation on the conversation share a single shuffle; everything is native.

A conversation is one row, so its turns meet in one task and must fit there, however they are dealt.
A span of the loss mask also names its turn and its place in the turn, so the mask is read in one pass
over the turns.

Nulls: a null text is empty, a null role is an empty role, a null turn comes first, rows with a null
conv_id are one conversation. Very long texts are formatted whole. Turns that tie are ordered by role,
content and attachments; repeated rows are turns of their own. An empty table gives no conversations.
Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
KINDS = ("image", "audio", "document")
PARTS = "array<struct<kind:string,text:string,ref:string,units:int>>"
#: Tokens per unit of a part: image tiles, audio seconds, document pages.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A message of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units"))).cast(PARTS)


def flattened(parts: Column) -> Column:
    """The visitor: one string, with a placeholder for each part that isn't text. An unknown kind is an error."""
    def visit(p: Column) -> Column:
        out = F.when(p.kind == "text", escaped(F.coalesce(p.text, F.lit(""))))
        for kind in KINDS:
            out = out.when(p.kind == kind, F.lit(f"<|{kind}|>"))
        return out.otherwise(F.raise_error(F.concat(F.lit("unknown part kind: "), F.coalesce(p.kind, F.lit("null")))))

    return F.array_join(F.transform(F.coalesce(parts, F.array().cast(PARTS)), visit), "")


def attachments(parts: Column) -> Column:
    """The parts that aren't text, in order, each with its expanded token count."""
    each = F.create_map(*(x for k in KINDS for x in (F.lit(k), F.lit(TOKENS_PER_UNIT[k]))))
    return F.transform(F.filter(parts, lambda p: p.kind != "text"), lambda p: F.struct(p.kind.alias("kind"), p.ref.alias("ref"), (F.coalesce(p.units, F.lit(1)) * F.element_at(each, p.kind)).alias("n_tokens")))


def format_chat(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted, n_turns, loss_spans (start, length, turn from 0, offset in the turn; in characters), attachments; from conv_id, turn, role, parts."""
    role = F.coalesce("role", F.lit(""))
    rows = messages.select("conv_id", "turn", role.alias("role"), flattened(F.col("parts")).alias("body"), attachments(F.col("parts")).alias("held"))
    head = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))
    rows = rows.withColumn("head", head).withColumn("said", F.concat("head", "body", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body", "held")
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("upto", F.sum(F.length("said").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.struct((F.col("upto") - F.length("said") + F.length("head")).alias("start"), F.length("body").alias("length"), (F.col("nth") - 1).alias("turn"), F.length("head").alias("offset"))
    rows = rows.withColumn("span", F.when(F.col("role") == loss_role, span))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("nth", "said", "span", "held"))).alias("turns"))
    return turns.select(
        "conv_id", F.array_join("turns.said", "").alias("formatted"), F.size("turns").cast("long").alias("n_turns"),
        F.filter("turns.span", lambda s: s.isNotNull()).alias("loss_spans"), F.flatten(F.filter("turns.held", lambda h: h.isNotNull())).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn, from a formatted string of text parts."""
    raw = F.filter(F.split(formatted, r"<\|end\|>"), lambda t: t != "")
    halves = F.transform(raw, lambda t: F.split(F.substring(t, len(TURN) + 1, 1 << 30), r"<\|says\|>"))
    return F.transform(halves, lambda h: F.struct(unescaped(h[0]).alias("role"), unescaped(h[1]).alias("text")))


def read_loss(formatted: Column, spans: Column) -> Column:
    """The text under the loss mask, each span taken from its own turn."""

    def under(turns: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(F.get(turns, s.turn), s.offset + 1, s.length))), "")

    return F.transform(F.array(F.split(formatted, r"<\|end\|>")), under)[0]  # split once


def digests(chats: DataFrame) -> DataFrame:
    """What a reader finds in the output: one row per conversation."""
    read = chats.withColumn("turns", read_turns(F.col("formatted"))).withColumn("loss", read_loss(F.col("formatted"), F.col("loss_spans")))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
