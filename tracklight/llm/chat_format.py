"""Chat formatting: typed content parts are flattened into one marked-up string per conversation.

A message holds parts of the types text, image, audio and document. ``flatten_parts`` lets a visitor per type see
them in order: text is shown as it is, an attachment as a placeholder, followed by its text if it has any; each
attachment is recorded with its reference and the number of tokens that it will expand to. ``format_conversations``
puts the turns between markers and escapes every control string inside texts, so that ``read_back`` recovers roles,
texts, placeholders and the loss mask.

Layout of a turn: ``<turn ROLE>\\n`` + body + ``\\n</turn>\\n``; ROLE is URL-encoded. A placeholder is
``<|KIND:TOKENS|>``. Inside texts a backslash is doubled and each control string gets a backslash in front;
unescaping drops the first of two. The loss mask covers the texts of the loss roles, not their placeholders.

Defined results: a null text or part list is empty; null parts are left out; a part of an unknown type is shown as
an attachment of the kind ``other`` if it has a reference, and by its text; a null role is the empty role; a null
turn sorts first; turns that tie are ordered by role, then body; a repeated row is a turn of its own; a row with a
null conversation id is a conversation of its own. Other columns are ignored. No Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracklight.llm.common import let

OPEN, CLOSE, ESCAPE = "<turn ", "</turn>", "\\"
#: Strings that a text may not hold unescaped: the turn markers and the start of a placeholder.
CONTROL = ("<turn ", "</turn>", "<|")
PARTS = "array<struct<type:string,text:string,ref:string,tokens:int,width:int,height:int,seconds:double,pages:int>>"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2))
    for control in CONTROL:
        out = F.replace(out, F.lit(control), F.lit(ESCAPE + control))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def attachment(kind: str, tokens: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A visitor that shows a part as a placeholder. ``tokens`` is what the part expands to unless it says so itself."""

    def visit(part: Column) -> Column:
        n = F.coalesce(part["tokens"], tokens(part)).cast("long")
        return F.struct(F.lit(kind).alias("kind"), F.coalesce(part["ref"], F.lit("")).alias("ref"), n.alias("tokens"))

    return visit


def _plain(part: Column) -> Column:
    return F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("ref"), F.lit(0).cast("long").alias("tokens"))


def _or(value: Column, default: int) -> Column:
    return F.coalesce(value, F.lit(default))


#: Type of a part -> visitor: a patch of 28 x 28 points is a token, a second of sound 25, a page 1024. More can be added.
VISITORS: dict[str, Callable[[Column], Column]] = {
    "text": _plain,
    "image": attachment("image", lambda p: _or(F.ceil(p["width"] / 28) * F.ceil(p["height"] / 28), 576)),
    "audio": attachment("audio", lambda p: _or(F.ceil(p["seconds"] * 25), 750)),
    "document": attachment("document", lambda p: 1024 * _or(p["pages"], 1)),
}
OTHER = attachment("other", lambda p: F.lit(256))


def flatten_parts(parts: Column, visitors: dict[str, Callable[[Column], Column]] | None = None) -> Column:
    """struct(body, spans array<struct(start, length)>, attachments array<struct(type, ref, tokens)>, expanded_tokens) of typed parts.

    ``spans`` are the places of the texts in the body, in code points from 0.
    """
    visitors = visitors or VISITORS

    def visit(part: Column) -> Column:
        seen = F.when(part["ref"].isNotNull(), OTHER(part)).otherwise(_plain(part))
        for kind, visitor in visitors.items():
            seen = F.when(part["type"] == kind, visitor(part)).otherwise(seen)

        def show(v):
            placeholder = F.when(v["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit("<|"), v["kind"], F.lit(":"), v["tokens"].cast("string"), F.lit("|>")))
            text = escape(F.coalesce(part["text"], F.lit("")))
            return F.struct(part["type"].alias("type"), v["ref"].alias("ref"), v["tokens"].alias("tokens"), placeholder.alias("placeholder"), text.alias("text"))

        return let(seen, show)

    def place(done, p):
        start, length = done["end"] + F.length(p["placeholder"]), F.length(p["text"])
        span = F.struct(start.cast("long").alias("start"), length.cast("long").alias("length"))
        return F.struct((start + length).cast("long").alias("end"), F.when(length > 0, F.array_append(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    def gather(v):
        begin = F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
        return F.struct(
            F.array_join(F.transform(v, lambda p: F.concat(p["placeholder"], p["text"])), "").alias("body"),
            F.aggregate(v, begin, place)["spans"].alias("spans"),
            F.transform(F.filter(v, lambda p: p["ref"].isNotNull()), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))).alias("attachments"),
            F.aggregate(v, F.lit(0).cast("long"), lambda a, p: a + p["tokens"]).alias("expanded_tokens"),
        )

    known = F.filter(F.coalesce(parts, F.array().cast(PARTS)), lambda p: p.isNotNull())
    return let(F.transform(known, visit), gather)


def part(kind: str, **values: Column) -> Column:
    """A part of a type, with some of the fields of ``PARTS`` given."""
    fields = T.DataType.fromDDL(PARTS).elementType.fields
    return F.struct(*[F.lit(kind).alias("type") if f.name == "type" else values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(part("text", text=text))


def format_conversations(
    messages: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    parts: str = "parts",
    loss_roles: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    ``loss_spans`` is an array of struct(start, length) over code points of ``formatted``, start counted from 0:
    the bodies of the turns whose role is in ``loss_roles``. ``attachments`` lists them in text order with the
    place of their turn. The rows of a conversation meet once, in the one row that is their result.
    """
    flat = messages.select(
        F.col(conv_id).alias("conv_id"),
        F.when(F.col(conv_id).isNull(), F.monotonically_increasing_id()).alias("lone"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        flatten_parts(F.col(parts)).alias("flat"),
    ).select("conv_id", "lone", "turn", "role", "flat.*", F.concat(F.lit(OPEN), F.url_encode("role"), F.lit(">\n")).alias("head"))
    order = W.partitionBy("conv_id", "lone").orderBy("turn", "role", "body")
    whole = F.length("head") + F.length("body") + F.lit(len(CLOSE) + 2)
    before = F.coalesce(F.sum(whole.cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = flat.select("*", F.row_number().over(order).alias("place"), (before + F.length("head")).alias("start"))
    spans = F.transform("spans", lambda s: F.struct((F.col("start") + s["start"]).alias("start"), s["length"].alias("length")))
    turns = placed.groupBy("conv_id", "lone").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "place",
                    F.concat("head", "body", F.lit(f"\n{CLOSE}\n")).alias("piece"),
                    F.when(F.col("role").isin(*loss_roles), spans).alias("spans"),
                    "attachments",
                )
            )
        ).alias("turns"),
        F.sum("expanded_tokens").alias("expanded_tokens"),
    )
    attach = F.flatten(
        F.transform("turns", lambda t: F.transform(t["attachments"], lambda a: F.struct(t["place"].alias("place"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))
    )
    return turns.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"),
        F.flatten(F.filter(F.transform("turns", lambda t: t["spans"]), lambda s: s.isNotNull())).alias("loss_spans"),
        attach.alias("attachments"),
        "expanded_tokens",
    )


def read_back(formatted: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """conv_id, turns array<struct(role, text, placeholders)>, loss_text, formatted, read from ``formatted`` and ``loss_spans`` alone.

    A placeholder is read as KIND:TOKENS. ``carried`` names columns that stay as they are.
    """
    pieces = F.filter(F.split("formatted", rf"\n{CLOSE}\n"), lambda p: p != "")
    seen = r"(?s)\\.|<\|([^|]*)\|>"

    def turn_of(piece):
        head = F.instr(piece, ">\n")
        body = F.substring(piece, head + 2, F.length(piece))
        return F.struct(
            F.url_decode(F.substring(piece, F.lit(len(OPEN) + 1), head - len(OPEN) - 1)).alias("role"),
            unescape(F.regexp_replace(body, r"(?s)(\\.)|<\|[^|]*\|>", "$1")).alias("text"),
            F.filter(F.regexp_extract_all(body, F.lit(seen)), lambda x: x != "").alias("placeholders"),
        )

    spans = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(pieces, turn_of).alias("turns"), F.array_join(spans, "").alias("loss_text"), *carried)
