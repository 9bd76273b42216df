"""Chat formatting with typed content parts, in DataFrame functions only.

A turn's content is an array of parts ``struct<type, text, ref, tokens>``. The
visitor turns each part, in order, into a piece of text: a text part is its
escaped text; image, audio and document parts become numbered placeholders
(``<|image_1|>``: the number counts the conversation's attachments) and leave an
attachment record: its number, turn, type, reference and the number of tokens
that it expands to. Other types are ignored.

A conversation is the sequence of ``<|im_start|>role\\n`` content ``<|im_end|>\\n``.
Inside texts and roles a backslash is doubled and ``<|`` becomes ``<\\|`` (in
roles a line feed becomes ``\\n`` too), so no text can make a control string,
and ``unescape`` gives back every text.

The loss mask is a list of spans (0-based start, length, in code points) of the
formatted string: the content of each assistant turn.

Turns are ordered by turn, then role, then text. One shuffle by conversation
carries the window (places) and the grouping. A conversation is one string, so
one conversation has to fit in a task; many conversations, however alike, do
not meet.

Defined results: null text or content is empty, a null role is empty; a null
conv_id is a conversation of its own; repeated rows are turns like others; an
empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type: string, text: string, ref: string, tokens: long>>"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that an attachment expands to where its part does not say.
EXPANDS = {"image": 576, "audio": 750, "document": 1024}


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    pieces = F.transform(F.split(role, r"\\\\", -1), lambda x: F.replace(F.replace(x, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|")))
    return F.array_join(pieces, "\\")


def text_parts(text: Column) -> Column:
    """A text as a content of one part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("tokens")))


def _placeholder(part: Column, number: Column) -> Column:
    return F.concat(F.lit("<|"), part["type"], F.lit("_"), number.cast("string"), F.lit("|>"))


def format_chats(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    content: Column | None = None,
    expands: dict[str, int] = EXPANDS,
) -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss_spans, attachments, expanded_tokens``.

    ``content`` is an array of parts (``PARTS``); by default the column ``text``
    as one text part.
    """
    content = text_parts(F.col("text").cast("string")) if content is None else content.cast(PARTS)
    kinds = F.array(*map(F.lit, expands))
    sizes = F.create_map(*(F.lit(x) for pair in expands.items() for x in pair))
    base = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("_turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("_role"),
        F.filter(F.coalesce(content, F.array().cast(PARTS)), lambda p: (p["type"] == "text") | F.array_contains(kinds, p["type"])).alias("_parts"),
    )
    rows = Window.partitionBy("conv_id").orderBy("_turn", "_role", "_parts").rowsBetween(Window.unboundedPreceding, -1)
    files = F.filter("_parts", lambda p: p["type"] != "text")
    base = base.withColumn("_before", F.coalesce(F.sum(F.size(files)).over(rows), F.lit(0)))

    def visit(part: Column, k: Column) -> Column:
        number = F.col("_before") + F.size(F.filter(F.slice("_parts", 1, k + 1), lambda p: p["type"] != "text"))
        return F.when(part["type"] == "text", F.coalesce(escape(part["text"]), F.lit(""))).otherwise(_placeholder(part, number))

    def record(part: Column, k: Column) -> Column:
        return F.struct(
            (F.col("_before") + k + 1).alias("number"),
            F.col("_turn").cast("long").alias("turn"),
            part["type"].alias("type"),
            part["ref"].alias("ref"),
            F.coalesce(part["tokens"], F.element_at(sizes, part["type"]).cast("long")).alias("tokens"),
        )

    base = base.withColumn("_files", F.transform(files, record)).withColumn("_head", F.concat(F.lit(START), escape_role(F.col("_role")), F.lit("\n")))
    base = base.withColumn("_body", F.array_join(F.transform("_parts", visit), ""))
    size = F.length("_head") + F.length("_body") + F.lit(len(END))
    base = base.withColumn("_at", F.coalesce(F.sum(size).over(rows), F.lit(0)) + F.length("_head"))
    turn = F.struct("_turn", "_role", "_parts", "_head", "_body", "_at", "_files")
    grouped = base.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    spans = F.transform(
        F.filter("_turns", lambda t: t["_role"] == "assistant"),
        lambda t: F.struct(t["_at"].cast("long").alias("start"), F.length(t["_body"]).cast("long").alias("length")),
    )
    attachments = F.flatten(F.transform("_turns", lambda t: t["_files"]))
    return grouped.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["_head"], t["_body"], F.lit(END))), "").alias("formatted"),
        spans.alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """``array<struct<role, text>>`` from a formatted conversation (placeholders stay)."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>", -1), lambda x: x != "")

    def one(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        body = F.substring(piece, F.length(head) + 2, F.length(piece) - F.length(head) - 1 - len(END))
        return F.struct(unescape_role(head).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, one)


def under_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
