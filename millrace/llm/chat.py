"""Chat formatting of typed content parts.

A visitor flattens the parts of each turn in order: text is escaped, and image, audio and document parts become
numbered placeholders whose attachment reference and expanded token count are recorded beside the text. Turns are set
between control strings, all of which begin with ``<|``. DataFrame functions only.

Escaping: a backslash becomes ``\\s`` and ``<`` becomes ``\\l``. Escaped text holds no ``<``, so no control string can stand
in it, nor come about where the texts of two parts meet; every backslash in it begins one of the two pairs, so undoing
``\\l`` and then ``\\s`` gives the text back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PART = "struct<kind:string,text:string,ref:string,n_tokens:long>"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


#: What each kind of part becomes, given the part and its number among the conversation's attachments.
VISITORS: dict[str, Callable[[Column, Column], Column]] = {
    "text": lambda part, n: escape(F.coalesce(part.text, F.lit(""))),
    "image": lambda part, n: F.concat(F.lit("<|image:"), n.cast("string"), F.lit("|>")),
    "audio": lambda part, n: F.concat(F.lit("<|audio:"), n.cast("string"), F.lit("|>")),
    "document": lambda part, n: F.concat(F.lit("<|document:"), n.cast("string"), F.lit("|>")),
}


def visit(part: Column, n: Column) -> Column:
    """A part of a kind without a visitor is taken as text, so nothing that was said is lost."""
    out = VISITORS["text"](part, n)
    for kind in ("image", "audio", "document"):
        out = F.when(part.kind == kind, VISITORS[kind](part, n)).otherwise(out)
    return out


def is_attachment(part: Column) -> Column:
    return F.coalesce(part.kind.isin("image", "audio", "document"), F.lit(False))


def text_part(text: Column) -> Column:
    """A single text part, for tables with plain texts."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens")))


def format_chats(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss array<struct<at, n>>, attachments array<struct<n, turn, kind, ref, n_tokens>>, n_expanded).

    One row for each conversation: its turns in the order of ``turn``, ties by role and then by content. ``loss`` are
    the 1-based places and lengths, in code points of ``formatted``, of what the trained role said. Null roles and null
    texts are empty, null part lists have no parts, and rows of a null conversation form one conversation. An empty
    table gives no row. The conversation is the unit of output, so its turns meet in one row.
    """
    clean = rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(parts), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    # Attachments and characters before a turn are running sums, so a conversation's cost follows its length.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "parts")
    before = lambda c: F.coalesce(F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    counted = clean.withColumn("no", F.row_number().over(order)).withColumn("first", before(F.size(F.filter("parts", is_attachment))))
    number = lambda j: F.col("first") + F.size(F.filter(F.slice("parts", 1, j), is_attachment))
    plain = F.array_join(F.transform("parts", lambda p: VISITORS["text"](p, F.lit(0))), "")
    typed = F.array_join(F.transform("parts", lambda p, j: visit(p, number(j))), "")
    said = counted.withColumn("said", F.when(F.exists("parts", is_attachment), typed).otherwise(plain)).withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS)))
    placed = said.withColumn("at", before(F.length("head") + F.length("said") + len(END)))
    attached = F.transform(F.filter("parts", is_attachment), lambda p, j: F.struct((F.col("first") + j).cast("long").alias("n"), F.col("turn").cast("long").alias("turn"), p.kind.alias("kind"), p.ref.alias("ref"), F.coalesce(p.n_tokens, F.lit(0)).cast("long").alias("n_tokens")))
    piece = F.struct("no", F.concat("head", "said", F.lit(END)).alias("piece"), (F.col("role") == trained).alias("on"), (F.col("at") + F.length("head") + 1).alias("at"), F.length("said").cast("long").alias("n"), attached.alias("attached"))
    talks = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    return talks.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("formatted"),
        F.transform(F.filter("pieces", lambda p: p.on), lambda p: F.struct(p.at.alias("at"), p.n.alias("n"))).alias("loss"),
        F.flatten(F.transform("pieces", lambda p: p.attached)).alias("attachments"),
    ).withColumn("n_expanded", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x.n_tokens))


#: A place between an attachment's placeholder and what stands beside it.
_BESIDE = "(?=<\\|)|(?<=<\\|(?:image|audio|document):[0-9]{1,9}\\|>)"


def _read_parts(said: Column) -> Column:
    """array<struct<kind, text, n>>: texts unescaped, attachments by their number; texts that met are one."""
    is_mark = lambda x: x.startswith("<|")

    def part(x: Column) -> Column:
        kind = F.when(is_mark(x), F.regexp_extract(x, "^<\\|([a-z]+):", 1)).otherwise("text")
        number = F.when(is_mark(x), F.regexp_extract(x, ":([0-9]+)\\|>$", 1).cast("long"))
        return F.struct(kind.alias("kind"), F.when(~is_mark(x), unescape(x)).alias("text"), number.alias("n"))

    return F.transform(F.filter(F.split(said, _BESIDE), lambda x: x != ""), part)


def _text_of(parts: Column) -> Column:
    return F.array_join(F.transform(F.filter(parts, lambda p: p.kind == "text"), lambda p: p.text), "")


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text, parts>> of a formatted conversation.

    ``text`` is what was said without attachments; ``parts`` has both in order, so that a text which looks like a
    placeholder and a placeholder are told apart.
    """
    # Each turn but the last is followed by the next one's mark; no control string can stand inside a text.
    turns = F.filter(F.split(formatted, "<\\|turn\\|>"), lambda x: x != "")
    cut = lambda x: F.split(F.left(x, F.length(x) - len(END)), "<\\|says\\|>")
    read = F.transform(F.transform(turns, cut), lambda x: F.struct(unescape(F.element_at(x, 1)).alias("role"), _read_parts(F.element_at(x, 2)).alias("parts")))
    return F.transform(read, lambda t: F.struct(t.role.alias("role"), _text_of(t.parts).alias("text"), t.parts.alias("parts")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, joined; attachments are left out."""
    return F.array_join(F.transform(loss, lambda s: _text_of(_read_parts(F.substring(formatted, s.at.cast("int"), s.n.cast("int"))))), "")
