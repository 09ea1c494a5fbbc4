"""Benchmark decontamination by winnowing.

Of every ``window - k + 1`` consecutive k-grams of words the one with the least hash is a fingerprint. Two spans of
``window`` equal words hold equal k-grams and so choose the same one: joining the fingerprints of documents and
benchmark items finds every such span. Each hit is extended word by word to both sides, and counts where the run of
equal words is at least a window long. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ascii_lower, materialize, small
from millrace.llm.rules import let

#: Characters between words, after lower-casing or before it: ASCII other than letters and digits.
GAP = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10
K = 5
#: Fingerprints of the benchmark up to which they are broadcast; beyond that the join is by shuffle.
BROADCAST_ROWS = 500_000


def words_of(text: Column) -> Column:
    """Words as they stand in the text; an absent text has none."""
    return F.array_remove(F.split(F.coalesce(text.cast("string"), F.lit("")), GAP), "")


def _grams(hashes: Column, k: int) -> Column:
    """The hash of every k consecutive words, by its first word's place."""

    def of(h: Column) -> Column:
        places = F.when(F.size(h) >= k, F.sequence(F.lit(1), F.size(h) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.slice(h, i, k)))

    return let(hashes, of)


def word_hashes(words: Column) -> Column:
    """lower() reaches beyond A-Z, so that it only ever makes more words alike; the extension compares exactly."""
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def chosen(grams: Column, span: int) -> Column:
    """Where the least gram of each ``span`` consecutive ones stands, the first if several are equal; each place once.
    With fewer grams, the least of all."""

    def of(g: Column) -> Column:
        starts = F.when(F.size(g) == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(g) - (span - 1))))
        at = lambda i, part: (i - 1 + F.array_position(part, F.array_min(part))).cast("int")
        return F.array_distinct(F.transform(starts, lambda i: at(i, F.slice(g, i, span))))

    return let(grams, of)


def marks_of(hashes: Column, k: int, span: int) -> Column:
    """array<struct<mark, at>>: the chosen grams and the places of their first words."""
    return let(_grams(hashes, k), lambda g: F.transform(chosen(g, span), lambda i: F.struct(F.element_at(g, i).alias("mark"), i.alias("at"))))


def items_of(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item_id, words lower-cased, n): each item with words once, however often its row stands there."""
    rows = benchmark.select(F.col(item_col).alias("item_id"), F.transform(words_of(F.col(text_col)), ascii_lower).alias("item_words"))
    return rows.where(F.size("item_words") > 0).distinct()


def hit_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, row, item_id, s, e): runs of document words [s, e), counted from 1, equal to item words and a window long.

    ``row`` is the hash of the text, which tells rows with equal ids apart. Items of fewer words than a window are
    looked for whole: their one gram is hashed at their own length. Nulls have no words.
    """
    items = materialize(items_of(benchmark, item_col, item_text, window))
    span, ahead = window - k + 1, window - k
    # Two equal windows choose the gram at the same place of both, so the chosen places of either side are enough.
    marks = items.where(F.size("item_words") >= window).select("item_id", "item_words", F.inline(marks_of(word_hashes(F.col("item_words")), k, span)))
    index = materialize(marks.select("mark", "item_id", *_context(F.col("item_words"), F.col("at"), ahead, window, "item_")))

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.select("id", F.xxhash64("text").alias("row"), "text")
    # Only names and places meet the index; a document's words are fetched once, for the places that were found.
    places = texts.select("id", "row", F.inline(marks_of(word_hashes(words_of(F.col("text"))), k, span)))
    met = places.join(small(index.select("mark").distinct(), BROADCAST_ROWS), "mark", "left_semi").select("id", "row", "at", F.lit(window).alias("n"))
    found = _said_at(texts, met, lambda words, a: F.struct(a.at.alias("at"), *_context(words, a.at, ahead, window)))
    found = found.withColumn("mark", F.xxhash64(word_hashes(F.slice("context", F.col("left") + 1, F.lit(k))))).join(small(index, BROADCAST_ROWS), "mark")
    # Step by step away from the gram: how many words stay equal on each side, and the gram itself, word for word.
    same = lambda d: F.get("context", F.col("left") + d) == F.get("item_context", F.col("item_left") + d)
    gram = F.forall(F.sequence(F.lit(0), F.lit(k - 1)), lambda d: F.coalesce(same(d), F.lit(False)))
    reach = lambda steps: F.aggregate(steps, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, d: F.when(a.on & F.coalesce(same(d), F.lit(False)), F.struct((a.n + 1).alias("n"), F.lit(True).alias("on"))).otherwise(F.struct(a.n.alias("n"), F.lit(False).alias("on"))), lambda a: a.n)
    inside = lambda d: (F.col("left") + d >= 0) & (F.col("item_left") + d >= 0)
    back = F.filter(F.sequence(F.lit(-1), F.lit(k - window), F.lit(-1)), inside)
    runs = found.where(gram).select("id", "row", "item_id", "at", reach(back).alias("l"), reach(F.sequence(F.lit(k), F.lit(window - 1))).alias("r"))
    spans = runs.where(F.col("l") + F.col("r") + k >= window).select("id", "row", "item_id", (F.col("at") - F.col("l")).alias("s"), (F.col("at") + k + F.col("r")).alias("e"))

    short = items.where(F.size("item_words") < window).select("item_id", "item_words", F.size("item_words").alias("n"))
    short = materialize(short.select("item_id", "item_words", "n", F.xxhash64(word_hashes(F.col("item_words"))).alias("mark")))
    lengths = [r.n for r in short.select("n").distinct().orderBy("n").collect()]  # fewer than a window of them
    if lengths:
        keyed = lambda n: F.transform(_grams(F.col("hashes"), n), lambda g, i: F.struct(g.alias("mark"), (i + 1).alias("at"), F.lit(n).alias("n")))
        keys = F.flatten(F.array(*map(keyed, lengths)))
        grams = texts.select("id", "row", word_hashes(words_of(F.col("text"))).alias("hashes")).select("id", "row", F.inline(keys))
        met = grams.join(small(short.select("mark", "n").distinct(), BROADCAST_ROWS), ["mark", "n"], "left_semi").select("id", "row", "at", "n")
        said = _said_at(texts, met, lambda words, a: F.struct(a.at.alias("at"), F.transform(F.slice(words, a.at, a.n), ascii_lower).alias("item_words")))
        whole = said.join(small(short, BROADCAST_ROWS), "item_words")
        spans = spans.union(whole.select("id", "row", "item_id", F.col("at").alias("s"), (F.col("at") + F.col("n")).alias("e")))
    return spans.distinct()


def _context(words: Column, at: Column, ahead: int, window: int, name: str = "") -> list[Column]:
    """The lower-cased words around a gram that one window over it can reach, and how many of them stand before it."""
    left = F.least(at - 1, F.lit(ahead))
    return [left.alias(f"{name}left"), F.transform(F.slice(words, at - left, left + window), ascii_lower).alias(f"{name}context")]


def _said_at(texts: DataFrame, met: DataFrame, of: Callable[[Column, Column], Column]) -> DataFrame:
    """(id, row, fields of what ``of`` makes of the document's words and a place) for each found place (id, row, at, n).

    Only documents with such places are read again, and what is made of a place is a few words, so that long documents
    with many places stay in proportion.
    """
    asked = materialize(met.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set(F.struct("at", "n")).alias("asked")))
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    held = texts.join(small(asked.select("_id", "_row"), BROADCAST_ROWS), same, "left_semi").join(asked, same)
    return held.select("id", "row", F.inline(let(words_of(F.col("text")), lambda words: F.transform("asked", lambda a: of(words, a)))))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(id, n_words, n_hit, items array<string>): the words that stand in a run shared with an item, and those items.

    A row for each row of docs; rows with equal ids and texts are alike. Null and empty texts have no words.
    """
    spans = materialize(hit_spans(docs, benchmark, id_col, text_col, item_col, item_text, window, k))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set(F.struct("s", "e")), lambda x: F.sequence(x.s, x.e - 1))))
    hits = materialize(spans.groupBy("id", "row").agg(F.size(covered).cast("long").alias("n_hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.select(F.col("id"), F.xxhash64("text").alias("row"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    hits = hits.select(F.col("id").alias("_hit_id"), F.col("row").alias("_hit_row"), "n_hit", "items")
    joined = rows.join(hits, rows.id.eqNullSafe(hits["_hit_id"]) & (rows.row == hits["_hit_row"]), "left")
    return joined.select("id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, all columns kept, that share no window with an item."""
    hits = materialize(hit_spans(docs, benchmark, id_col, text_col, **more).select(F.col("id").alias("_hit_id"), F.col("row").alias("_hit_row")).distinct())
    same = F.col(id_col).eqNullSafe(F.col("_hit_id")) & (F.xxhash64(F.col(text_col).cast("string")) == F.col("_hit_row"))
    return docs.join(hits, same, "left_anti")
