"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps its measurement and, in one long, a bit for each rule
that the document fails. Policies are versioned masks over these bits; applying another one, or asking what a rule does
on its own, reads the ledger and never a text. DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD_GAP = "[ \\t-\\r]+"
WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Fails where ``fails`` is true; it reads the measurements by name."""

    name: str
    fails: str


#: The place of a rule is its bit: rules are only ever added at the end.
RULES = (
    Rule("few_words", "n_words < 20"),
    Rule("repeated_words", "100 * n_repeat_words > 30 * n_words"),
    Rule("symbols", "5 * n_symbols > n_words"),
    Rule("repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule("word_length", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", "5 * n_shouts > n_words"),
)
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_words"),
    "2026-11": ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length", "shouting"),
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is evaluated once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more, from the hashes in order."""

    def marked(ordered: Column) -> Column:
        same = lambda x, j: (x.h == F.get(ordered, j - 1).h) | (x.h == F.get(ordered, j + 1).h)
        return F.array_sort(F.transform(F.filter(ordered, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x.i))

    def total(starts: Column) -> Column:
        own = F.transform(starts, lambda s, j: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, j + 1) - s, F.lit(WINDOW))))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(let(ordered, marked), total))


def _of_words(text: Column) -> Callable[[Column], Column]:
    def measures(words: Column) -> Column:
        hashes = F.transform(words, lambda w: F.xxhash64(w))
        starts = lambda h: F.when(F.size(h) >= WINDOW, F.sequence(F.lit(1), F.size(h) - (WINDOW - 1))).otherwise(F.array().cast("array<int>"))
        windows = let(hashes, lambda h: F.transform(starts(h), lambda i: F.xxhash64(F.slice(h, i, WINDOW))))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            let(windows, _covered).alias("n_repeat_words"),
        )

    return measures


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a struct ``measures``. A null text counts as an empty one: no words, no lines."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    words = let(F.array_remove(F.split(text, WORD_GAP), ""), _of_words(text))
    lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]")),
        lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")),
    )
    chars = F.struct(F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"), F.regexp_count(text, F.lit("!")).cast("long").alias("n_shouts"))
    return docs.select("*", words.alias("_words"), lines.alias("_lines"), chars.alias("_chars"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shouts")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, the measurements, failed long): bit i of ``failed`` is set where rule i fails. A row for each row.

    Words are runs of characters other than space and 0x09-0x0D. Null and empty texts have no words and so fail
    few_words. Ids may repeat or be null. Of other columns nothing is read, whatever their names.
    """
    rows = measure(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    flat = rows.select(F.col("_id").alias("id"), "_words.*", "_lines.*", "_chars.*").select("id", *MEASURES)
    return flat.withColumn("failed", failed_bits(rules))


def failed_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    """The failure bits of a row with the measurements; at most 63 rules."""
    bits = [F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, r in enumerate(rules)]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    return failed


def mask_of(policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    names = POLICIES[policy] if isinstance(policy, str) else policy
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in names)


def passes(policy: str | tuple[str, ...], failed: str = "failed", rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col(failed).bitwiseAND(F.lit(mask_of(policy, rules)).cast("long")) == 0


def ablation(entries: DataFrame, policy: str | tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row for each rule of the policy: documents that fail it, that fail it alone, and that would be kept without it.

    One pass over the ledger: equal bit patterns are counted first, and the rules are then read off the patterns, of
    which there are at most two to the number of rules. An empty ledger gives zeros.
    """
    mask = mask_of(policy, rules)
    patterns = entries.select(F.col("failed").bitwiseAND(F.lit(mask).cast("long")).alias("p")).groupBy("p").count()
    named = [(r.name, 1 << i) for i, r in enumerate(rules) if mask >> i & 1]
    sums = []
    for name, bit in named:
        hit = F.col("p").bitwiseAND(F.lit(bit).cast("long")) != 0
        alone = F.col("p") == bit
        sums += [F.struct(F.lit(name).alias("rule"), F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("n_failed"), F.coalesce(F.sum(F.when(alone, F.col("count"))), F.lit(0)).alias("n_alone"), F.coalesce(F.sum(F.when((F.col("p") == 0) | alone, F.col("count"))), F.lit(0)).alias("n_kept_without"))]
    return patterns.agg(F.array(*sums).alias("r")).select(F.inline("r"))


def keep_by_policy(docs: DataFrame, policy: str = "2026-11", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs, with all their columns, that pass the policy by the ledger's failure bits."""
    columns = docs.columns
    rows = measure(docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col(text_col).alias("_text")), "_text")
    flat = rows.select("_row", "_words.*", "_lines.*", "_chars.*")
    return flat.withColumn("_failed", failed_bits(rules)).where(passes(policy, "_failed", rules)).select("_row.*")
