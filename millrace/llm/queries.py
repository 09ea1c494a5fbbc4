"""One query for each operator, over the whole of its tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chat, decontam, linedup, mixing, pseudonym, quality, repeats, rules, simhash, tokens
from millrace.llm.common import table


#: Target shares of the mixture; what is not named divides the rest in its natural proportion.
MIX = {"_source": {"src0": 0.2, "src1": 0.08}, "_lang": {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}, "_topic": {"prose": 0.7}}


def op1_rake_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's cell, its weight under the raked shares and whether the draw keeps it. Null texts have no words; null categories are categories."""
    rows = mixing.mixture(table(spark, sf_dir, "documents"), targets=MIX, tolerance=1e-13)
    return rows.select(F.col("id").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "kept")


def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measurements and failure bits, and what the base rules and the current policy make of them. Null texts have no words."""
    entries = rules.ledger(table(spark, sf_dir, "documents"))
    base = rules.passes("base")
    kept = base & rules.passes("2026-11")
    return entries.select(F.col("id").alias("doc_id"), *rules.MEASURES, (~base).alias("base_failed"), kept.alias("kept"), F.col("failed").alias("failed_bits"))


def op3_pfor_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files, read back from them. Null texts are empty."""
    rows = tokens.token_rows(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return rows.withColumnRenamed("id", "doc_id")


def op4_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every id its lines with a word, the lines they are linked to and the classes they are in. Null texts have no lines."""
    return linedup.by_document(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_repeat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated 400-byte strings, by digest, and its shorter repeated passages. Null texts are empty."""
    rows = repeats.without_repeats(table(spark, sf_dir, "documents"), with_text=False)
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages")


def op6_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words that stand in windows of benchmark items, and those items. Null texts have no words."""
    rows = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op7_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal numbers, dates and addresses permuted within their format. Null texts stay null."""
    rows = pseudonym.pseudonymize(table(spark, sf_dir, "documents"), "corpus-2026-11")
    return rows.withColumnRenamed("id", "doc_id")


def op8_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality by a model fitted on labels that are not held out. Null and empty texts have a score too."""
    held_out = lambda c: F.crc32(c.cast("string")) % 5 == 0
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~held_out(F.col("doc_id"))))
    rows = quality.score(docs, model)
    return rows.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_simhash_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that near fingerprints reach. Null texts have fingerprint zero."""
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_typed_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one more, formatted and read back, by digest. Null roles and texts are empty."""
    said = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    chats = chat.format_chats(rows.union(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts")))
    read = chats.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("lost"))
    lines = F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
        F.length("lost").cast("long").alias("loss_chars"), F.sha2("lost", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {f.__name__: f for f in (op1_rake_mixture, op2_rule_ledger, op3_pfor_tokens, op4_line_edit_join, op5_repeat_tree, op6_winnow_decontam, op7_feistel_pseudonyms, op8_nbsvm_quality, op9_simhash_variants, op10_typed_chat)}
