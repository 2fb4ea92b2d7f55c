"""Registered queries: each applies its operator to its whole table and returns the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cropline.llm import (
    best_fit_packing, chat_windows, conversation_repair, decontaminate, kneser_ney, line_edit_join, line_frequency, ngram_jaccard, ngram_resampling,
    pii_bootstrap, simhash_trie, tier_packing, weak_toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_frequency.judge_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("n_removed_words").cast("long").alias("n_removed_words"), F.size("removed_lines").cast("long").alias("n_removed_lines"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.judge_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    model = kneser_ney.fit(docs, ~held_out)
    return kneser_ney.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model["train_tokens"]).cast("long").alias("train_tokens"),
        "base_score", "score", "perplexity")


def op4_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii_bootstrap.find_spans(table(spark, sf_dir, "documents"))
    of_kind = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    kinds = [of_kind(kind).alias(f"n_{kind}") for kind in pii_bootstrap.KINDS]
    return found.select("doc_id", *kinds, F.sha2(pii_bootstrap.listed(F.col("base")), 256).alias("base_sha256"),
                        pii_bootstrap.listed(F.col("spans")).alias("spans"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pieces_of(best_fit_packing.pack(table(spark, sf_dir, "documents")))


def op6_tier_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier_packing.pack(table(spark, sf_dir, "documents"))


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_edit_join.judge_lines(table(spark, sf_dir, "documents")).drop("text_key")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.judge_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    scored = weak_toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "<|im_end|><|im_start|>assistant ok"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_windows.read_back(chat_windows.windows(turns))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    hurt, copies = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.digest(*conversation_repair.parse(hurt, copies=copies))


def op12_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.judge_documents(table(spark, sf_dir, "documents"))


def op13_ngram_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_line_frequency, op2_decontamination, op3_kneser_ney, op4_pii_bootstrap,
        op5_best_fit_packing, op6_tier_packing, op7_line_edit_join, op8_ngram_jaccard, op9_weak_toxicity, op10_chat_windows,
        op11_conversation_repair, op12_simhash_trie,
        op13_ngram_resampling,
    )
} | {"pipeline": corpus_pipeline.run}
