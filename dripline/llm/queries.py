"""One query per text operator, each over its whole tables with production settings."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from dripline.llm import (
    alignment,
    chat_format,
    decontaminate,
    host_rules,
    jaccard_join,
    language,
    merkle,
    mixing,
    packing,
    quality_trees,
    secret_scan,
    token_count,
    toxicity,
)
from dripline.llm.support import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_unopened"
    )


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_components(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def with_planted_turns(conversations: DataFrame) -> DataFrame:
    """The conversations and number -7, whose texts are control strings."""
    planted = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(planted)


def chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = with_planted_turns(table(spark, sf_dir, "conversations"))
    return chat_format.read_back(chat_format.format_turns(messages))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.token_counts(
        table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    )


def benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


def source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, p_good, p_low, p_toxic, rate) of each document."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(table(spark, sf_dir, "documents"), labelled, mixing.TARGETS)
    shares = [
        F.coalesce(F.col("domains")[name], F.lit(0.0)).alias(f"p_{name}") for name in mixing.TARGETS
    ]
    return mixed.select("doc_id", "n_tokens", *shares, "rate")


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all documents; of a third of them the text is presented in lower case."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", ascii_uppercase, ascii_lowercase)
    text = F.when(tampered, lowered).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), presented={"text": text})


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(
        table(spark, sf_dir, "documents"),
        tokenizer_path("byte_bpe_50k.json"),
        tokenizer_path("piece_bpe_32k.model"),
    )


def sequence_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


QUERIES: dict[str, Query] = {
    "op1_secret_scans": secret_scans,
    "op2_language_id": language_id,
    "op3_toxicity": toxicity_scores,
    "op4_quality_classifier": quality_scores,
    "op5_ngram_jaccard_join": near_duplicates,
    "op6_quality_rules": quality_rules,
    "op7_chat_formatting": chat_formatting,
    "op8_token_counts": token_counts,
    "op9_benchmark_decontamination": benchmark_decontamination,
    "op10_mixing": source_mixing,
    "op11_merkle_manifest": merkle_manifest,
    "op12_token_alignment": token_alignment,
    "op13_packing": sequence_packing,
}

ALL_QUERIES: dict[str, Query] = {**QUERIES, "pipeline": corpus_pipeline.run}
