"""A training corpus from the documents table: filter, deduplicate, decontaminate, redact, mix.

Each stage takes (spark, docs, sf_dir), works on all documents its predecessor kept, and returns a
DataFrame with the columns of documents; the last one adds the rate at which each is to be drawn.
Between the stages documents are written as Parquet in the shared folder and read again, so that a
lost executor costs one stage at most.

What the stages do with unusual rows: a null text is empty. The quality stage judges every row for
itself. Of rows that link, those of one component, the row with the smallest id stays, and of
equal ids the first by content; rows without text link with nothing, so they all stay. The other
stages keep one row for each row they get. Further columns, whatever their names, are carried along.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from dripline.llm import (  # noqa: E402
    decontaminate,
    jaccard_join,
    mixing,
    quality_trees,
    secret_scan,
)
from dripline.llm.support import table  # noqa: E402
from dripline.session import new_work_path  # noqa: E402

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# Shares of tokens. Documents of low quality are gone by then, so that domain has no target.
MIX_TARGETS = {"good": 0.92, "toxic": 0.08}


def _columns(docs: DataFrame) -> list[str]:
    return [f"`{name}`" for name in docs.columns]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    # The row travels as one struct, so that no column of it can meet a name used here.
    rows = docs.select("doc_id", "text", F.struct(*_columns(docs)).alias("row"))
    scored = quality_trees.with_score(rows, table(spark, sf_dir, "labels"), "score")
    return scored.where(F.col("score") >= quality_trees.THRESHOLD).select("row.*")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one whose id names the group."""
    return jaccard_join.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages, by the contamination rule of the operator."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret replaced by its kind, also those below layers of encoding."""
    redacted = secret_scan.redact(docs)
    if "n_chars" in docs.columns:
        length = F.length("text").cast(docs.schema["n_chars"].dataType)
        redacted = redacted.withColumn("n_chars", F.coalesce(length, F.col("n_chars")))
    return redacted.select(*_columns(docs))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the rate at which to draw each, ``mix_rate``."""
    labelled = mixing.label_domains(table(spark, sf_dir, "labels"))
    return mixing.with_rate(docs, labelled, MIX_TARGETS)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", keep_good),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("mixing", mix_to_targets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_work_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


# The classifiers and the decoding of secrets are beyond SQL.
ORACLE_SQL: str | None = None
