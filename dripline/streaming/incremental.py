"""Keeping the latest-row-per-campaign-day table current as report files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import (
    BinaryType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

from dripline.schema import MONTH
from dripline.sources.combine import dedupe_latest, drop_provenance, render_dates
from dripline.sources.reports import NoReportRowsError, read_reports, typed_dates
from dripline.sources.sinks import write_by_month

BATCH_COLUMN = "batch_id"

_FILE_SCHEMA = StructType(
    [
        StructField("path", StringType()),
        StructField("modificationTime", TimestampType()),
        StructField("length", LongType()),
        StructField("content", BinaryType()),
    ]
)


def arrivals(
    spark: SparkSession, folder: str, pattern: str, max_files_per_batch: int
) -> DataFrame:
    """The names of arriving files as a stream."""
    return (
        spark.readStream.format("binaryFile")
        .schema(_FILE_SCHEMA)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .load(folder)
        .select("path")
    )


def start_incremental_combine(
    spark: SparkSession,
    folder: str,
    log_path: str,
    checkpoint_path: str,
    pattern: str = "report*.csv",
    max_files_per_batch: int = 1_000,
    once: bool = True,
) -> StreamingQuery:
    """Append the latest rows of each batch of new report files to a log of batches.

    The stream carries file names only, at most ``max_files_per_batch`` of them; the batch
    function reads those files the way the batch job does, so headers may drift. Each batch
    overwrites its own folder, which makes a replay after a failure harmless. Reports may
    correct any earlier day, so the streaming state is the log itself and no watermark
    applies. ``once`` handles what is there and stops.
    """
    def append_batch(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(row["path"] for row in batch.collect())
        if not paths:
            return
        try:
            rows = read_reports(batch.sparkSession, paths)
        except NoReportRowsError:
            return
        latest = dedupe_latest(typed_dates(rows))
        write_by_month(latest, f"{log_path}/{BATCH_COLUMN}={batch_id}", "Day")

    files = arrivals(spark, folder, pattern, max_files_per_batch)
    writer = files.writeStream.foreachBatch(append_batch).option(
        "checkpointLocation", checkpoint_path
    )
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def current_rows(spark: SparkSession, log_path: str) -> DataFrame:
    """Latest row per campaign-day over all batches so far, with provenance.

    A filter on ``report_month`` reads and compares those months only. Every batch was reduced
    before it was written, so the rows of a log of one batch are not compared again.
    """
    log = spark.read.option("mergeSchema", True).parquet(log_path)
    mark = f"/{BATCH_COLUMN}="
    batches = {x.rpartition(mark)[2].split("/")[0] for x in log.inputFiles() if mark in x}
    log = log.drop(BATCH_COLUMN)
    return log if len(batches) == 1 else dedupe_latest(log)


def current_table(spark: SparkSession, log_path: str) -> DataFrame:
    """The combined table as of the last finished batch."""
    return drop_provenance(render_dates(current_rows(spark, log_path).drop(MONTH)))


def compact(spark: SparkSession, log_path: str, new_log_path: str) -> None:
    """Write the current rows as the first batch of a new log."""
    rows = current_rows(spark, log_path).drop(MONTH)
    write_by_month(rows, f"{new_log_path}/{BATCH_COLUMN}=-1", "Day")
