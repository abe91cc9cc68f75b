"""Writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from dripline.schema import MONTH
from dripline.sources import versions


def write_combined(combined: DataFrame, path: str) -> None:
    """Combined reports as CSV part files with a header, replacing what was there."""
    combined.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Any result table as csv, parquet, json or orc."""
    if fmt not in ("csv", "parquet", "json", "orc"):
        raise ValueError(f"unsupported format: {fmt}")
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"')
    writer.format(fmt).save(path)


def replace_table(df: DataFrame, path: str) -> None:
    """A result table in place of the one below ``path``, by one switch: whoever reads it with
    :func:`current_table` sees the old or the new rows, also if this job dies."""
    versions.replace(df, path)


def current_table(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`replace_table` wrote last."""
    found = versions.read(spark, path)
    if found is None:
        raise FileNotFoundError(f"no table was written to {path}")
    return found


def with_month(df: DataFrame, day: str = "day") -> DataFrame:
    """Add the month of a date column as a number such as 202401; null without a day."""
    if day not in df.columns:
        return df.withColumn(MONTH, F.lit(None).cast("int"))
    moment = F.col(f"`{day}`")
    return df.withColumn(MONTH, F.year(moment) * 100 + F.month(moment))


def write_by_month(df: DataFrame, path: str, day: str = "day") -> None:
    """Parquet in folders by month, so that date ranges skip folders.

    The rebalance hint groups rows by month without pinning a month to one task: adaptive
    execution splits large months and merges small ones.
    """
    balanced = with_month(df, day).hint("rebalance", F.col(MONTH))
    balanced.write.mode("overwrite").partitionBy(MONTH).parquet(path)
