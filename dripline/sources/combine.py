"""Merging report files: align, keep the latest row per campaign and day, write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dripline.functions.exprs import iso_date_text
from dripline.schema import (
    MONTH,
    PROVENANCE_COLUMNS,
    SOURCE_BLOCK,
    SOURCE_RANK,
    SOURCE_ROW,
    SOURCE_TS,
)
from dripline.sources.reports import RejectedFile, read_reports, typed_dates

_POSITION = (SOURCE_RANK, SOURCE_BLOCK, SOURCE_ROW)


def align(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables by column name; new columns append, missing ones are null."""
    combined = tables[0]
    for table in tables[1:]:
        combined = combined.unionByName(table, allowMissingColumns=True)
    return combined


def dedupe_key(columns: Sequence[str]) -> list[str]:
    """Key of a campaign-day under either naming, empty when the columns offer none."""
    for names in (
        ("Campaign ID", "Campaign Name", "Day", "Start Date"),
        ("campaign_id", "campaign_name", "day", "start_date"),
    ):
        campaign = next((name for name in names[:2] if name in columns), None)
        moment = next((name for name in names[2:] if name in columns), None)
        if campaign and moment:
            return [campaign, moment]
    return []


def _chronology(columns: Sequence[str]) -> list[str]:
    dates = [n for n in ("Day", "day", "Start Date", "start_date") if n in columns]
    return [*dates, SOURCE_TS] if dates else []


def chronological(columns: Sequence[str], position: Sequence[str] = _POSITION) -> list[Column]:
    """Ascending sort by dates and source time, nulls last, then position in the input."""
    names = [*_chronology(columns), *[name for name in position if name in columns]]
    return [F.col(f"`{name}`").asc_nulls_last() for name in names]


def dedupe_latest(df: DataFrame, position: Sequence[str] = _POSITION) -> DataFrame:
    """Keep the last row per campaign-day in chronological order.

    A null start date sorts last and so wins; null keys equal each other. The filter on row
    number 1 lets Spark drop all but one row per key in each task before the shuffle, so a
    key that holds a large share of the rows does not end up in one task.
    """
    key = dedupe_key(df.columns)
    if not key:
        return df
    names = [*_chronology(df.columns), *[name for name in position if name in df.columns]]
    latest_first = [F.col(f"`{name}`").desc_nulls_first() for name in names if name not in key]
    # The month follows from the day, so it splits no group; with it in the key, a filter on
    # months passes below the window and skips stored folders.
    groups = [*key, MONTH] if MONTH in df.columns else key
    window = Window.partitionBy(*[F.col(f"`{name}`") for name in groups]).orderBy(*latest_first)
    return (
        df.withColumn("_newest", F.row_number().over(window))
        .where(F.col("_newest") == 1)
        .drop("_newest")
    )


def render_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text, without a midnight time."""
    present = [n for n in ("Day", "Start Date", "day", "start_date") if n in df.columns]
    return df.withColumns({name: iso_date_text(F.col(f"`{name}`")) for name in present})


def drop_provenance(df: DataFrame) -> DataFrame:
    return df.drop(*PROVENANCE_COLUMNS)


def combine_reports(
    spark: SparkSession,
    paths: Sequence[str],
    in_order: bool = True,
    multi_line: bool = True,
    skip_bad: bool = False,
    rejected: list[RejectedFile] | None = None,
) -> DataFrame:
    """Latest row per campaign-day over all files, with dates as text.

    ``skip_bad`` and ``rejected`` are those of :func:`read_reports`.

    ``in_order`` sorts chronologically; the input position ends the sort key, so days that
    hold many rows still spread over several range partitions.
    """
    read = read_reports(spark, paths, multi_line, skip_bad, rejected)
    latest = dedupe_latest(typed_dates(read))
    if in_order:
        latest = latest.orderBy(*chronological(latest.columns))
    return drop_provenance(render_dates(latest))
