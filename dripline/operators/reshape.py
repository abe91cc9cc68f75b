"""Journey x channel tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dripline.config import FIXED_CHANNELS, MetricConfig
from dripline.functions.exprs import count_text, count_text_or_blank
from dripline.operators.aggregates import channel_cube, journey_channel_totals
from dripline.session import materialize

PIVOT_METRICS = ("sent", "delivered", "clicks", "orders", "cost", "gtv")

# A wider table than this is refused rather than cut short.
MAX_PIVOT_CHANNELS = 1_000


def channel_values(df: DataFrame) -> list[str]:
    """Distinct channels, sorted; refuses a domain too wide to become columns."""
    rows = df.select("channel").distinct().limit(MAX_PIVOT_CHANNELS + 1).collect()
    if len(rows) > MAX_PIVOT_CHANNELS:
        raise ValueError(f"more than {MAX_PIVOT_CHANNELS} channels: use the long form instead")
    return sorted(row["channel"] for row in rows if row["channel"] is not None)


def _cell(metric: str, channel: str) -> Column:
    """Sum of a metric over one channel, 0 where there is none."""
    value = F.when(F.col("channel") == channel, F.col(metric)).otherwise(F.lit(0))
    return F.sum(value).cast("double")


def metric_pivot(
    totals: DataFrame, metric: str, channels: Sequence[str], total: str = "Total"
) -> DataFrame:
    """Journey x channel matrix of one metric, with the row sum over all channels present.

    ``totals`` holds one row per (journey, channel). The total is summed from the rows, so a
    channel left out of ``channels`` still counts.
    """
    cells = [_cell(metric, channel).alias(channel) for channel in channels]
    row_sum = F.sum(metric).cast("double").alias(total)
    return totals.groupBy("journey_name").agg(*cells, row_sum)


def channel_pivots(
    df: DataFrame, config: MetricConfig, channels: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """One matrix per metric. Give ``channels`` when known, which saves finding them.

    Otherwise the totals are written once, and both the channel list and the six matrices
    read that small table rather than the reports.
    """
    totals = journey_channel_totals(df, config)
    if channels is None:
        totals = materialize(totals)
        channels = channel_values(totals)
    return {metric: metric_pivot(totals, metric, channels) for metric in PIVOT_METRICS}


def fixed_pivots(
    df: DataFrame, extra_channels: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Sent, delivered and orders matrices that always show the four fixed channels."""
    cube = channel_cube(df, ["journey_name"], ("sent", "delivered", "ct_conversions"))
    columns = list(dict.fromkeys([*FIXED_CHANNELS, *extra_channels]))
    labels = {"sent": "Total_Sent", "delivered": "Total_Delivered", "orders": "Total_Conversions"}
    return {metric: metric_pivot(cube, metric, columns, label) for metric, label in labels.items()}


_SUFFIXES = {"sent": "Sent", "delivered": "Delivered", "orders": "Conversions"}


def channel_breakdown_wide(df: DataFrame, channels: Sequence[str] = FIXED_CHANNELS) -> DataFrame:
    """All three matrices side by side, one row per journey, in one aggregate."""
    cube = channel_cube(df, ["journey_name"], ("sent", "delivered", "ct_conversions"))
    cells = []
    for metric, suffix in _SUFFIXES.items():
        cells += [_cell(metric, name).alias(f"{name}_{suffix}") for name in channels]
        cells.append(F.sum(metric).cast("double").alias(f"Total_{suffix}"))
    return cube.groupBy("journey_name").agg(*cells)


def channel_breakdown(df: DataFrame, total_over_fixed: bool = False) -> DataFrame:
    """Text cells for the four channels, blank when zero, with totals.

    Totals cover all channels, or only the four under ``total_over_fixed``.
    """
    wide = channel_breakdown_wide(df)
    columns = [F.col("journey_name").alias("row_labels")]
    for suffix in _SUFFIXES.values():
        names = [f"{channel}_{suffix}" for channel in FIXED_CHANNELS]
        columns += [count_text_or_blank(F.col(name)).alias(name) for name in names]
        total = F.col(f"Total_{suffix}")
        if total_over_fixed:
            total = sum((F.col(name) for name in names[1:]), F.col(names[0]))
        columns.append(count_text(total).alias(f"Total_{suffix}"))
    return wide.select(*columns)
