"""Dimension lookups: channel price and journey segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from dripline.config import UNKNOWN_SEGMENT, MetricConfig

# Longer lists would make the statement text unwieldy.
_INLINE_ROWS = 1_000


def local_table(
    spark: SparkSession, rows: Sequence[tuple[str, ...]], columns: Sequence[str]
) -> DataFrame:
    """Text rows as a table whose size the optimizer knows.

    No broadcast hint anywhere: an inline table below Spark's broadcast threshold is broadcast
    because its size is known to be small, and a longer list is joined by its measured size.
    """
    if not rows or len(rows) > _INLINE_ROWS:
        return spark.createDataFrame(rows, ", ".join(f"{name} string" for name in columns))
    # Named markers: positional ones do not keep their order in longer inline tables.
    width = len(columns)
    marks = [f":p{i}" for i in range(len(rows) * width)]
    tuples = ", ".join(f"({', '.join(marks[i : i + width])})" for i in range(0, len(marks), width))
    args = {f"p{i}": value for i, value in enumerate(value for row in rows for value in row)}
    return spark.sql(f"SELECT * FROM VALUES {tuples} AS t({', '.join(columns)})", args=args)


def price_list(spark: SparkSession, config: MetricConfig) -> DataFrame:
    """(channel, unit_cost) with exact decimal prices."""
    rows = [(channel, str(price)) for channel, price in config.unit_costs.items()]
    prices = local_table(spark, rows, ("channel", "price"))
    return prices.selectExpr("channel", "cast(price AS decimal(9,4)) AS unit_cost")


def segment_list(spark: SparkSession, config: MetricConfig) -> DataFrame:
    """(journey_name, user_type, user_channel)."""
    rows = [(name, *segment) for name, segment in config.segments.items()]
    return local_table(spark, rows, ("journey_name", "user_type", "user_channel"))


def with_cost(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Add ``cost`` = sent x price of the channel; a channel without a price costs nothing.

    The product is a decimal, so sums of it do not depend on row order. Aggregates call this
    on rows already summed per channel; the join then sees groups, not messages.
    """
    kept = [f"`{name}`" for name in df.columns if name != "cost"]
    cost = "cast(sent AS decimal(28,4)) * coalesce(unit_cost, cast(0 AS decimal(9,4))) AS cost"
    priced = df.join(price_list(df.sparkSession, config), "channel", "left")
    return priced.selectExpr(*kept, cost)


def with_segments(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Add ``user_type`` and ``user_channel``; an unmapped journey is ``Unknown``."""
    kept = [f"`{name}`" for name in df.columns if name not in ("user_type", "user_channel")]
    segments = segment_list(df.sparkSession, config)
    labelled = df.select(*kept).join(segments, "journey_name", "left")
    return labelled.selectExpr(
        *kept,
        *[f"coalesce({n}, '{UNKNOWN_SEGMENT}') AS {n}" for n in ("user_type", "user_channel")],
    )
