"""Tiers, flags, funnel and the data behind each chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dripline.config import MetricConfig
from dripline.functions.exprs import guarded
from dripline.operators.aggregates import journey_daily, kpi_totals
from dripline.operators.quantiles import with_quantiles
from dripline.operators.ranking import top_n

TIER_COLUMNS = ("roi", "ctr", "conversion_rate", "orders_per_sent", "delivery_rate")
VOLUME_FLAG_COLUMNS = ("sent", "delivered", "clicks", "orders")


def performance_tiers(summary: DataFrame, columns: Sequence[str] = TIER_COLUMNS) -> DataFrame:
    """Add ``<column>_tier`` from the column's 10th, 25th, 75th and 90th percentile.

    The first matching tier wins: excellent, good, very_poor, poor, none. Nothing runs here: the
    thresholds are a subquery of the plan. Pass a stored summary where its own source is large.
    """

    def tiers(limits: Column) -> dict[str, Column]:
        found = {}
        for name in columns:
            value = F.col(name)
            p10, p25, p75, p90 = (limits[name][i] for i in range(4))
            found[f"{name}_tier"] = (
                F.when(value >= p90, "excellent")
                .when(value >= p75, "good")
                .when(value <= p10, "very_poor")
                .when(value <= p25, "poor")
                .otherwise("none")
            )
        return found

    return with_quantiles(summary, columns, [0.10, 0.25, 0.75, 0.90], tiers)


def high_volume_flags(summary: DataFrame, columns: Sequence[str] = VOLUME_FLAG_COLUMNS) -> DataFrame:
    """Add ``<column>_high``: at or above the column's 95th percentile."""

    def flags(limits: Column) -> dict[str, Column]:
        return {f"{name}_high": F.col(name) >= limits[name][0] for name in columns}

    return with_quantiles(summary, columns, [0.95], flags)


def conversion_funnel(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Four stages with value, share of the first stage and share of the stage before."""
    stages = [
        ("Messages Sent", "sent"),
        ("Messages Delivered", "delivered"),
        ("Clicks Generated", "clicks"),
        ("Orders Converted", "orders"),
    ]
    totals = kpi_totals(df, config)
    entries = []
    before = "sent"
    for position, (label, name) in enumerate(stages, start=1):
        value = F.col(name).cast("double")
        entries.append(
            F.struct(
                F.lit(position).alias("stage"),
                F.lit(label).alias("label"),
                value.alias("value"),
                guarded(name, "sent", None, percent=True).alias("pct_of_first"),
                guarded(name, before, None, percent=True).alias("pct_of_previous"),
            )
        )
        before = name
    return totals.select(F.inline(F.array(*entries)))


def volume_share(summary: DataFrame, n: int = 8) -> DataFrame:
    """Share of each top-``n`` journey in the messages of those ``n``."""
    top = top_n(summary.select("journey_name", "sent"), "sent", n)
    # At most n rows reach this window.
    whole = F.sum("sent").over(Window.partitionBy())
    share = F.when(whole > 0, F.try_divide(F.col("sent"), whole)).otherwise(F.lit(0.0))
    return top.withColumn("share", share)


def break_even(summary: DataFrame) -> DataFrame:
    """Flag journeys at or above ROI 1, and at or above GTV = cost."""
    return summary.select(
        "journey_name",
        "cost",
        "gtv",
        "roi",
        (F.col("roi") >= 1).alias("roi_above_break_even"),
        (F.col("gtv") >= F.col("cost")).alias("gtv_covers_cost"),
    )


def cost_vs_gtv(summary: DataFrame, n: int = 15) -> DataFrame:
    """Cost, GTV, orders and ROI of the top journeys by ROI; nothing for a single journey."""
    points = top_n(summary.select("journey_name", "cost", "gtv", "orders", "roi"), "roi", n)
    # At most n rows reach this window.
    rows = F.count(F.lit(1)).over(Window.partitionBy())
    return points.withColumn("rows", rows).where(F.col("rows") > 1).drop("rows")


def cost_vs_gtv_all(summary: DataFrame) -> DataFrame:
    """Cost and GTV of every journey that has both."""
    points = summary.select("journey_name", "cost", "gtv", "orders", "roi")
    return points.where((F.col("cost") > 0) & (F.col("gtv") > 0))


def sent_vs_orders(summary: DataFrame) -> DataFrame:
    return summary.select("journey_name", "sent", "orders", "roi")


# Chart group -> series.
METRIC_GROUPS = {
    "volume": ("sent", "delivered", "clicks", "orders"),
    "performance": ("delivery_rate", "ctr", "conversion_rate"),
    "financial": ("cost", "gtv", "roi"),
}


def journey_daily_long(
    df: DataFrame,
    config: MetricConfig,
    groups: Sequence[str] = tuple(METRIC_GROUPS),
    journey: str | None = None,
) -> DataFrame:
    """Daily series in long form: journey, day, group, metric, value."""
    daily = journey_daily(df, config, journey)
    names = [name for group in groups for name in METRIC_GROUPS[group]]
    group_of = F.create_map(
        *[F.lit(text) for group in groups for name in METRIC_GROUPS[group] for text in (name, group)]
    )
    long = daily.unpivot(["journey_name", "day"], names, "metric", "value")
    return long.withColumn("metric_group", group_of[F.col("metric")])
