"""The report: a header, a footer and five selectable sections over one shared aggregate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from dripline.config import REPORT_CHANNEL_PROFILE, SUMMARY_PROFILE, MetricConfig
from dripline.operators.aggregates import (
    channel_cube,
    channels_from_cube,
    date_range,
    header_from_cube,
    kpi_from_cube,
    roll_up,
    volume_from_cube,
    with_flag,
    with_rates,
)
from dripline.operators.ranking import bottom_n, top_n
from dripline.schema import VOLUME_NAMES
from dripline.session import materialize

SECTIONS = ("executive", "channel", "journey_table", "performers", "volume")


def report_cube(df: DataFrame) -> DataFrame:
    """Everything a report needs, per (journey, channel)."""
    return channel_cube(df, ["journey_name"], tuple(VOLUME_NAMES), date_range())


def report(
    df: DataFrame,
    config: MetricConfig,
    sections: Sequence[str] | None = None,
    share_scan: bool = True,
) -> dict[str, DataFrame]:
    """Named result frames for the chosen sections; no choice means all of them.

    The reports are scanned once: the cube is small, so it is written to the shared folder
    and every section reads that. ``share_scan=False`` keeps the frames fully lazy instead.
    """
    chosen = list(sections) if sections else list(SECTIONS)
    unknown = set(chosen) - set(SECTIONS)
    if unknown:
        raise ValueError(f"unknown report sections: {sorted(unknown)}")
    cube = report_cube(df)
    if share_scan:
        cube = materialize(cube)
    builders = {
        "executive": executive_section,
        "channel": channel_section,
        "journey_table": journey_section,
        "performers": performers_section,
        "volume": volume_section,
    }
    result = {"header": header_from_cube(cube), "config": config_footer(cube, config)}
    for name in SECTIONS:
        if name in chosen:
            result[name] = builders[name](cube, config)
    return result


def executive_section(cube: DataFrame, config: MetricConfig) -> DataFrame:
    return kpi_from_cube(cube, config).drop("journeys", "cost_per_order")


def channel_section(cube: DataFrame, config: MetricConfig) -> DataFrame:
    return with_flag(channels_from_cube(cube, config, REPORT_CHANNEL_PROFILE))


def _journeys(cube: DataFrame, config: MetricConfig) -> DataFrame:
    return with_rates(roll_up(cube, ["journey_name"], config), config, SUMMARY_PROFILE)


def journey_section(cube: DataFrame, config: MetricConfig) -> DataFrame:
    return with_flag(_journeys(cube, config))


def performers_section(cube: DataFrame, config: MetricConfig) -> DataFrame:
    """Five best and five worst journeys by ROI, when there are at least two journeys."""
    journeys = _journeys(cube, config).select("journey_name", "roi", "orders", "cost", "gtv")
    best = top_n(journeys, "roi", 5).withColumn("side", F.lit("top"))
    worst = bottom_n(journeys, "roi", 5).withColumn("side", F.lit("bottom"))
    # At most five rows per side reach this window.
    listed = F.count(F.lit(1)).over(Window.partitionBy("side"))
    return best.unionByName(worst).withColumn("listed", listed).where("listed > 1").drop("listed")


def volume_section(cube: DataFrame, config: MetricConfig) -> DataFrame:
    return volume_from_cube(cube)


def config_footer(cube: DataFrame, config: MetricConfig) -> DataFrame:
    """The report's date range beside the constants it was computed with."""
    prices = ", ".join(f"{channel} ₹{price}" for channel, price in config.unit_costs.items())
    dates = cube.agg(F.min("min_date").alias("min_date"), F.max("max_date").alias("max_date"))
    return dates.withColumns(
        {
            "aov": F.lit(float(config.aov)),
            "take_rate": F.lit(float(config.take_rate)),
            "unit_costs": F.lit(prices),
        }
    )
