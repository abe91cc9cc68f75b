"""Grouped totals and the KPI tables built on them.

Prices are applied to sums, never to rows. The scan side of a plan is one partial aggregate
over plain numbers, so a hot journey, channel or day shrinks to one row per task before any
shuffle, and costs are exact decimals that do not depend on row order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from dripline.config import (
    CHANNEL_PROFILE,
    DAILY_PROFILE,
    FIXED_CHANNELS,
    LEGACY_PROFILE,
    RAW_ROI_PROFILE,
    REPORT_CHANNEL_PROFILE,
    SUMMARY_PROFILE,
    UNROUNDED_PROFILE,
    WEEKLY_PROFILE,
    MetricConfig,
    RateProfile,
)
from dripline.functions.exprs import guarded_sql, week_label, week_start
from dripline.operators.lookups import local_table, with_cost
from dripline.operators.rows import RESULT_NAMES, rate_columns
from dripline.schema import CORE_VOLUMES, VOLUME_NAMES

_CORE = tuple(VOLUME_NAMES[name] for name in CORE_VOLUMES)
_ALL = tuple(VOLUME_NAMES.values())


# With more distinct prices than this, totals go through a channel cube instead of one
# conditional sum per price.
MAX_PRICE_SUMS = 16

_COST_TYPE = "decimal(34,8)"


# How many report rows a row stands for, in a table that is summed already.
CAMPAIGN_ROWS = "campaign_rows"


def _measures(df: DataFrame, volumes: Sequence[str]) -> list[Column]:
    rows = f"sum({CAMPAIGN_ROWS})" if CAMPAIGN_ROWS in df.columns else "count(1)"
    sums = [F.expr(f"sum({name}) AS {VOLUME_NAMES[name]}") for name in volumes]
    return [F.expr(f"{rows} AS campaigns"), *sums]


def channel_cube(
    df: DataFrame,
    keys: Sequence[str],
    volumes: Sequence[str] = CORE_VOLUMES,
    extra: Mapping[str, str] | None = None,
) -> DataFrame:
    """Volume sums and ``campaigns`` per (keys, channel), unpriced.

    ``extra`` adds further SQL aggregates by name.
    """
    grouping = dict.fromkeys([*keys, "channel"])
    extras = [F.expr(f"{sql} AS {name}") for name, sql in (extra or {}).items()]
    return df.groupBy(*grouping).agg(*_measures(df, volumes), *extras)


def sum_cube(cube: DataFrame, keys: Sequence[str], config: MetricConfig) -> DataFrame:
    """Price a channel cube and sum it to ``keys`` in exact types."""
    measures = [name for name in ("campaigns", *_ALL) if name in cube.columns]
    sums = [F.expr(f"sum({name}) AS {name}") for name in (*measures, "cost")]
    return with_cost(cube, config).groupBy(*keys).agg(*sums)


def exact_totals(
    df: DataFrame,
    keys: Sequence[str],
    config: MetricConfig,
    volumes: Sequence[str] = CORE_VOLUMES,
) -> DataFrame:
    """Volume sums and cost per ``keys`` in exact types, from report rows.

    One aggregate without a join: messages are summed once more per distinct price, and the
    few sums are priced afterwards.
    """
    by_price: dict[str, list[str]] = {}
    for channel, price in config.unit_costs.items():
        by_price.setdefault(str(price), []).append(channel)
    if "channel" in keys or len(by_price) > MAX_PRICE_SUMS:
        return sum_cube(channel_cube(df, keys, volumes), keys, config)
    paid = [
        F.sum(F.when(F.col("channel").isin(*channels), F.col("sent"))).alias(f"_paid_{i}")
        for i, channels in enumerate(by_price.values())
    ]
    totals = df.groupBy(*keys).agg(*_measures(df, volumes), *paid)
    cost = f"cast(0 AS {_COST_TYPE})"
    for i, price in enumerate(by_price):
        part = f"coalesce(cast(_paid_{i} AS decimal(28,4)), 0) * cast('{price}' AS decimal(9,4))"
        cost = f"cast({cost} + cast({part} AS {_COST_TYPE}) AS {_COST_TYPE})"
    names = [f"`{name}`" for name in totals.columns if not name.startswith("_paid_")]
    return totals.selectExpr(*names, f"{cost} AS cost")


def _finish(totals: DataFrame, config: MetricConfig) -> DataFrame:
    """Result types (bigint count, double sums), 0 for an empty selection, and GTV."""
    columns = []
    for name in totals.columns:
        if name == "campaigns":
            columns.append(f"coalesce(cast({name} AS bigint), 0L) AS {name}")
        elif name in _ALL or name == "cost":
            columns.append(f"coalesce(cast({name} AS double), 0.0D) AS {name}")
        else:
            columns.append(f"`{name}`")
    gtv = f"coalesce(cast(orders AS double), 0.0D) * {float(config.aov)}D AS gtv"
    return totals.selectExpr(*columns, gtv)


def roll_up(cube: DataFrame, keys: Sequence[str], config: MetricConfig) -> DataFrame:
    """Totals with cost and GTV per ``keys``, from a channel cube that contains them."""
    return _finish(sum_cube(cube, keys, config), config)


def with_rates(df: DataFrame, config: MetricConfig, profile: RateProfile) -> DataFrame:
    """Add the profile's rates to a frame of totals."""
    return df.selectExpr("*", *rate_columns(config, profile, RESULT_NAMES))


def totals_by(
    df: DataFrame,
    keys: Sequence[str],
    config: MetricConfig,
    volumes: Sequence[str] = CORE_VOLUMES,
) -> DataFrame:
    """Totals with cost and GTV per ``keys``."""
    return _finish(exact_totals(df, keys, config, volumes), config)


def journey_summary(
    df: DataFrame, config: MetricConfig, profile: RateProfile = SUMMARY_PROFILE
) -> DataFrame:
    """One row per journey: campaign rows, all volume sums, cost, GTV, revenue and rates."""
    totals = totals_by(df, ["journey_name"], config, tuple(VOLUME_NAMES))
    return with_rates(totals, config, profile)


def journey_summary_raw_roi(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Journey summary whose ROI keeps full precision; no revenue."""
    return journey_summary(df, config, RAW_ROI_PROFILE).drop("revenue")


def legacy_summary(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Journey summary in the legacy names and decimal places.

    Volumes and financials come from one aggregate, so no join by journey is needed.
    """
    summary = journey_summary(df, config, LEGACY_PROFILE).drop("revenue")
    return summary.withColumnsRenamed(
        {
            "delivery_rate": "v_dr",
            "ctr": "v_ctr",
            "conversion_rate": "v_cr",
            "orders_per_sent": "v_ord_per_sent",
        }
    )


def summary_with_financials(summary: DataFrame, financials: DataFrame) -> DataFrame:
    """Attach cost, GTV and ROI to a journey table, keeping journeys without financials."""
    return summary.join(
        financials.select("journey_name", "cost", "gtv", "roi"), "journey_name", "left"
    )


def journey_financials(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Sent, orders, cost, GTV, ROI and the channels of each journey.

    ``channels`` holds one (channel, rows) pair per distinct channel, sorted: the same
    information as a list with one entry per row, at a size that does not grow with the rows.
    """
    cube = channel_cube(df, ["journey_name"], ("sent", "ct_conversions"))
    entry = F.struct("channel", F.col("campaigns").alias("rows"))
    totals = (
        with_cost(cube, config)
        .groupBy("journey_name")
        .agg(
            F.sum("sent").alias("sent"),
            F.sum("orders").alias("orders"),
            F.sum("cost").alias("cost"),
            F.sort_array(F.collect_list(entry)).alias("channels"),
        )
    )
    return with_rates(_finish(totals, config), config, RateProfile(roi=2))


def channel_performance(
    df: DataFrame, config: MetricConfig, profile: RateProfile = CHANNEL_PROFILE
) -> DataFrame:
    """Totals and rates per channel."""
    return channels_from_cube(channel_cube(df, []), config, profile)


def channels_from_cube(
    cube: DataFrame, config: MetricConfig, profile: RateProfile = CHANNEL_PROFILE
) -> DataFrame:
    core = cube.select("channel", *_CORE)
    return with_rates(roll_up(core, ["channel"], config), config, profile)


def report_channel_table(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Channel table of the report, with ``flag`` good when ROI exceeds 1."""
    return with_flag(channel_performance(df, config, REPORT_CHANNEL_PROFILE))


def with_flag(df: DataFrame) -> DataFrame:
    return df.withColumn("flag", F.when(F.col("roi") > 1, "good").otherwise("bad"))


def daily_trends(
    df: DataFrame, config: MetricConfig, profile: RateProfile = DAILY_PROFILE
) -> DataFrame:
    """Totals and rates per day, in day order; rows without a day are left out."""
    dated = df.where(F.col("day").isNotNull())
    totals = totals_by(dated, ["day"], config).drop("campaigns")
    return with_rates(totals, config, profile).orderBy("day")


def journey_daily(df: DataFrame, config: MetricConfig, journey: str | None = None) -> DataFrame:
    """Totals and rates per journey and day; one journey, or all of them when none is named."""
    chosen = df if journey is None else df.where(F.col("journey_name") == journey)
    dated = chosen.where(F.col("day").isNotNull())
    totals = totals_by(dated, ["journey_name", "day"], config).drop("campaigns")
    return with_rates(totals, config, WEEKLY_PROFILE).orderBy("journey_name", "day")


def journey_weekly(
    df: DataFrame, config: MetricConfig, journey: str | None = None, iso_weeks: bool = False
) -> DataFrame:
    """Totals and rates per journey and week, in week order.

    The bucket is (Sunday-first label, Monday start) as in the reports, so a Sunday and the
    days around New Year form buckets of their own. ``iso_weeks`` gives one row per Monday.
    """
    chosen = df if journey is None else df.where(F.col("journey_name") == journey)
    dated = chosen.where(F.col("day").isNotNull()).withColumn("day", F.to_date("day"))
    # Sum to days first: week labels are then worked out per day, not per report row.
    daily = exact_totals(dated, ["journey_name", "day"], config).withColumns(
        {"week": week_label(F.col("day")), "week_start": week_start(F.col("day"))}
    )
    keys = ["journey_name", "week_start"] if iso_weeks else ["journey_name", "week", "week_start"]
    sums = [F.expr(f"sum({name}) AS {name}") for name in (*_CORE, "cost")]
    totals = _finish(daily.groupBy(*keys).agg(*sums), config)
    order = ["journey_name", "week_start"] + ([] if iso_weeks else ["week"])
    return with_rates(totals, config, WEEKLY_PROFILE).orderBy(*order)


def kpi_totals(df: DataFrame, config: MetricConfig) -> DataFrame:
    """One row of totals and overall rates. Counts are whole numbers, cut not rounded."""
    return _kpi(exact_totals(df, ["journey_name"], config), config)


def kpi_from_cube(cube: DataFrame, config: MetricConfig) -> DataFrame:
    """KPI row from a (journey, channel) cube."""
    return _kpi(sum_cube(cube, ["journey_name"], config), config)


def _kpi(per_journey: DataFrame, config: MetricConfig) -> DataFrame:
    # One row per journey, so counting rows counts distinct journeys.
    sums = [F.expr(f"sum({name}) AS {name}") for name in (*_CORE, "cost")]
    totals = per_journey.agg(F.expr("count(journey_name) AS journeys"), *sums)
    counted = totals.selectExpr(
        "journeys",
        *[f"coalesce(cast({name} AS bigint), 0L) AS {name}" for name in _CORE],
        "coalesce(cast(cost AS double), 0.0D) AS cost",
        f"coalesce(cast(cast(orders AS bigint) AS double), 0.0D) * {float(config.aov)}D AS gtv",
    )
    return with_rates(counted, config, UNROUNDED_PROFILE)


def portfolio_insights(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Grand totals where conversion is orders per delivered message."""
    ratios = {
        "overall_roi": guarded_sql("gtv", "cost", None, percent=False),
        "overall_delivery_rate": guarded_sql("delivered", "sent", None, percent=True),
        "overall_conversion_rate": guarded_sql("orders", "delivered", None, percent=True),
    }
    totals = [f"{name} AS total_{name}" for name in ("sent", "delivered", "orders", "cost", "gtv")]
    return kpi_totals(df, config).selectExpr(
        *totals, *[f"{sql} AS {name}" for name, sql in ratios.items()]
    )


def channel_volume(df: DataFrame) -> DataFrame:
    """Four volume sums per channel."""
    return volume_from_cube(channel_cube(df, []))


def volume_from_cube(cube: DataFrame) -> DataFrame:
    sums = [F.sum(name).cast("double").alias(name) for name in _CORE]
    return cube.groupBy("channel").agg(*sums)


def journey_channel_totals(df: DataFrame, config: MetricConfig) -> DataFrame:
    return totals_by(df, ["journey_name", "channel"], config).drop("campaigns")


def journey_totals(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Totals per journey with unrounded rates."""
    totals = totals_by(df, ["journey_name"], config).drop("campaigns")
    return with_rates(totals, config, UNROUNDED_PROFILE)


def channel_sent_totals(df: DataFrame, channels: Sequence[str] = FIXED_CHANNELS) -> DataFrame:
    """Sent per listed channel, 0 for a channel that never occurs."""
    wanted = local_table(df.sparkSession, [(name,) for name in channels], ("channel",))
    sent = df.where(F.col("channel").isin(*channels)).groupBy("channel").agg(F.sum("sent").alias("s"))
    return wanted.join(sent, "channel", "left").selectExpr(
        "channel", "coalesce(cast(s AS double), 0.0D) AS sent"
    )


def date_range() -> dict[str, str]:
    """Extra measures of a cube that also serves the report header."""
    return {"min_date": "min(to_date(day))", "max_date": "max(to_date(day))"}


def report_header(df: DataFrame) -> DataFrame:
    """Date range, number of journeys and the sorted channel names as one text."""
    return header_from_cube(channel_cube(df, ["journey_name"], (), date_range()))


def header_from_cube(cube: DataFrame) -> DataFrame:
    return cube.agg(
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.countDistinct("journey_name").alias("journeys"),
        F.array_join(F.array_sort(F.collect_set("channel")), ", ").alias("channels"),
    )


def load_profile(df: DataFrame) -> DataFrame:
    """Row count, date range and number of journeys and channels."""
    return channel_cube(df, ["journey_name"], (), date_range()).agg(
        F.coalesce(F.sum("campaigns"), F.lit(0)).alias("records"),
        F.min("min_date").alias("min_date"),
        F.max("max_date").alias("max_date"),
        F.countDistinct("journey_name").alias("journeys"),
        F.countDistinct("channel").alias("channels"),
    )
