"""Last-step projections that turn numbers into report text."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from dripline.functions.exprs import (
    count_text,
    money_text,
    multiplier_text,
    percent_text,
)


def _project(df: DataFrame, texts: Mapping[str, Column]) -> DataFrame:
    """Replace the listed columns that exist; leave the others and the order alone."""
    return df.withColumns({name: text for name, text in texts.items() if name in df.columns})


def summary_display(summary: DataFrame) -> DataFrame:
    """Journey summary as text."""
    texts = {
        name: count_text(F.col(name))
        for name in ("sent", "delivered", "clicks", "orders", "impressions", "conversions")
    }
    for name in ("delivery_rate", "ctr", "conversion_rate", "orders_per_sent"):
        texts[name] = percent_text(F.col(name), 2)
    texts["cost"] = money_text(F.col("cost"), 2)
    texts["gtv"] = money_text(F.col("gtv"), 0)
    texts["revenue"] = money_text(F.col("revenue"), 0)
    for name in ("roi", "roi_take_rate"):
        texts[name] = multiplier_text(F.col(name), 2)
    texts["cost_per_order"] = money_text(F.col("cost_per_order"), 2, grouped=False)
    return _project(summary, texts)


def compact_summary_display(summary: DataFrame) -> DataFrame:
    """The twelve-column journey table of the older dashboards."""
    columns = [
        "journey_name", "campaigns", "sent", "delivered", "clicks", "orders",
        "delivery_rate", "ctr", "conversion_rate", "cost", "gtv", "roi",
    ]
    texts = {name: count_text(F.col(name)) for name in ("sent", "delivered", "clicks", "orders")}
    for name in ("delivery_rate", "ctr", "conversion_rate"):
        texts[name] = percent_text(F.col(name), 1)
    texts["cost"] = money_text(F.col("cost"), 0)
    texts["gtv"] = money_text(F.col("gtv"), 0)
    texts["roi"] = multiplier_text(F.col("roi"), 1)
    return _project(summary.select(*columns), texts)


def period_display(table: DataFrame) -> DataFrame:
    """Daily or weekly table as text."""
    texts = {name: count_text(F.col(name)) for name in ("sent", "delivered", "clicks", "orders")}
    for name in ("day", "week_start"):
        texts[name] = F.date_format(name, "yyyy-MM-dd")
    for name in ("cost", "gtv"):
        texts[name] = money_text(F.col(name), 0)
    texts["delivery_rate"] = percent_text(F.col("delivery_rate"), 1)
    for name in ("ctr", "conversion_rate"):
        texts[name] = percent_text(F.col(name), 2)
    texts["roi"] = multiplier_text(F.col("roi"), 2)
    texts["cost_per_order"] = money_text(F.col("cost_per_order"), 0, grouped=False)
    return _project(table, texts)


def journey_totals_display(totals: DataFrame) -> DataFrame:
    """Unrounded journey totals as text."""
    return period_display(totals)


def legacy_display(summary: DataFrame, fixed_roi: bool = True) -> DataFrame:
    """Legacy summary as text under its legacy headers.

    ``fixed_roi`` prints ROI with two decimals, otherwise with the digits it has.
    """
    roi = F.format_number("roi", 2) if fixed_roi else F.col("roi").cast("string")
    if fixed_roi:
        roi = F.replace(roi, F.lit(","), F.lit(""))
    rate = {
        name: F.concat(F.col(name).cast("string"), F.lit("%"))
        for name in ("v_ctr", "v_cr", "v_ord_per_sent")
    }
    return summary.select(
        F.col("journey_name").alias("Row Labels"),
        F.col("campaigns").alias("Count of Campaign ID"),
        count_text(F.col("sent")).alias("Sum of Sent"),
        count_text(F.col("delivered")).alias("Sum of Delivered"),
        count_text(F.col("impressions")).alias("Sum of Unique Impressions"),
        count_text(F.col("clicks")).alias("Sum of Unique Clicks"),
        count_text(F.col("orders")).alias("Sum of Unique Click-Through Conversions"),
        F.concat(F.col("v_dr").cast("bigint").cast("string"), F.lit("%")).alias("v_dr"),
        *[text.alias(name) for name, text in rate.items()],
        money_text(F.col("cost"), 2, prefix="₹ ").alias("Cost"),
        count_text(F.col("gtv")).alias("GTV"),
        F.concat(F.lit("₹ "), roi).alias("ROI"),
    )


def details_display(details: DataFrame) -> DataFrame:
    """Campaign details as text."""
    texts = {
        name: count_text(F.coalesce(F.col(name), F.lit(0)))
        for name in ("sent", "delivered", "unique_clicks", "ct_conversions")
    }
    texts["cost"] = money_text(F.col("cost"), 2, grouped=False)
    texts["gtv"] = money_text(F.col("gtv"), 0)
    texts["roi"] = multiplier_text(F.col("roi"), 2)
    return _project(details, texts)


def kpi_cards(totals: DataFrame) -> DataFrame:
    """The KPI row as card value and subtitle, one row per card."""
    dr, ctr, conv = F.col("delivery_rate"), F.col("ctr"), F.col("conversion_rate")
    cards = [
        ("Messages Sent", count_text(F.col("sent")), F.concat(F.col("journeys").cast("string"), F.lit(" journeys"))),
        ("Delivered", count_text(F.col("delivered")), F.concat(percent_text(dr, 0), F.lit(" delivery rate"))),
        ("Clicks", count_text(F.col("clicks")), F.concat(percent_text(ctr, 2), F.lit(" CTR"))),
        ("Conversions", count_text(F.col("orders")), F.concat(percent_text(conv, 1), F.lit(" conv rate"))),
        ("Total Cost", money_text(F.col("cost"), 0), F.concat(money_text(F.col("cost_per_order"), 0, grouped=False), F.lit(" per order"))),
        ("ROI", multiplier_text(F.col("roi"), 1), F.concat(money_text(F.col("gtv"), 0), F.lit(" GTV"))),
    ]
    rows = [
        F.struct(F.lit(label).alias("label"), value.alias("value"), note.alias("subtitle"))
        for label, value, note in cards
    ]
    return totals.select(F.inline(F.array(*rows)))
