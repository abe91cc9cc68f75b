"""Row-level cleaning, metrics and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dripline.config import OMIT, ROW_PROFILE, MetricConfig, RateProfile
from dripline.functions.exprs import guarded_sql, normalize_text, parse_day, parse_number
from dripline.operators.lookups import with_cost, with_segments
from dripline.schema import (
    DATE_COLUMNS,
    DETAIL_COLUMNS,
    MISSING_LABEL,
    NUMERIC_COLUMNS,
    STRING_COLUMNS,
)


def clean_numeric(
    df: DataFrame, columns: Sequence[str] = NUMERIC_COLUMNS, strip_nan: bool = True
) -> DataFrame:
    """Coerce report text to numbers in the listed columns that exist."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns({name: parse_number(F.col(name), strip_nan) for name in present})


def clean_strings(
    df: DataFrame,
    columns: Sequence[str] = STRING_COLUMNS,
    trim: bool = True,
    missing_label: str = MISSING_LABEL,
) -> DataFrame:
    """Label missing text and trim it, in the listed columns that exist."""
    present = [name for name in columns if name in df.columns]
    return df.withColumns(
        {name: normalize_text(F.col(name), trim, missing_label) for name in present}
    )


def parse_days(df: DataFrame, strict: bool = False) -> DataFrame:
    """Turn the date columns that exist into timestamps."""
    present = [name for name in DATE_COLUMNS if name in df.columns]
    return df.withColumns({name: parse_day(F.col(name), strict) for name in present})


# Metric -> (numerator, denominator, is a percentage).
_RATES = {
    "delivery_rate": ("{delivered}", "{sent}", True),
    "ctr": ("{clicks}", "{delivered}", True),
    "conversion_rate": ("{orders}", "{clicks}", True),
    "orders_per_sent": ("{orders}", "{sent}", True),
    "roi": ("gtv", "cost", False),
    "roi_take_rate": ("gtv * {kept_share}D", "cost", False),
    "cost_per_order": ("cost", "{orders}", False),
}
RESULT_NAMES = {name: name for name in ("sent", "delivered", "clicks", "orders")}
_ROW_NAMES = {
    "sent": "sent",
    "delivered": "delivered",
    "clicks": "unique_clicks",
    "orders": "ct_conversions",
}


def rate_columns(config: MetricConfig, profile: RateProfile, names: dict[str, str]) -> list[str]:
    """SQL of the profile's rate and value columns over the named volume columns."""
    values = {**names, "kept_share": 1 - config.take_rate}
    columns = []
    for name, (numerator, denominator, percent) in _RATES.items():
        places = getattr(profile, name)
        if places != OMIT:
            top, bottom = numerator.format(**values), denominator.format(**values)
            columns.append(f"{guarded_sql(top, bottom, places, percent)} AS {name}")
    return columns


def with_row_metrics(
    df: DataFrame, config: MetricConfig, profile: RateProfile = ROW_PROFILE
) -> DataFrame:
    """Add cost, GTV and the rates of each report row."""
    kept = [f"`{name}`" for name in df.columns if name not in ("cost", "gtv")]
    valued = with_cost(df, config).selectExpr(
        *kept,
        "cast(cost AS double) AS cost",
        f"cast(ct_conversions AS double) * {float(config.aov)}D AS gtv",
    )
    return valued.selectExpr("*", *rate_columns(config, profile, _ROW_NAMES))


def enrich(df: DataFrame, config: MetricConfig) -> DataFrame:
    """Segments plus row metrics: the full analytic row."""
    return with_row_metrics(with_segments(df, config), config)


def campaign_details(df: DataFrame, columns: Sequence[str] = DETAIL_COLUMNS) -> DataFrame:
    """The detail columns that exist, in display order."""
    return df.select(*[name for name in columns if name in df.columns])
