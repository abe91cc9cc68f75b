"""Selections compiled to one predicate, performance filters and filter domains."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, time
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from dripline.config import UNKNOWN_SEGMENT, MetricConfig
from dripline.operators.aggregates import CAMPAIGN_ROWS
from dripline.operators.lookups import with_segments
from dripline.operators.quantiles import quantile_map
from dripline.schema import MONTH


@dataclass(frozen=True)
class FilterSpec:
    """What a user selected.

    ``None`` means the filter was not touched. An empty journey or channel list selects
    nothing unless ``empty_means_all``; an empty status or user-type list selects everything.
    The date range counts only with both ends, and its end is midnight.
    """

    journeys: Sequence[str] | None = None
    channels: Sequence[str] | None = None
    statuses: Sequence[str] | None = None
    user_types: Sequence[str] | None = None
    start: date | datetime | str | None = None
    end: date | datetime | str | None = None
    empty_means_all: bool = False

    def predicate(self, segments: Mapping[str, tuple[str, str]]) -> Column | None:
        """One conjunction over the stored columns, or ``None`` when nothing is restricted."""
        terms = []
        for column, chosen in (("journey_name", self.journeys), ("channel", self.channels)):
            if chosen:
                terms.append(F.col(column).isin(*chosen))
            elif chosen is not None and not self.empty_means_all:
                terms.append(F.lit(False))
        if self.statuses:
            terms.append(F.col("status").isin(*self.statuses))
        if self.user_types:
            terms.append(_user_type_predicate(self.user_types, segments))
        if self.start and self.end:
            low, high = (F.lit(str(bound)).cast("timestamp") for bound in (self.start, self.end))
            terms.append(F.col("day").between(low, high))
        return reduce(lambda left, right: left & right, terms) if terms else None


def _user_type_predicate(
    user_types: Sequence[str], segments: Mapping[str, tuple[str, str]]
) -> Column:
    # Stated on the journey, so the scan can apply it: no segment join is needed to filter.
    wanted = [name for name, (user_type, _) in segments.items() if user_type in user_types]
    term = F.col("journey_name").isin(*wanted) if wanted else F.lit(False)
    if UNKNOWN_SEGMENT in user_types:
        term = term | ~F.col("journey_name").isin(*segments)
    return term


def apply_filters(df: DataFrame, spec: FilterSpec, config: MetricConfig) -> DataFrame:
    """Keep the selected rows. On a table stored by month, a date range also skips months."""
    predicate = spec.predicate(config.segments)
    if predicate is None:
        return df
    if MONTH in df.columns and spec.start and spec.end:
        months = [int(str(bound)[:7].replace("-", "")) for bound in (spec.start, spec.end)]
        predicate = F.col(MONTH).between(*months) & predicate
    return df.filter(predicate)


# Performance filter -> predicate on a journey summary.
PERFORMANCE_FILTERS = {
    "high_roi": "roi > 10",
    "high_ctr": "ctr > 2",
    "high_conv": "conversion_rate > 1",
    "high_conv_per_sent": "orders_per_sent > 1",
    "low_perf": "roi < 5",
}


def performance_filter(summary: DataFrame, choice: str) -> DataFrame:
    """Keep the journeys of a summary that pass the named performance filter."""
    return summary if choice == "all" else summary.filter(PERFORMANCE_FILTERS[choice])


def above_median(summary: DataFrame, column: str = "gtv") -> DataFrame:
    """Rows whose value lies above the median of the column."""
    median = quantile_map(summary, [column], [0.5])[column][0]
    return summary.filter(F.col(column) > median)


def filter_domains(df: DataFrame, config: MetricConfig) -> DataFrame:
    """(domain, value): the choices each filter offers, sorted.

    One scan: rows collapse to distinct combinations before they fan out by domain.
    """
    combinations = df.select("journey_name", "channel", "status").distinct()
    named = with_segments(combinations, config)
    domains = ["journey_name", "channel", "status", "user_type", "user_channel"]
    return (
        named.unpivot([], domains, "domain", "value")
        .where(F.col("value").isNotNull())
        .distinct()
        .orderBy("domain", "value")
    )


def date_bounds(df: DataFrame) -> DataFrame:
    """First and last day of the selection."""
    return df.agg(
        F.min(F.to_date("day")).alias("min_date"), F.max(F.to_date("day")).alias("max_date")
    )


def selection_counts(df: DataFrame, spec: FilterSpec, config: MetricConfig) -> DataFrame:
    """Journeys and campaign rows inside a selection, beside those of the whole table."""
    predicate = spec.predicate(config.segments)
    inside = F.lit(True) if predicate is None else F.coalesce(predicate, F.lit(False))
    rows = F.col(CAMPAIGN_ROWS) if CAMPAIGN_ROWS in df.columns else F.lit(1).cast("bigint")
    per_journey = df.groupBy("journey_name").agg(
        F.sum(F.when(inside, rows).otherwise(0)).alias("shown"), F.sum(rows).alias("total")
    )
    return per_journey.agg(
        F.count_if(F.col("shown") > 0).alias("journeys_shown"),
        F.count(F.lit(1)).alias("journeys_total"),
        F.coalesce(F.sum("shown"), F.lit(0)).alias("campaigns_shown"),
        F.coalesce(F.sum("total"), F.lit(0)).alias("campaigns_total"),
    )


# What may stand before the value in a filter cell; without any, numbers and dates are equal to
# the value and texts contain it.
_CELL = re.compile(
    r"\s*(<=|>=|!=|<|>|=|icontains\b|contains\b|is not blank\b|is blank\b)?\s*(.*?)\s*\Z", re.DOTALL
)
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _cell_value(name: str, kind: str, text: str) -> Column:
    """The value of a filter cell, as a literal of the column's type."""
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        text = text[1:-1]
    if kind == "string":
        return F.lit(text)
    try:
        if kind in ("date", "timestamp", "timestamp_ntz"):
            moment = datetime.fromisoformat(text)
            whole_day = moment == datetime.combine(moment.date(), time())
            if kind == "date" and whole_day:
                return F.lit(moment.date())
            return F.lit(moment.isoformat(" ")).cast("timestamp" if kind == "date" else kind)
        if kind in _NUMBERS or kind.startswith("decimal"):
            number = Decimal(text.replace(",", ""))
            if not number.is_finite():
                raise ValueError(text)
            # A whole number keeps the type of a whole column, so that the scan can use it.
            if number == number.to_integral_value() and "int" in kind and abs(number) < 1 << 62:
                return F.lit(int(number))
            return F.lit(float(number)) if kind in ("float", "double") else F.lit(number)
    except (ValueError, ArithmeticError) as error:
        raise ValueError(f"filter on {name}: {text!r} does not fit a column of {kind}") from error
    raise ValueError(f"filter on {name}: columns of {kind} are not filtered")


def filter_table(df: DataFrame, cells: Mapping[str, str]) -> DataFrame:
    """The rows that satisfy the filter cells of a table: column name -> text such as ``> 100``,
    ``!= 3``, ``contains push``, ``is blank`` or a bare value.

    A blank cell filters nothing; all others must hold. The filter is one predicate on the typed
    columns, so it reaches the scan. Rows whose value is null satisfy ``is blank`` and ``!=`` only.
    """
    kinds = dict(df.dtypes)
    chosen = F.lit(True)
    for name, cell in cells.items():
        if name not in kinds:
            raise ValueError(f"filter on {name}: there is no such column")
        kind, column = kinds[name], F.col(f"`{name}`")
        operator, text = _CELL.match(cell).groups()
        if not operator and not text:
            continue
        blank = column.isNull() | (F.trim(column) == "") if kind == "string" else column.isNull()
        if operator in ("is blank", "is not blank"):
            if text:
                raise ValueError(f"filter on {name}: nothing may follow {operator!r}")
            chosen &= blank if operator == "is blank" else ~blank
            continue
        if not text:
            raise ValueError(f"filter on {name}: {operator!r} needs a value")
        operator = operator or ("contains" if kind == "string" else "=")
        if operator in ("contains", "icontains"):
            if kind != "string":
                raise ValueError(f"filter on {name}: {operator!r} needs a text column, not {kind}")
            value = _cell_value(name, kind, text)
            ignoring = operator == "icontains"
            found = F.contains(F.lower(column), F.lower(value)) if ignoring else column.contains(value)
            chosen &= found
            continue
        value = _cell_value(name, kind, text)
        chosen &= {
            "=": lambda c, v: c == v,
            "!=": lambda c, v: ~c.eqNullSafe(v),
            "<": lambda c, v: c < v,
            "<=": lambda c, v: c <= v,
            ">": lambda c, v: c > v,
            ">=": lambda c, v: c >= v,
        }[operator](column, value)
    return df.where(chosen)
