"""The tables behind each dashboard tab for one selection."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dripline.config import MetricConfig
from dripline.operators import aggregates as agg, analytics, display, rows
from dripline.operators.filters import FilterSpec, apply_filters
from dripline.plans.report import report

TABS = ("overview", "channel-analysis", "weekly-analysis", "trends", "volume-analysis",
        "summary", "details", "report")


def dashboard_tab(
    fact: DataFrame,
    tab: str,
    spec: FilterSpec,
    config: MetricConfig,
    journey: str | None = None,
) -> dict[str, DataFrame]:
    """Named frames of a tab over the selected rows.

    The weekly tab reads empty journey and channel lists as "all" and shows one journey, or
    every journey when none is named. ``fact`` may be a stored cube (:mod:`dripline.plans.cube`)
    for all tabs but the details.
    """
    if tab not in TABS:
        raise ValueError(f"unknown tab: {tab}")
    if tab == "details" and agg.CAMPAIGN_ROWS in fact.columns:
        raise ValueError("the details tab needs report rows, not a cube")
    chosen = apply_filters(fact, spec, config)
    if tab == "overview":
        summary = agg.journey_summary(chosen, config)
        return {
            "kpis": agg.kpi_totals(chosen, config),
            "channels": agg.channel_performance(chosen, config),
            "funnel": analytics.conversion_funnel(chosen, config),
            "cost_vs_gtv": analytics.cost_vs_gtv(summary),
        }
    if tab == "channel-analysis":
        return {"journeys": display.journey_totals_display(agg.journey_totals(chosen, config))}
    if tab == "weekly-analysis":
        return {
            "daily": agg.journey_daily(chosen, config, journey),
            "weekly": agg.journey_weekly(chosen, config, journey),
        }
    if tab == "trends":
        return {"daily": agg.daily_trends(chosen, config)}
    if tab == "volume-analysis":
        return {"channels": agg.channel_volume(chosen)}
    if tab == "summary":
        return {"journeys": analytics.performance_tiers(agg.journey_summary(chosen, config))}
    if tab == "details":
        details = rows.campaign_details(rows.enrich(chosen, config))
        return {"campaigns": display.details_display(details)}
    return report(chosen, config)
