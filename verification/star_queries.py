"""One query per engine operator, over campaign reports derived from the star tables.

Every query takes the whole tables. Days are cast to text at the end, so that results compare
by value with any SQL engine.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dripline.functions.exprs import iso_date_text
from dripline.operators import (
    aggregates as agg,
    analytics,
    display,
    filters,
    ranking,
    reshape,
    rows,
)
from dripline.operators.filters import FilterSpec
from dripline.operators.lookups import with_segments
from dripline.plans import cube, pivot_blocks as blocks, report as report_plan
from dripline.plans.dashboard import dashboard_tab
from dripline.schema import COLUMN_TO_HEADER, LEGACY_DETAIL_COLUMNS, SOURCE_TS
from dripline.session import new_work_path
from dripline.sources import combine, reports, sinks
from dripline.sources.reports import standardize
from dripline.sources.star import CHANNELS, ROW_KEY, campaign_fact, star_config
from dripline.streaming import incremental, versioned

Query = Callable[[SparkSession, str], DataFrame]

CONFIG = star_config()

# The selection the filter queries use.
SELECTION = FilterSpec(
    journeys=[
        "AUTOMOBILE / 1-URGENT", "BUILDING / 2-HIGH", "BUILDING / 5-LOW",
        "FURNITURE / 3-MEDIUM", "MACHINERY / 1-URGENT", "MACHINERY / 5-LOW",
    ],
    channels=["Email", "SMS", "WhatsApp", "InApp"],
    statuses=["Completed", "Running"],
    user_types=["RU", "Unknown"],
    start="1996-03-01",
    end="2000-06-30",
)

# The three report files: which rows each holds, and when it arrived. The flag is a column of
# the line table, so each file's filter reaches that scan before any shuffle.
SOURCES = {
    "first": ("source = 'A'", "2024-01-01 00:00:00"),
    "second": ("source = 'N'", "2024-01-02 00:00:00"),
    "third": ("coalesce(source, '') NOT IN ('A', 'N')", "2024-01-03 00:00:00"),
}


def _text_days(df: DataFrame) -> DataFrame:
    texts = {}
    for name, kind in df.dtypes:
        if kind == "date":
            texts[name] = F.col(name).cast("string")
        elif kind.startswith("timestamp"):
            texts[name] = iso_date_text(F.col(name))
    return df.withColumns(texts)


def _on_fact(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: _text_days(operator(campaign_fact(spark, sf_dir)))


def _on_summary(operator: Callable[[DataFrame], DataFrame]) -> Query:
    return _on_fact(lambda fact: operator(agg.journey_summary(fact, CONFIG)))


def _plain(df: DataFrame) -> DataFrame:
    """Volumes as double, so that their type does not depend on the reports."""
    kinds = [(name, kind) for name, kind in df.dtypes if kind.startswith("decimal")]
    return df.withColumns({name: F.col(name).cast("double") for name, _ in kinds})


def clean_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = campaign_fact(spark, sf_dir)
    seq, sent = F.col("source_seq"), F.col("sent")
    messy = fact.select(
        "campaign_id",
        "day",
        "channel",
        "source_seq",
        F.when(seq == 1, F.format_number(sent, 0))
        .when(seq == 2, F.lit("nan"))
        .when(seq == 3, F.lit(None).cast("string"))
        .when(seq == 4, F.lit("abc"))
        .when(seq == 5, F.lit("1d"))
        .when(seq == 6, F.concat(F.lit(" "), sent.cast("string"), F.lit(".5 ")))
        .otherwise(sent.cast("string"))
        .alias("sent"),
        F.format_number("revenue_inr", 2).alias("revenue_inr"),
    )
    return _text_days(rows.clean_numeric(messy))


def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, name = F.col("source_seq"), F.col("journey_name")
    messy = campaign_fact(spark, sf_dir).withColumn(
        "journey_name",
        F.when(seq == 1, F.concat(F.lit("  "), name, F.lit(" ")))
        .when(seq == 2, F.lit(None).cast("string"))
        .when(seq == 3, F.concat(F.lit("\t"), name))
        .otherwise(name),
    )
    labelled = with_segments(rows.clean_strings(messy, ["journey_name"]), CONFIG)
    return labelled.groupBy("journey_name", "user_type").agg(F.count(F.lit(1)).alias("rows"))


def parse_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    seq, day = F.col("source_seq"), F.col("day")
    messy = campaign_fact(spark, sf_dir).select(
        "campaign_id",
        "source_seq",
        F.when(seq == 1, F.date_format(day, "yyyy-MM-dd"))
        .when(seq == 2, F.date_format(day, "yyyy-MM-dd 10:30:00"))
        .when(seq == 3, F.date_format(day, "MM/dd/yyyy"))
        .when(seq == 4, F.date_format(day, "dd-MMM-yyyy"))
        .when(seq == 5, F.lit("not a day"))
        .when(seq == 6, F.lit(None).cast("string"))
        .otherwise(F.lit("0"))
        .alias("day"),
    )
    return _text_days(rows.parse_days(messy))


def render_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("day").cast("timestamp_ntz")
    timed = campaign_fact(spark, sf_dir).select(
        "campaign_id",
        "source_seq",
        F.when(F.col("source_seq") == 2, day + F.expr("interval 37800 seconds"))
        .otherwise(day)
        .alias("day"),
        F.col("start_date").cast("timestamp_ntz").alias("start_date"),
    )
    return combine.render_dates(timed)


def _source_time() -> Column:
    cases = " ".join(f"WHEN {rows} THEN timestamp '{time}'" for rows, time in SOURCES.values())
    return F.expr(f"CASE {cases} END")


def _reported(
    spark: SparkSession, sf_dir: str, arrange: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """Fact with row key, in which some start dates are missing."""
    start = F.when(F.col("source_seq") == 3, F.lit(None).cast("date")).otherwise(F.col("start_date"))
    fact = campaign_fact(spark, sf_dir, keep_row_key=True, arrange=arrange)
    return fact.withColumn("start_date", start)


def dedupe_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    reported = _reported(spark, sf_dir).withColumn(SOURCE_TS, _source_time())
    latest = combine.dedupe_latest(reported, position=ROW_KEY)
    return _text_days(_plain(latest.drop(SOURCE_TS, "source", *ROW_KEY)))


_REPORT_COLUMNS = {
    "first": ["campaign_id", "day", "start_date", "journey_name", "sent", "delivered"],
    "second": ["campaign_id", "day", "start_date", "journey_name", "sent", "unique_clicks"],
    "third": ["campaign_id", "day", "journey_name", "sent", "delivered", "status"],
}


def combine_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three reports with different columns, merged by name and reduced to the latest rows."""
    reported = _reported(spark, sf_dir)
    parts = []
    for name, (condition, time) in SOURCES.items():
        arrived = F.lit(time).cast("timestamp").alias(SOURCE_TS)
        parts.append(
            reported.where(condition).select(*_REPORT_COLUMNS[name], arrived, *ROW_KEY)
        )
    latest = combine.dedupe_latest(combine.align(parts), position=ROW_KEY)
    ordered = latest.orderBy(*combine.chronological(latest.columns, ROW_KEY))
    return combine.render_dates(ordered).drop(SOURCE_TS, *ROW_KEY)


def write_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The combined table written as CSV and read back."""
    path = new_work_path(spark, "combined")
    sinks.write_combined(combine_reports(spark, sf_dir), path)
    return spark.read.option("header", True).csv(path)


def _report_files(spark: SparkSession, sf_dir: str, root: str) -> None:
    """The three sources as report files below ``root``."""
    # A campaign-day lies in one file, in row-key order. The part key is the campaign's.
    reported = _reported(spark, sf_dir, lambda lines: lines.repartition("l_partkey", "day"))
    for name, (condition, _) in SOURCES.items():
        part = reported.where(condition)
        part = part.sortWithinPartitions(*ROW_KEY).select(*_REPORT_COLUMNS[name])
        part = part.withColumnsRenamed(COLUMN_TO_HEADER)
        sinks.write_combined(combine.render_dates(part), f"{root}/reports/{name}")


def incremental_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Report files arriving one after the other, combined by the stream."""
    root = new_work_path(spark, "incremental")
    _report_files(spark, sf_dir, root)
    stream = incremental.start_incremental_combine(
        spark, f"{root}/reports/*", f"{root}/log", f"{root}/state", pattern="*.csv"
    )
    stream.awaitTermination()
    return standardize(incremental.current_table(spark, f"{root}/log"))


def combine_sound_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reports as files beside one that breaks behind its first rows, which is left out."""
    root = new_work_path(spark, "sound")
    _report_files(spark, sf_dir, root)
    # A copy of the second report whose last line has more cells than the header.
    second = spark.read.text(f"{root}/reports/second")
    lines = [row["value"] for row in second.limit(3).collect()]
    broken = spark.createDataFrame([(x,) for x in (*lines, lines[-1] + ",more")], "value string")
    broken.coalesce(1).write.text(f"{root}/reports/broken")
    paths = [f"{root}/reports/{name}" for name in (*SOURCES, "broken")]
    rejected: list[reports.RejectedFile] = []
    combined = combine.combine_reports(spark, paths, skip_bad=True, rejected=rejected)
    if len(rejected) != 1:
        raise AssertionError(f"one file breaks, left out were {rejected}")
    return standardize(combined)


def loaded_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journey summary of a report that was written as CSV files and loaded with strict days."""
    fact = campaign_fact(spark, sf_dir)
    path = new_work_path(spark, "loaded")
    names = {x: y for x, y in COLUMN_TO_HEADER.items() if x in fact.columns}
    sinks.write_combined(combine.render_dates(fact.select(*names)).withColumnsRenamed(names), path)
    loaded = reports.load_report(spark, path, CONFIG, strict_days=True)
    # Loaded amounts are floating point, so that a sum depends on its order beyond the cents.
    summary = agg.journey_summary(loaded, CONFIG).withColumn("revenue", F.round("revenue", 2))
    return _text_days(summary)


def versioned_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, merged month by month into a table that switches versions, and compacted."""
    root = new_work_path(spark, "versioned")
    _report_files(spark, sf_dir, root)
    stream = versioned.start_versioned_combine(
        spark, f"{root}/reports/*", f"{root}/table", f"{root}/state", pattern="*.csv"
    )
    stream.awaitTermination()
    versioned.compact(spark, f"{root}/table")
    return standardize(versioned.current_table(spark, f"{root}/table"))


def filter_spec(fact: DataFrame) -> DataFrame:
    chosen = filters.apply_filters(fact, SELECTION, CONFIG)
    return chosen.groupBy("journey_name", "channel", "status").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("sent").cast("double").alias("sent"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


def single_channel_summary(fact: DataFrame) -> DataFrame:
    email = filters.apply_filters(fact, FilterSpec(channels=["Email"]), CONFIG)
    return agg.journey_summary(email, CONFIG)


def weekly_view(fact: DataFrame) -> DataFrame:
    """One journey's weeks, with untouched journey and channel lists read as "all"."""
    spec = FilterSpec(journeys=[], channels=[], statuses=["Completed", "Paused"], empty_means_all=True)
    tables = dashboard_tab(fact, "weekly-analysis", spec, CONFIG, "BUILDING / 2-HIGH")
    return tables["weekly"]


def details_page(fact: DataFrame) -> DataFrame:
    """Third page of the campaigns that sold something, in detail order."""
    details = rows.campaign_details(rows.enrich(fact, CONFIG)).where("roi > 100 and status = 'Running'")
    return ranking.page(details, details.columns, number=3, size=25)


def details_page_by_cursor(fact: DataFrame) -> DataFrame:
    """The same page, reached from the ends of the two before it."""
    details = rows.campaign_details(rows.enrich(fact, CONFIG)).where("roi > 100 and status = 'Running'")
    order = [(name, "asc") for name in details.columns]
    cursor = None
    for _ in range(2):
        shown = ranking.page_after(details, order, 25, cursor).collect()
        cursor = ranking.cursor_after(shown, order, cursor)
    return ranking.page_after(details, order, 25, cursor)


def table_filter(fact: DataFrame) -> DataFrame:
    """Campaign details under the filter cells of a table."""
    details = rows.campaign_details(rows.enrich(fact, CONFIG))
    cells = {
        "journey_name": "contains URGENT", "status": "!= Running", "sent": ">= 10", "roi": "> 100",
        "day": "< 1997-01-01", "channel": "",
    }
    return filters.filter_table(details, cells)


def report_section(name: str) -> Query:
    return _on_fact(
        lambda fact: report_plan.report(fact, CONFIG, None, share_scan=False)[name]
    )


def financials_text(fact: DataFrame) -> DataFrame:
    pairs = F.transform(
        "channels", lambda c: F.concat(c["channel"], F.lit(":"), c["rows"].cast("string"))
    )
    return agg.journey_financials(fact, CONFIG).withColumn("channels", F.array_join(pairs, ","))


def summary_with_financials(fact: DataFrame) -> DataFrame:
    """Legacy summary as a join of its volume and financial halves."""
    volumes = agg.legacy_summary(fact, CONFIG).drop("cost", "gtv", "roi")
    return agg.summary_with_financials(volumes, agg.journey_financials(fact, CONFIG))


def _pivot(metric: str) -> Query:
    return _on_fact(lambda fact: reshape.channel_pivots(fact, CONFIG, CHANNELS)[metric])


def pivot_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six matrices in blocks of four channels, read back as cells."""
    root = new_work_path(spark, "pivot-blocks")
    blocks.write_pivot_blocks(campaign_fact(spark, sf_dir), CONFIG, root, width=4)
    return blocks.pivot_cells(spark, root)


def _on_cube(operator: Callable[[DataFrame], DataFrame]) -> Query:
    """An operator over the stored cube of the report rows."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        root = new_work_path(spark, "cube")
        cube.store_cube(campaign_fact(spark, sf_dir), root)
        return _text_days(operator(cube.current_cube(spark, root)))

    return run


def _only(*columns: str) -> Callable[[DataFrame], DataFrame]:
    return lambda summary: summary.select("journey_name", *columns)


def _perf(choice: str) -> Query:
    return _on_summary(lambda summary: filters.performance_filter(summary, choice))


QUERIES: dict[str, Query] = {
    # Sources, cleaning and combining.
    "campaign_fact": _on_fact(_plain),
    "clean_numeric": clean_numeric,
    "clean_strings": clean_strings,
    "parse_day": parse_day,
    "render_dates": render_dates,
    "dedupe_latest": dedupe_latest,
    "combine_reports": combine_reports,
    "write_combined": write_combined,
    "incremental_combine": incremental_combine,
    "versioned_combine": versioned_combine,
    "combine_sound_files": combine_sound_files,
    "loaded_report": loaded_report,
    "load_profile": _on_fact(agg.load_profile),
    # Rows.
    "user_segments": _on_fact(
        lambda fact: with_segments(fact, CONFIG).select(
            "campaign_id", "journey_name", "user_type", "user_channel", "day", "source_seq"
        )
    ),
    "row_metrics": _on_fact(lambda fact: _plain(rows.with_row_metrics(fact, CONFIG))),
    "campaign_details": _on_fact(lambda fact: rows.campaign_details(rows.enrich(fact, CONFIG))),
    "campaign_details_legacy": _on_fact(
        lambda fact: rows.campaign_details(fact, LEGACY_DETAIL_COLUMNS)
    ),
    "details_display": _on_fact(
        lambda fact: display.details_display(rows.campaign_details(rows.enrich(fact, CONFIG)))
    ),
    "details_page": _on_fact(details_page),
    "details_page_by_cursor": _on_fact(details_page_by_cursor),
    "table_filter": _on_fact(table_filter),
    # Filters.
    "filter_spec": _on_fact(filter_spec),
    "filter_domains": _on_fact(lambda fact: filters.filter_domains(fact, CONFIG)),
    "date_bounds": _on_fact(filters.date_bounds),
    "selection_counts": _on_fact(
        lambda fact: filters.selection_counts(fact, SELECTION, CONFIG)
    ),
    "single_channel_summary": _on_fact(single_channel_summary),
    "perf_filter_high_roi": _perf("high_roi"),
    "perf_filter_high_ctr": _perf("high_ctr"),
    "perf_filter_high_conv": _perf("high_conv"),
    "perf_filter_high_conv_per_sent": _perf("high_conv_per_sent"),
    "perf_filter_low": _perf("low_perf"),
    "high_value_journeys": _on_summary(
        lambda summary: filters.above_median(_only("gtv")(summary))
    ),
    # Aggregates.
    "journey_summary_from_cube": _on_cube(lambda rows: agg.journey_summary(rows, CONFIG)),
    "weekly_view_from_cube": _on_cube(weekly_view),
    "journey_summary": _on_summary(lambda summary: summary),
    "journey_summary_raw_roi": _on_fact(lambda fact: agg.journey_summary_raw_roi(fact, CONFIG)),
    "legacy_summary": _on_fact(lambda fact: agg.legacy_summary(fact, CONFIG)),
    "summary_with_financials": _on_fact(summary_with_financials),
    "journey_financials": _on_fact(financials_text),
    "channel_performance": _on_fact(lambda fact: agg.channel_performance(fact, CONFIG)),
    "daily_trends": _on_fact(lambda fact: agg.daily_trends(fact, CONFIG)),
    "journey_daily": _on_fact(lambda fact: agg.journey_daily(fact, CONFIG)),
    "journey_weekly": _on_fact(lambda fact: agg.journey_weekly(fact, CONFIG)),
    "weekly_view": _on_fact(weekly_view),
    "journey_weekly_iso": _on_fact(lambda fact: agg.journey_weekly(fact, CONFIG, iso_weeks=True)),
    "journey_daily_long": _on_fact(lambda fact: analytics.journey_daily_long(fact, CONFIG)),
    "kpi_totals": _on_fact(lambda fact: agg.kpi_totals(fact, CONFIG)),
    "kpi_cards": _on_fact(lambda fact: display.kpi_cards(agg.kpi_totals(fact, CONFIG))),
    "portfolio_insights": _on_fact(lambda fact: agg.portfolio_insights(fact, CONFIG)),
    "channel_volume": _on_fact(agg.channel_volume),
    "channel_sent_totals": _on_fact(agg.channel_sent_totals),
    "journey_channel_totals": _on_fact(lambda fact: agg.journey_channel_totals(fact, CONFIG)),
    "journey_totals": _on_fact(lambda fact: agg.journey_totals(fact, CONFIG)),
    # Pivots.
    **{f"pivot_{metric}": _pivot(metric) for metric in reshape.PIVOT_METRICS},
    "pivot_blocks": pivot_blocks,
    "pivot_fixed": _on_fact(
        lambda fact: reshape.fixed_pivots(fact, CHANNELS)["sent"]
    ),
    "channel_breakdown": _on_fact(reshape.channel_breakdown),
    "channel_breakdown_four": _on_fact(
        lambda fact: reshape.channel_breakdown(fact, total_over_fixed=True)
    ),
    "channel_breakdown_wide": _on_fact(reshape.channel_breakdown_wide),
    # Rankings and sorts.
    "top_roi_5": _on_summary(lambda summary: ranking.top_n(summary, "roi", 5)),
    "top_roi_10": _on_summary(lambda summary: ranking.top_n(summary, "roi", 10)),
    "top_roi_15": _on_summary(lambda summary: ranking.top_n(summary, "roi", 15)),
    "top_roi_positive": _on_summary(
        lambda summary: ranking.top_n(summary, "roi", 10, positive_only=True)
    ),
    "bottom_roi_5": _on_summary(lambda summary: ranking.bottom_n(summary, "roi", 5)),
    "top_volume": _on_summary(lambda summary: ranking.top_n(summary, "sent", 8)),
    "sort_performance": _on_summary(lambda s: ranking.sort_preset(s, "performance")),
    "sort_roi": _on_summary(lambda s: ranking.sort_preset(s, "roi")),
    "sort_volume": _on_summary(lambda s: ranking.sort_preset(s, "volume")),
    "sort_custom": _on_summary(
        lambda s: ranking.sort_custom(s, [("ctr", "asc"), ("cost", "desc")])
    ),
    "default_journeys": _on_fact(ranking.first_journeys),
    "first_journey_rows": _on_summary(lambda s: ranking.first_rows(s, 15)),
    # Analytics.
    "performance_tiers": _on_summary(
        lambda s: analytics.performance_tiers(_only(*analytics.TIER_COLUMNS)(s))
    ),
    "high_volume_flags": _on_summary(
        lambda s: analytics.high_volume_flags(_only(*analytics.VOLUME_FLAG_COLUMNS)(s))
    ),
    "conversion_funnel": _on_fact(lambda fact: analytics.conversion_funnel(fact, CONFIG)),
    "volume_share": _on_summary(analytics.volume_share),
    "break_even": _on_summary(analytics.break_even),
    "cost_vs_gtv": _on_summary(analytics.cost_vs_gtv),
    "cost_vs_gtv_all": _on_summary(analytics.cost_vs_gtv_all),
    "sent_vs_orders": _on_fact(
        lambda fact: analytics.sent_vs_orders(agg.journey_summary_raw_roi(fact, CONFIG))
    ),
    # Display.
    "summary_display": _on_summary(display.summary_display),
    "compact_summary_display": _on_fact(
        lambda fact: display.compact_summary_display(agg.journey_summary_raw_roi(fact, CONFIG))
    ),
    "legacy_display": _on_fact(
        lambda fact: display.legacy_display(agg.legacy_summary(fact, CONFIG))
    ),
    "daily_display": _on_fact(
        lambda fact: display.period_display(agg.journey_daily(fact, CONFIG))
    ),
    "weekly_display": _on_fact(
        lambda fact: display.period_display(agg.journey_weekly(fact, CONFIG))
    ),
    "journey_totals_display": _on_fact(
        lambda fact: display.journey_totals_display(agg.journey_totals(fact, CONFIG))
    ),
    # Report sections.
    "report_header": _on_fact(agg.report_header),
    "report_executive": report_section("executive"),
    "report_channel": report_section("channel"),
    "report_journeys": report_section("journey_table"),
    "report_performers": report_section("performers"),
    "report_volume": report_section("volume"),
    "report_config": report_section("config"),
}
