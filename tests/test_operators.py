import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dripline.config import DEFAULT_SEGMENTS, MetricConfig
from dripline.operators import aggregates as agg
from dripline.operators import analytics, filters, quantiles, ranking, reshape, rows
from dripline.operators.filters import FilterSpec
from dripline.operators.lookups import with_segments
from dripline.plans.dashboard import TABS, dashboard_tab
from dripline.plans.report import SECTIONS, report

CONFIG = MetricConfig(segments={"a": ("NU", "ALL"), "b": ("RU", "OM")})

SCHEMA = """campaign_id string, campaign_name string, journey_name string, channel string,
  status string, day timestamp, sent double, delivered double, unique_impressions double,
  unique_clicks double, unique_conversions double, ct_conversions double, revenue_inr double"""


def _row(i, journey, channel, day, sent, delivered, clicks, orders, status="Running", hour=0):
    moment = dt.datetime.combine(day, dt.time(hour)) if day else None
    return (
        f"C{i}", f"Campaign {i}", journey, channel, status, moment,
        float(sent), float(delivered), 10.0, float(clicks), 1.0, float(orders), 99.5,
    )


@pytest.fixture(scope="module")
def fact(spark):
    d = dt.date
    data = [
        _row(1, "a", "Email", d(2024, 12, 29), 1000, 900, 90, 9),
        _row(2, "a", "SMS", d(2024, 12, 30), 500, 400, 40, 4, status="Paused"),
        _row(3, "b", "Push", d(2025, 1, 1), 0, 0, 0, 0),
        _row(4, "b", "InApp", d(2025, 1, 5), 500, 250, 0, 0),
        _row(5, "c", "WhatsApp", d(2025, 1, 5), 800, 700, 50, 1, hour=10),
        _row(6, "0", "Email", None, 100, 50, 5, 1),
    ]
    return spark.createDataFrame(data, SCHEMA)


def by(frame, key):
    return {row[key]: row.asDict() for row in frame.collect()}


def test_row_metrics(fact):
    found = by(rows.enrich(fact, CONFIG), "campaign_id")
    first = found["C1"]
    assert first["delivery_rate"] == 90.0
    assert first["ctr"] == 10.0
    assert first["conversion_rate"] == 10.0
    assert first["orders_per_sent"] == 0.9
    assert first["cost"] == 20.0
    assert first["gtv"] == 13500.0
    assert first["roi"] == 675.0
    assert first["roi_take_rate"] == 621.0
    assert first["cost_per_order"] == 2.22
    assert (first["user_type"], first["user_channel"]) == ("NU", "ALL")
    assert found["C5"]["user_type"] == "Unknown"
    rates = ("delivery_rate", "ctr", "conversion_rate", "orders_per_sent", "roi", "cost_per_order")
    assert all(found["C3"][name] == 0.0 for name in rates)
    assert found["C4"]["cost"] == 0.0 and found["C4"]["roi"] == 0.0


def test_default_segments(spark):
    assert len(DEFAULT_SEGMENTS) == 22
    names = spark.createDataFrame([("  Wishlist Done ",), ("AC (CK2MP)",), (None,)], "journey_name string")
    cleaned = rows.clean_strings(names, ["journey_name"])
    found = by(with_segments(cleaned, MetricConfig()), "journey_name")
    assert found["Wishlist Done"]["user_type"] == "ALL"
    assert found["AC (CK2MP)"]["user_channel"] == "OA"
    assert found["0"]["user_type"] == "Unknown"


def test_details_keep_only_present_columns(fact):
    assert rows.campaign_details(fact).columns == [
        "day", "campaign_name", "journey_name", "channel", "status", "sent", "delivered",
        "unique_clicks", "ct_conversions",
    ]


def test_journey_summary(fact):
    found = by(agg.journey_summary(fact, CONFIG), "journey_name")
    a = found["a"]
    assert a["campaigns"] == 2 and a["sent"] == 1500.0 and a["orders"] == 13.0
    assert a["cost"] == 75.0 and a["gtv"] == 19500.0 and a["roi"] == 260.0
    assert a["delivery_rate"] == 86.7 and a["orders_per_sent"] == 0.867
    assert a["cost_per_order"] == 5.77 and a["revenue"] == 199.0
    assert found["0"]["campaigns"] == 1
    assert found["b"]["roi"] == 0.0


def test_many_prices_give_the_same_costs(fact, monkeypatch):
    direct = agg.totals_by(fact, ["journey_name"], CONFIG)
    monkeypatch.setattr(agg, "MAX_PRICE_SUMS", 1)
    through_cube = agg.totals_by(fact, ["journey_name"], CONFIG)
    assert direct.columns == through_cube.columns
    assert by(direct, "journey_name") == by(through_cube, "journey_name")


def test_sums_agree_across_tables(fact):
    kpi = agg.kpi_totals(fact, CONFIG).first().asDict()
    for table in (
        agg.channel_performance(fact, CONFIG),
        agg.journey_totals(fact, CONFIG),
        agg.journey_channel_totals(fact, CONFIG),
    ):
        sums = table.agg(*[F.sum(n).alias(n) for n in ("sent", "delivered", "orders", "cost")]).first()
        assert all(sums[name] == pytest.approx(kpi[name]) for name in sums.asDict())
    assert kpi["journeys"] == 4 and kpi["sent"] == 2900
    days = agg.daily_trends(fact, CONFIG).agg(F.sum("sent")).first()[0]
    weeks = agg.journey_weekly(fact, CONFIG).agg(F.sum("sent")).first()[0]
    assert days == weeks == 2800.0


def test_empty_selection(fact):
    none = fact.where("false")
    kpi = agg.kpi_totals(none, CONFIG).first()
    assert (kpi["journeys"], kpi["sent"], kpi["cost"], kpi["roi"]) == (0, 0, 0.0, 0.0)
    assert agg.journey_summary(none, CONFIG).count() == 0


def test_week_buckets(spark):
    days = [dt.date(2024, 12, 29), dt.date(2024, 12, 30), dt.date(2025, 1, 1), dt.date(2025, 1, 5)]
    data = [_row(i, "a", "Email", day, 1, 1, 1, 1) for i, day in enumerate(days)]
    fact = spark.createDataFrame(data, SCHEMA)
    weeks = agg.journey_weekly(fact, CONFIG, "a").collect()
    assert [(w["week"], w["week_start"]) for w in weeks] == [
        ("2024-W52", dt.date(2024, 12, 23)),
        ("2024-W52", dt.date(2024, 12, 30)),
        ("2025-W00", dt.date(2024, 12, 30)),
        ("2025-W01", dt.date(2024, 12, 30)),
    ]
    iso = agg.journey_weekly(fact, CONFIG, "a", iso_weeks=True).collect()
    assert [w["sent"] for w in iso] == [1.0, 3.0]


def test_financials_list_channels(fact):
    a = by(agg.journey_financials(fact, CONFIG), "journey_name")["a"]
    assert [(c["channel"], c["rows"]) for c in a["channels"]] == [("Email", 1), ("SMS", 1)]
    assert a["roi"] == 260.0


def test_channel_sent_totals_show_absent_channels(fact):
    only = fact.where("channel = 'Email'")
    found = by(agg.channel_sent_totals(only), "channel")
    assert {name: row["sent"] for name, row in found.items()} == {
        "Email": 1100.0, "Push": 0.0, "SMS": 0.0, "WhatsApp": 0.0,
    }


@pytest.mark.parametrize(
    ("spec", "expected"),
    [
        (FilterSpec(), 6),
        (FilterSpec(journeys=["a"]), 2),
        (FilterSpec(journeys=[]), 0),
        (FilterSpec(channels=[]), 0),
        (FilterSpec(journeys=[], channels=[], empty_means_all=True), 6),
        (FilterSpec(statuses=[]), 6),
        (FilterSpec(statuses=["Paused"]), 1),
        (FilterSpec(user_types=[]), 6),
        (FilterSpec(user_types=["NU"]), 2),
        (FilterSpec(user_types=["RU", "Unknown"]), 4),
        (FilterSpec(user_types=["ALL"]), 0),
        (FilterSpec(start="2024-12-30"), 6),
        (FilterSpec(end="2024-12-30"), 6),
        (FilterSpec(start="2024-12-30", end="2025-01-05"), 3),
        (FilterSpec(start=dt.date(2024, 12, 29), end=dt.date(2025, 1, 6)), 5),
        (FilterSpec(journeys=["a", "b"], channels=["SMS", "InApp"]), 2),
    ],
)
def test_filters(fact, spec, expected):
    assert filters.apply_filters(fact, spec, CONFIG).count() == expected


def test_selection_counts(fact):
    row = filters.selection_counts(fact, FilterSpec(channels=["Email"]), CONFIG).first()
    assert tuple(row) == (2, 4, 2, 6)


def test_performance_filter_and_median(fact):
    summary = agg.journey_summary(fact, CONFIG)
    names = {r["journey_name"] for r in filters.performance_filter(summary, "low_perf").collect()}
    assert names == {"b"}
    assert filters.performance_filter(summary, "all").count() == 4
    above = {r["journey_name"] for r in filters.above_median(summary).collect()}
    assert above == {"a"}


def test_filter_domains(fact):
    found = filters.filter_domains(fact, CONFIG).collect()
    types = [r["value"] for r in found if r["domain"] == "user_type"]
    assert types == ["NU", "RU", "Unknown"]
    assert [r["value"] for r in found if r["domain"] == "journey_name"] == ["0", "a", "b", "c"]


def test_top_n_ties_go_to_the_first_name(spark):
    frame = spark.createDataFrame([("c", 2.0), ("a", 2.0), ("b", 1.0), ("d", 0.0)], "journey_name string, roi double")
    assert ranking.top_n(frame, "roi", 1).first()["journey_name"] == "a"
    assert [r[0] for r in ranking.bottom_n(frame, "roi", 2).collect()] == ["d", "b"]
    assert [r[0] for r in ranking.top_n(frame, "roi", 9, positive_only=True).collect()] == ["a", "c", "b"]
    assert [r[0] for r in ranking.sort_custom(frame, [("roi", "asc")]).collect()] == ["d", "b", "a", "c"]
    assert [r[0] for r in ranking.sort_preset(frame, "reset").collect()] == ["a", "b", "c", "d"]
    assert [r[0] for r in ranking.page(frame, ["journey_name"], 2, 3).collect()] == ["d"]


def test_pivots(fact):
    tables = reshape.channel_pivots(fact, CONFIG)
    sent = by(tables["sent"], "journey_name")
    assert sent["a"]["Email"] == 1000.0 and sent["a"]["Push"] == 0.0 and sent["a"]["Total"] == 1500.0
    assert sent["b"]["Total"] == 500.0
    assert tables["cost"].columns == [
        "journey_name", "Email", "InApp", "Push", "SMS", "WhatsApp", "Total",
    ]
    narrow = reshape.channel_pivots(fact, CONFIG, ["Email"])["sent"]
    assert by(narrow, "journey_name")["a"] == {"journey_name": "a", "Email": 1000.0, "Total": 1500.0}
    assert by(reshape.fixed_pivots(fact)["orders"], "journey_name")["b"]["WhatsApp"] == 0.0


def test_breakdown_totals(fact):
    every = by(reshape.channel_breakdown(fact), "row_labels")["b"]
    four = by(reshape.channel_breakdown(fact, total_over_fixed=True), "row_labels")["b"]
    assert every["Push_Sent"] == "" and every["Total_Sent"] == "500"
    assert four["Total_Sent"] == "0"


@pytest.mark.parametrize("one_task_rows", [0, 10**9])
@pytest.mark.parametrize("shape", ["spread", "ties", "hot", "tiny", "constant"])
def test_quantiles(spark, one_task_rows, shape):
    rng = random.Random(shape)
    values = {
        "spread": [rng.gauss(0, 100) for _ in range(5_000)],
        "ties": [float(rng.randint(0, 6)) for _ in range(3_000)],
        "hot": [1.5] * 2_000 + [rng.random() * 1e6 for _ in range(1_000)],
        "tiny": [3.0, 1.0, 2.0],
        "constant": [4.0] * 50,
    }[shape]
    frame = spark.createDataFrame([(v, -v) for v in values], "x double, y double")
    points = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    found = quantiles.exact_quantiles(frame, ["x", "y"], points, one_task_rows)
    for name, sign in (("x", 1), ("y", -1)):
        expected = np.quantile(sign * np.array(values), points)
        assert found[name] == pytest.approx(list(expected), rel=1e-12, abs=1e-9)


def test_quantiles_of_nothing(spark):
    frame = spark.createDataFrame([], "x double")
    assert quantiles.exact_quantiles(frame, ["x"], [0.5]) == {"x": [None]}
    assert quantiles.exact_quantiles(frame, ["x"], [0.5], one_task_rows=-1) == {"x": [None]}


def test_quantiles_wait_for_the_plan(spark):
    frame = spark.range(1_000).select((F.col("id") % 97).cast("double").alias("roi"))
    context = spark.sparkContext
    context.setJobGroup("lazy", "plans only")
    try:
        built = [
            analytics.performance_tiers(frame, ["roi"]),
            analytics.high_volume_flags(frame, ["roi"]),
            filters.above_median(frame, "roi"),
        ]
        for table in built:
            table._jdf.queryExecution().executedPlan()
        assert list(context.statusTracker().getJobIdsForGroup("lazy")) == []
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    values = np.arange(1_000) % 97.0
    assert built[2].count() == int((values > np.quantile(values, 0.5)).sum())
    assert built[1].where("roi_high").count() == int((values >= np.quantile(values, 0.95)).sum())


def test_tiers_without_values(spark):
    frame = spark.createDataFrame([("a", None), ("b", None)], "journey_name string, roi double")
    assert {r["roi_tier"] for r in analytics.performance_tiers(frame, ["roi"]).collect()} == {"none"}
    assert filters.above_median(frame, "roi").count() == 0
    assert analytics.performance_tiers(frame.limit(0), ["roi"]).count() == 0


def test_tiers(spark):
    data = [(f"j{i:02d}", float(i)) for i in range(101)]
    frame = spark.createDataFrame(data, "journey_name string, roi double")
    found = by(analytics.performance_tiers(frame, ["roi"]), "journey_name")
    tiers = {name: row["roi_tier"] for name, row in found.items()}
    assert tiers["j90"] == tiers["j100"] == "excellent"
    assert tiers["j75"] == tiers["j89"] == "good"
    assert tiers["j10"] == tiers["j00"] == "very_poor"
    assert tiers["j11"] == tiers["j25"] == "poor"
    assert tiers["j26"] == tiers["j74"] == "none"
    flat = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "journey_name string, roi double")
    assert {r["roi_tier"] for r in analytics.performance_tiers(flat, ["roi"]).collect()} == {"excellent"}
    flags = by(analytics.high_volume_flags(frame, ["roi"]), "journey_name")
    assert flags["j95"]["roi_high"] and not flags["j94"]["roi_high"]


def test_funnel(fact):
    stages = analytics.conversion_funnel(fact, CONFIG).orderBy("stage").collect()
    assert [s["value"] for s in stages] == [2900.0, 2300.0, 185.0, 15.0]
    assert stages[0]["pct_of_first"] == stages[0]["pct_of_previous"] == 100.0
    assert stages[2]["pct_of_previous"] == 185 / 2300 * 100


def test_shares_and_points(fact):
    summary = agg.journey_summary(fact, CONFIG)
    shares = analytics.volume_share(summary, 2).collect()
    assert sum(s["share"] for s in shares) == pytest.approx(1.0)
    assert analytics.cost_vs_gtv(summary).count() == 4
    assert analytics.cost_vs_gtv(summary.where("journey_name = 'a'")).count() == 0


def test_report_sections(fact):
    full = report(fact, CONFIG)
    assert set(full) == {"header", "config", *SECTIONS}
    header = full["header"].first()
    assert header["channels"] == "Email, InApp, Push, SMS, WhatsApp" and header["journeys"] == 4
    assert header["min_date"] == dt.date(2024, 12, 29)
    assert full["executive"].first()["sent"] == 2900
    assert full["performers"].count() == 8
    assert set(report(fact, CONFIG, ["volume"])) == {"header", "config", "volume"}
    single = report(fact.where("journey_name = 'a'"), CONFIG, ["performers"])
    assert single["performers"].count() == 0
    with pytest.raises(ValueError, match="unknown"):
        report(fact, CONFIG, ["nonsense"])


def test_dashboard_tabs(fact):
    spec = FilterSpec(channels=["Email", "SMS"])
    sizes = {
        tab: {name: frame.count() for name, frame in dashboard_tab(fact, tab, spec, CONFIG).items()}
        for tab in TABS
    }
    assert sizes["overview"] == {"kpis": 1, "channels": 2, "funnel": 4, "cost_vs_gtv": 2}
    assert sizes["channel-analysis"] == {"journeys": 2}
    assert sizes["weekly-analysis"] == {"daily": 2, "weekly": 2}
    assert sizes["trends"] == {"daily": 2} and sizes["volume-analysis"] == {"channels": 2}
    assert sizes["summary"] == {"journeys": 2} and sizes["details"] == {"campaigns": 3}
    assert sizes["report"]["journey_table"] == 2
    with pytest.raises(ValueError, match="unknown tab"):
        dashboard_tab(fact, "nonsense", spec, CONFIG)


def test_hot_group_keeps_every_row(spark):
    data = [(f"C{i}", "hot" if i % 3 else f"j{i}", "Email", float(i)) for i in range(3_000)]
    base = spark.createDataFrame(data, "campaign_id string, journey_name string, channel string, sent double")
    fact = base.selectExpr(
        "*", "sent AS delivered", "sent AS unique_clicks", "sent AS ct_conversions"
    )
    total = agg.totals_by(fact, ["journey_name"], CONFIG).agg(F.sum("sent"), F.sum("campaigns")).first()
    assert tuple(total) == (sum(range(3_000)) * 1.0, 3_000)
