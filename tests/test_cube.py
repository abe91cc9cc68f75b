"""The stored cube gives what the report rows give, and reads only its own files."""

import random

import pytest
from pyspark.sql import functions as F

from dripline.config import MetricConfig
from dripline.operators import aggregates as agg, filters
from dripline.operators.filters import FilterSpec
from dripline.plans import cube
from dripline.plans.dashboard import TABS, dashboard_tab
from dripline.plans.report import report
from dripline.sources import combine, reports, versions
from dripline.sources.reports import read_reports, typed_dates
from dripline.streaming import versioned
from tests.test_combine import write_csv

CONFIG = MetricConfig(segments={"a": ("NU", "ALL"), "b": ("RU", "OM")})

HEADER = [
    "Campaign ID", "Campaign Name", "Journey Name", "Channel", "Status", "Day", "Sent",
    "Delivered", "Unique Impressions", "Unique Clicks", "Unique Conversions",
    "Unique Click-Through Conversions", "Revenue (INR)",
]
SPECS = [
    FilterSpec(),
    FilterSpec(statuses=["Running"], user_types=["NU"], start="2024-01-02", end="2024-02-03"),
    FilterSpec(journeys=[], channels=[], empty_means_all=True),
]


def data_of(seed, n=80, months=("01", "02", "03")):
    draw = random.Random(seed)
    data = []
    for i in range(n):
        day = draw.choice([f"2024-{m}-{d}" for m in months for d in ("02", "03", "03 10:30:00")] + [""])
        sent = draw.randint(0, 500)
        data.append([
            f"c{draw.randint(0, 30)}", "name", draw.choice(["a", "a", "a", "b", "", "c"]),
            draw.choice(["Email", "Email", "SMS", "Other", ""]),
            draw.choice(["Running", "Paused", ""]), day, str(sent), str(sent // 2), "1",
            str(sent // 4), "2", str(sent // 9), "10.5",
        ])
    return data


def rows_of(frame):
    names = sorted(frame.columns)
    return sorted((str(tuple(row[x] for x in names)) for row in frame.collect()))


@pytest.fixture(scope="module")
def fact(spark, tmp_path_factory):
    path = write_csv(tmp_path_factory.mktemp("fact") / "report1.csv", HEADER, data_of(1, 400), 1)
    return reports.load_report(spark, path, CONFIG)


@pytest.fixture(scope="module")
def stored(fact, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("cube"))
    cube.store_cube(fact, root)
    return root


@pytest.mark.parametrize("tab", sorted(set(TABS) - {"details"}))
def test_tabs_from_the_cube(spark, fact, stored, tab):
    found = dashboard_tab(cube.current_cube(spark, stored), tab, SPECS[1], CONFIG)
    wanted = dashboard_tab(fact, tab, SPECS[1], CONFIG)
    assert found.keys() == wanted.keys()
    for name, frame in found.items():
        assert rows_of(frame) == rows_of(wanted[name]), name


def test_counts_and_profiles_from_the_cube(spark, fact, stored):
    rows = cube.current_cube(spark, stored)
    assert rows.count() < fact.count()
    assert rows_of(agg.load_profile(rows)) == rows_of(agg.load_profile(fact))
    for spec in SPECS:
        found = filters.selection_counts(rows, spec, CONFIG)
        assert rows_of(found) == rows_of(filters.selection_counts(fact, spec, CONFIG))
    nothing = filters.selection_counts(fact, FilterSpec(journeys=[]), CONFIG).collect()
    assert nothing == filters.selection_counts(rows, FilterSpec(journeys=[]), CONFIG).collect()
    with pytest.raises(ValueError, match="needs report rows"):
        dashboard_tab(rows, "details", SPECS[0], CONFIG)


def test_tabs_read_the_cube_only(spark, stored):
    rows = cube.current_cube(spark, stored)
    frames = [
        *dashboard_tab(rows, "overview", SPECS[0], CONFIG).values(),
        *dashboard_tab(rows, "trends", SPECS[0], CONFIG).values(),
        *report(rows, CONFIG, share_scan=False).values(),
    ]
    for frame in frames:
        files = frame.inputFiles()
        assert files and all(stored in x for x in files)


def test_refresh_reads_touched_months_only(spark, tmp_path):
    combined, root = str(tmp_path / "combined"), str(tmp_path / "cube")
    paths = []

    def bring(name, data, arrived):
        paths.append(write_csv(tmp_path / name, HEADER, data, arrived))
        latest = combine.dedupe_latest(typed_dates(read_reports(spark, paths[-1:])))
        versioned.merge(spark, combined, latest)
        return cube.refresh_cube(spark, root, combined)

    def whole():
        path = str(tmp_path / f"combined-{len(paths)}")
        texts = combine.combine_reports(spark, paths, in_order=False)
        texts.coalesce(1).write.option("header", True).csv(path)
        return cube.cube_of(reports.load_report(spark, path, CONFIG))

    first = bring("report1.csv", data_of(2), 100)
    current = cube.current_cube(spark, root)
    assert rows_of(current.drop("report_month")) == rows_of(whole())
    assert cube.refresh_cube(spark, root, combined) == first
    second = bring("report2.csv", [x for x in data_of(3, months=("02",)) if x[5]], 200)
    changed = {x for x in second.folders if second.folders[x] != first.folders.get(x)}
    assert changed == {"202402"} and first.folders.keys() == second.folders.keys()
    assert rows_of(cube.current_cube(spark, root).drop("report_month")) == rows_of(whole())
    # Compaction gives months new folders, and the cube the same rows.
    before = rows_of(cube.current_cube(spark, root))
    versioned.compact(spark, combined)
    assert cube.refresh_cube(spark, root, combined).number == second.number + 1
    assert rows_of(cube.current_cube(spark, root)) == before


def test_cubes_without_rows(spark, fact, tmp_path):
    root = str(tmp_path / "cube")
    with pytest.raises(FileNotFoundError):
        cube.current_cube(spark, root)
    assert versions.latest(spark, root).number == 0
    assert cube.cube_of(fact.where(F.lit(False))).count() == 0
    months = {r["report_month"] for r in cube.cube_of(fact.withColumn("report_month", F.lit(7))).collect()}
    assert months == {7}
