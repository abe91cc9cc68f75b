import csv
import os
import random

import pytest

from dripline.config import MetricConfig
from dripline.sources import combine, reports, sinks
from dripline.streaming import incremental


def write_csv(path, header, data, mtime):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(header)
        writer.writerows(data)
    os.utime(path, (mtime, mtime))
    return str(path)


def as_dicts(frame):
    return [row.asDict() for row in frame.collect()]


HEADER = ["Campaign ID", "Day", "Start Date", "Sent"]


def test_latest_row_wins(spark, tmp_path):
    first = write_csv(tmp_path / "report1.csv", HEADER, [
        ["c1", "2024-01-05", "2024-01-02", "1"],
        ["c1", "2024-01-05", "", "2"],
        ["c1", "2024-01-05", "2024-01-03", "3"],
        ["c2", "2024-01-06 10:30:00", "2024-01-01", "4"],
        ["c2", "2024-01-06 10:30:00", "2024-01-01", "5"],
    ], 1_000)
    second = write_csv(tmp_path / "report2.csv", HEADER, [
        ["c2", "2024-01-06 10:30:00", "2024-01-01", "6"], ["", "", "", "7"], ["", "bad", "", "8"],
    ], 2_000)
    found = as_dicts(combine.combine_reports(spark, [first, second]))
    assert [(r["Campaign ID"], r["Day"], r["Start Date"], r["Sent"]) for r in found] == [
        ("c1", "2024-01-05", None, "2"),
        ("c2", "2024-01-06 10:30:00", "2024-01-01", "6"),
        (None, None, None, "8"),
    ]


def test_newer_file_wins_whatever_its_place(spark, tmp_path):
    old = write_csv(tmp_path / "report9.csv", HEADER, [["c", "2024-01-05", "2024-01-01", "old"]], 1_000)
    new = write_csv(tmp_path / "report1.csv", HEADER, [["c", "2024-01-05", "2024-01-01", "new"]], 9_000)
    for paths in ([old, new], [new, old]):
        assert [r["Sent"] for r in as_dicts(combine.combine_reports(spark, paths))] == ["new"]


@pytest.mark.parametrize("names", [("report (1).csv", "report+2.csv"), ("report_a.csv", "report b.csv")])
def test_equal_times_fall_back_to_list_order(spark, tmp_path, names):
    paths = [
        write_csv(tmp_path / name, HEADER, [["c", "2024-01-05", "2024-01-01", name]], 5_000)
        for name in names
    ]
    for given in (paths, paths[::-1]):
        (row,) = as_dicts(combine.combine_reports(spark, given))
        assert row["Sent"] == os.path.basename(given[-1])


def test_columns_drift(spark, tmp_path):
    one = write_csv(tmp_path / "report1.csv", ["Day", "Campaign Name", "Sent"], [["2024-01-01", "x", "1"]], 1)
    two = write_csv(tmp_path / "report2.csv", ["Sent", "Extra", "Day", "Campaign Name"], [["2", "e", "2024-01-02", "y"]], 2)
    empty = write_csv(tmp_path / "report0.csv", ["Ghost", "Day"], [], 3)
    (tmp_path / "report3.csv").write_text("")
    paths = [empty, one, two, str(tmp_path / "report3.csv"), str(tmp_path / "gone.csv")]
    combined = combine.combine_reports(spark, paths)
    assert combined.columns == ["Day", "Campaign Name", "Sent", "Extra"]
    assert [tuple(r) for r in combined.collect()] == [
        ("2024-01-01", "x", "1", None), ("2024-01-02", "y", "2", "e"),
    ]
    with pytest.raises(reports.NoReportRowsError):
        reports.read_reports(spark, [empty])


@pytest.mark.parametrize(
    ("columns", "key"),
    [
        (["Campaign ID", "Campaign Name", "Day", "Start Date"], ["Campaign ID", "Day"]),
        (["Campaign ID", "Start Date"], ["Campaign ID", "Start Date"]),
        (["Campaign Name", "Day"], ["Campaign Name", "Day"]),
        (["Campaign Name", "Start Date"], ["Campaign Name", "Start Date"]),
        (["Campaign ID", "Sent"], []),
        (["Day", "Sent"], []),
    ],
)
def test_dedupe_key(columns, key):
    assert combine.dedupe_key(columns) == key


def test_no_key_keeps_all_rows(spark, tmp_path):
    path = write_csv(tmp_path / "report.csv", ["Sent"], [["1"], ["1"]], 1)
    assert combine.combine_reports(spark, [path]).count() == 2


def brute_force(files):
    """Last row per (id, day) after a stable sort; missing values sort last."""
    indexed = [row for _, data, mtime in files for row in [(*r, mtime) for r in data]]
    ordered = sorted(indexed, key=lambda r: (r[1] == "", r[1], r[2] == "", r[2], r[4]))
    latest = {(r[0], r[1]): r[3] for r in ordered}
    return [(k[0] or None, k[1] or None, v) for k, v in latest.items()]


def random_files(tmp_path, seed):
    rng = random.Random(seed)
    files = []
    for i in range(4):
        data = [
            [
                rng.choice(["hot", "hot", "hot", "c1", "c2", ""]),
                rng.choice(["2024-01-05", "2024-01-06", ""]),
                rng.choice(["2024-01-01", "2024-01-02", ""]),
                f"{i}-{n}",
            ]
            for n in range(60)
        ]
        mtime = rng.choice([100, 200])
        files.append((write_csv(tmp_path / f"report{i}.csv", HEADER, data, mtime), data, mtime))
    return files


def values(frame):
    rows = [(r["Campaign ID"], r["Day"], r["Sent"]) for r in frame.collect()]
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force(spark, tmp_path, seed):
    files = random_files(tmp_path, seed)
    combined = combine.combine_reports(spark, [path for path, _, _ in files])
    assert values(combined) == sorted(brute_force(files), key=str)


def test_quoted_cells(spark, tmp_path):
    path = write_csv(tmp_path / "report.csv", ["Campaign ID", "Day", "Campaign Name"], [
        ["1", "2024-01-05", 'two\nlines, "quoted"'], ["2", "2024-01-06", "plain"],
    ], 1)
    found = [row["Campaign Name"] for row in combine.combine_reports(spark, [path]).collect()]
    assert found == ['two\nlines, "quoted"', "plain"]


def test_month_filter_skips_folders_of_the_log(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    data = [["c", f"2024-{month:02d}-05", "", str(month)] for month in range(1, 13)]
    write_csv(inbox / "report1.csv", HEADER, data, 1)
    log = str(tmp_path / "log")
    incremental.start_incremental_combine(spark, str(inbox), log, str(tmp_path / "s")).awaitTermination()
    march = incremental.current_rows(spark, log).where("report_month = 202403")
    assert [row["Sent"] for row in march.collect()] == ["3"]
    text = march._jdf.queryExecution().executedPlan().toString()
    assert "report_month" in text[text.index("PartitionFilters") : text.index("PushedFilters")]


def test_a_log_of_one_batch_is_read_without_comparing(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    files = random_files(inbox, 3)
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    incremental.start_incremental_combine(spark, str(inbox), log, state).awaitTermination()
    found = incremental.current_table(spark, log)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert values(found) == sorted(brute_force(files), key=str)


def test_ranks_reach_the_rows_without_a_shuffle(spark, tmp_path):
    paths = [
        write_csv(tmp_path / f"{name}.csv", HEADER, [["c", "2024-01-05", "", name]], 1)
        for name in ("b+ %41", "a c", "d")
    ]
    frame = reports.read_reports(spark, paths)
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text
    assert [row["Sent"] for row in frame.orderBy("_source_rank").collect()] == ["b+ %41", "a c", "d"]


def test_discover(spark, tmp_path):
    write_csv(tmp_path / "report_b.csv", HEADER, [["c", "", "", "1"]], 1)
    write_csv(tmp_path / "report_a.csv", HEADER, [["c", "", "", "1"]], 1)
    write_csv(tmp_path / "other.csv", HEADER, [["c", "", "", "1"]], 1)
    found = reports.discover(spark, str(tmp_path))
    assert [os.path.basename(path) for path in found] == ["report_a.csv", "report_b.csv"]


def test_stream_equals_batch(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    log, state = str(tmp_path / "log"), str(tmp_path / "state")
    files = random_files(inbox, 7)
    held = [(path, path + ".hold") for path, _, _ in files[2:]]
    for path, hold in held:
        os.rename(path, hold)

    def run():
        incremental.start_incremental_combine(
            spark, str(inbox), log, state, max_files_per_batch=1
        ).awaitTermination()

    run()
    assert values(incremental.current_table(spark, log)) == sorted(brute_force(files[:2]), key=str)
    for path, hold in held:
        os.rename(hold, path)
    drifted = ["Sent", "Campaign ID", "Day", "Note"]
    write_csv(inbox / "report9.csv", drifted, [["late", "hot", "2024-01-05", "n"]], 9_000)
    run()
    run()
    expected = dict(((i, d), v) for i, d, v in brute_force(files))
    # No start date in the last file: its row sorts last and wins.
    expected[("hot", "2024-01-05")] = "late"
    table = incremental.current_table(spark, log)
    assert values(table) == sorted(((i, d, v) for (i, d), v in expected.items()), key=str)
    assert "Note" in table.columns
    incremental.compact(spark, log, str(tmp_path / "log2"))
    assert values(incremental.current_table(spark, str(tmp_path / "log2"))) == values(table)


def test_load_report(spark, tmp_path):
    header = ["Campaign ID", "Journey Name", "Channel", "Status", "Day", "Sent", "Delivered",
              "Unique Clicks", "Unique Click-Through Conversions", "Revenue (INR)", "Note"]
    path = write_csv(tmp_path / "combined.csv", header, [
        ["1", " Wishlist Done ", "Email", "Done", "2024-01-05", "1,000", "900", "nan", "", "12.5", "kept"],
        ["2", "", "Fax", "NA", "never", "abc", "5", "2", "1", "", ""],
    ], 1)
    first, second = reports.load_report(spark, path, MetricConfig()).orderBy("campaign_id").collect()
    assert first["journey_name"] == "Wishlist Done" and first["user_type"] == "ALL"
    assert (first["sent"], first["unique_clicks"], first["ct_conversions"]) == (1000.0, 0.0, 0.0)
    assert first["cost"] == 20.0 and first["delivery_rate"] == 90.0 and first["Note"] == "kept"
    assert second["journey_name"] == "0" and second["status"] == "0" and second["day"] is None
    assert second["sent"] == 0.0 and second["cost"] == 0.0 and second["gtv"] == 1500.0
    with pytest.raises(Exception, match="unreadable date"):
        reports.load_report(spark, path, MetricConfig(), strict_days=True).collect()


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json", "orc"])
def test_write_table(spark, tmp_path, fmt):
    frame = spark.createDataFrame([("a,\"b\"", 1.5)], "name string, value double")
    path = str(tmp_path / fmt)
    sinks.write_table(frame, path, fmt)
    reader = spark.read.option("header", True).option("escape", '"') if fmt == "csv" else spark.read
    assert reader.format(fmt).load(path).select("name").first()["name"] == 'a,"b"'
    with pytest.raises(ValueError, match="unsupported"):
        sinks.write_table(frame, path, "xls")


def test_write_fact_prunes_months(spark, tmp_path):
    frame = spark.sql("SELECT id, date_add(DATE '2024-01-01', cast(id AS int)) AS day FROM range(90)")
    path = str(tmp_path / "fact")
    sinks.write_by_month(frame, path)
    back = spark.read.parquet(path)
    assert back.count() == 90 and back.select("report_month").distinct().count() == 3
