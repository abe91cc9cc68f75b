import os
import random

import pytest
from pyspark.sql import functions as F

from dripline.schema import MONTH
from dripline.sources import combine, sinks, versions
from dripline.sources.reports import NoReportRowsError, read_reports, typed_dates
from dripline.streaming import versioned
from tests.test_combine import HEADER, write_csv


def latest_rows(spark, paths):
    return combine.dedupe_latest(typed_dates(read_reports(spark, paths)))


def cells(frame):
    names = sorted(frame.columns)
    return sorted((tuple(row[x] for x in names) for row in frame.collect()), key=str)


def files_of(folder, n=6, seed=1):
    generator = random.Random(seed)
    paths = []
    for i in range(n):
        data = [
            [
                generator.choice(["hot", "hot", "c1", "c2", ""]),
                generator.choice(["2024-01-05", "2024-02-06", "2024-03-07", ""]),
                generator.choice(["2024-01-01", "2024-01-02", ""]),
                f"{i}-{k}",
            ]
            for k in range(40)
        ]
        paths.append(write_csv(folder / f"report{i}.csv", HEADER, data, generator.choice([100, 200])))
    return paths


def test_batches_equal_one_combine(spark, tmp_path):
    paths = files_of(tmp_path)
    root = str(tmp_path / "table")
    with pytest.raises(NoReportRowsError):
        versioned.current_table(spark, root)
    for i, path in enumerate(paths):
        versioned.merge(spark, root, latest_rows(spark, [path]), ("s", i))
    assert cells(versioned.current_table(spark, root)) == cells(combine.combine_reports(spark, paths))


def test_a_batch_counts_once_and_streams_are_told_apart(spark, tmp_path):
    one, two = files_of(tmp_path, 2)
    root = str(tmp_path / "table")
    versioned.merge(spark, root, latest_rows(spark, [one]), ("s", 3))
    before = versions.latest(spark, root)
    for batch in (3, 2):
        assert versioned.merge(spark, root, latest_rows(spark, [two]), ("s", batch)) == before
    assert versioned.merge(spark, root, latest_rows(spark, [two]), ("t", 0)).number == 2


def test_only_touched_months_are_written_and_reading_shuffles_nothing(spark, tmp_path):
    root = str(tmp_path / "table")
    first = write_csv(tmp_path / "report1.csv", HEADER, [
        ["c", f"2024-{month:02d}-05", "", str(month)] for month in range(1, 13)], 1)
    second = write_csv(tmp_path / "report2.csv", HEADER, [["c", "2024-03-05", "", "new"]], 2)
    before = versioned.merge(spark, root, latest_rows(spark, [first]))
    after = versioned.merge(spark, root, latest_rows(spark, [second]))
    changed = {x for x in after.folders if after.folders[x] != before.folders.get(x)}
    assert changed == {"202403"} and len(after.folders) == 12
    table = versioned.current_table(spark, root)
    assert {row["Sent"] for row in table.collect()} == {"new", *map(str, {*range(1, 13)} - {3})}
    assert "Exchange" not in table._jdf.queryExecution().executedPlan().toString()
    march = versioned.current_rows(spark, root).where(F.col(MONTH) == 202403)
    text = march._jdf.queryExecution().executedPlan().toString()
    assert MONTH in text[text.index("PartitionFilters") : text.index("PushedFilters")]


def test_columns_drift_and_a_new_key_merges_all_months(spark, tmp_path):
    starts = ["Campaign ID", "Start Date", "Sent"]
    one = write_csv(tmp_path / "report1.csv", starts, [
        ["c", "2024-01-01", "1"], ["c", "2024-01-02", "2"], ["d", "2024-01-02", "3"]], 1)
    two = write_csv(tmp_path / "report2.csv", ["Note", *HEADER], [["n", "c", "2024-02-01", "", "4"]], 2)
    root = str(tmp_path / "table")
    versioned.merge(spark, root, latest_rows(spark, [one]))
    assert versioned.current_table(spark, root).count() == 3
    versioned.merge(spark, root, latest_rows(spark, [two]))
    expected = combine.dedupe_latest(combine.align([latest_rows(spark, [x]) for x in (one, two)]))
    expected = combine.drop_provenance(combine.render_dates(expected))
    found = versioned.current_table(spark, root)
    assert cells(found) == cells(expected)
    assert found.columns == ["Campaign ID", "Start Date", "Sent", "Note", "Day"]


def test_a_job_that_dies_before_the_switch_changes_nothing(spark, tmp_path, monkeypatch):
    one, two = files_of(tmp_path, 2)
    root = str(tmp_path / "table")
    versioned.merge(spark, root, latest_rows(spark, [one]), ("s", 0))
    before = cells(versioned.current_table(spark, root))
    with monkeypatch.context() as patch:
        patch.setattr(versions, "commit", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError, match="killed"):
            versioned.merge(spark, root, latest_rows(spark, [two]), ("s", 1))
    assert cells(versioned.current_table(spark, root)) == before
    versioned.merge(spark, root, latest_rows(spark, [two]), ("s", 1))
    expected = combine.combine_reports(spark, [one, two])
    assert cells(versioned.current_table(spark, root)) == cells(expected)


def test_compaction_starts_again_when_a_stream_was_first(spark, tmp_path, monkeypatch):
    one, two = files_of(tmp_path, 2)
    root = str(tmp_path / "table")
    versioned.merge(spark, root, latest_rows(spark, [one]), ("s", 0))
    commit, calls = versions.commit, []

    def late(session, place, version):
        calls.append(version.number)
        if len(calls) == 1:  # the stream's batch comes between the compaction's data and its switch
            versioned.merge(session, place, latest_rows(spark, [two]), ("s", 1))
        commit(session, place, version)

    monkeypatch.setattr(versions, "commit", late)
    assert versioned.compact(spark, root).number == 3
    assert calls == [2, 2, 3]
    expected = combine.combine_reports(spark, [one, two])
    assert cells(versioned.current_table(spark, root)) == cells(expected)


def test_old_versions_stay_until_they_expire(spark, tmp_path):
    root = str(tmp_path / "table")
    for path in files_of(tmp_path, 4):
        versioned.merge(spark, root, latest_rows(spark, [path]))
    first = versions.read(spark, root, versions._read(spark, root, 1))
    n = first.count()
    assert versions.expire(spark, root, keep=4) == 0 and first.count() == n
    now = cells(versioned.current_table(spark, root))
    assert versions.expire(spark, root, keep=1) > 0
    assert versions._numbers(spark, root) == [4]
    assert cells(versioned.current_table(spark, root)) == now


def test_stream_with_restarts(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    paths = files_of(inbox, 5)
    root, state = str(tmp_path / "table"), str(tmp_path / "state")
    for path in paths[2:]:
        os.rename(path, path + ".hold")

    def run():
        versioned.start_versioned_combine(
            spark, str(inbox), root, state, max_files_per_batch=2
        ).awaitTermination()

    run()
    for path in paths[2:]:
        os.rename(path + ".hold", path)
    run()
    run()
    expected = combine.combine_reports(spark, paths)
    assert cells(versioned.current_table(spark, root)) == cells(expected)


def test_a_table_is_replaced_by_one_switch(spark, tmp_path):
    root = str(tmp_path / "result")
    with pytest.raises(FileNotFoundError):
        sinks.current_table(spark, root)
    sinks.replace_table(spark.range(5), root)
    breaks = F.when(F.col("id") > 90, F.raise_error(F.lit("broken"))).otherwise(F.col("id"))
    with pytest.raises(Exception, match="broken"):
        sinks.replace_table(spark.range(100).select(breaks.cast("long").alias("id")), root)
    assert sinks.current_table(spark, root).count() == 5
    old = sinks.current_table(spark, root)
    sinks.replace_table(spark.range(7), root)
    assert sinks.current_table(spark, root).count() == 7 and old.count() == 5


def test_new_months_come_as_they_were_written(spark, tmp_path, monkeypatch):
    months = [[["c", f"2024-{m:02d}-05", "", f"{i}-{m}"] for m in range(first, first + 2)]
              for i, first in enumerate((1, 3, 4))]
    paths = [write_csv(tmp_path / f"report{i}.csv", HEADER, x, i + 1) for i, x in enumerate(months)]
    rows = [latest_rows(spark, [path]) for path in paths]
    root = str(tmp_path / "table")
    with monkeypatch.context() as patch:
        patch.setattr(versioned, "dedupe_latest", lambda *_: pytest.fail("compared again"))
        versioned.merge(spark, root, rows[0], ("s", 0), reduced=True)
        before = versioned.merge(spark, root, rows[1], ("s", 1), reduced=True)
    after = versioned.merge(spark, root, rows[2], ("s", 2), reduced=True)
    assert {x for x in after.folders if after.folders[x] != before.folders.get(x)} == {"202404", "202405"}
    assert cells(versioned.current_table(spark, root)) == cells(combine.combine_reports(spark, paths))


def test_reduced_batches_equal_one_combine(spark, tmp_path):
    paths = files_of(tmp_path, seed=7)
    root = str(tmp_path / "table")
    for i, path in enumerate(paths):
        versioned.merge(spark, root, latest_rows(spark, [path]), ("s", i), reduced=True)
    assert cells(versioned.current_table(spark, root)) == cells(combine.combine_reports(spark, paths))


def test_compaction_puts_files_together_without_a_shuffle(spark, tmp_path):
    root = str(tmp_path / "table")
    data = [["c", f"2024-{m:02d}-{d:02d}", "", f"{m}-{d}"] for m in (1, 2, 3) for d in range(1, 20)]
    path = write_csv(tmp_path / "report1.csv", HEADER, [*data, ["c", "", "", "none"]], 1)
    version = versioned.merge(spark, root, latest_rows(spark, [path]))
    rows = versions.read(spark, root, version)
    folder = versions.new_folder()
    rows.repartition(4).write.partitionBy(MONTH).parquet(f"{root}/{folder}")
    folders = {x: f"{folder}/{MONTH}={x}" for x in version.folders}
    versions.commit(spark, root, versions.Version(2, folders, version.notes))
    before = cells(versioned.current_rows(spark, root))
    plan = versioned._month_by_month(spark, root, folders, 1 << 20)._jdf.queryExecution()
    assert "Exchange" not in plan.executedPlan().toString()
    whole = versioned.compact(spark, root)
    assert cells(versioned.current_rows(spark, root)) == before
    files = [len([y for y in os.listdir(f"{root}/{x}") if y.endswith(".parquet")]) for x in whole.folders.values()]
    # The largest month keeps two tasks, so that the months are not all read by one.
    assert len(files) == 4 and sum(files) <= 5
    versioned.compact(spark, root, [202401])
    assert cells(versioned.current_rows(spark, root)) == before
