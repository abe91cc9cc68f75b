import gzip
import os

import pytest

from dripline.sources import combine, reports
from tests.test_combine import HEADER, write_csv


def rows_of(frame):
    return sorted((r["Campaign ID"], r["Sent"]) for r in frame.collect())


def test_files_that_break_after_their_header_are_left_out(spark, tmp_path):
    good = write_csv(tmp_path / "report1.csv", HEADER, [["a", "2024-01-05", "", "1"], ["b", "2024-01-05"]], 1)
    longer = write_csv(tmp_path / "report2.csv", HEADER, [
        ["c", "2024-01-05", "", "2"], ["d", "2024-01-05", "", "3", "too many"]], 1)
    content = "\n".join([",".join(HEADER), *(f"x{i},2024-01-05,,{os.urandom(9).hex()}" for i in range(20_000))])
    cut = tmp_path / "report 3+4.csv.gz"
    cut.write_bytes(gzip.compress(content.encode())[:100_000])
    whole = tmp_path / "report5.csv.gz"
    whole.write_bytes(gzip.compress((",".join(HEADER) + "\ne,2024-01-05,,5\n").encode()))
    odd = tmp_path / "report6.csv"
    odd.write_bytes(",".join(HEADER).encode() + b"\nf\xff,2024-01-05,,6\n")
    gone = str(tmp_path / "gone.csv")
    paths = [good, longer, str(cut), str(whole), str(odd), gone]
    for given in (paths, paths[::-1]):
        rejected = []
        found = combine.combine_reports(spark, given, skip_bad=True, rejected=rejected)
        assert rows_of(found.fillna("")) == [("a", "1"), ("b", ""), ("e", "5")]
        reasons = {os.path.basename(x.path): x.reason for x in rejected}
        assert reasons == {
            "report2.csv": "1 rows with more cells than the header",
            "report 3+4.csv.gz": "breaks while it is read",
            "report6.csv": "1 rows that are not UTF-8",
            "gone.csv": "missing",
        }
    rejected = []
    kept = combine.combine_reports(spark, paths, rejected=rejected)
    assert len(rejected) == 2 and kept.count() == 6


def test_nothing_is_left(spark, tmp_path):
    path = write_csv(tmp_path / "report.csv", ["Campaign ID", "Day"], [["a", "2024-01-05", "x"]], 1)
    with pytest.raises(reports.NoReportRowsError):
        combine.combine_reports(spark, [path], skip_bad=True)
    with pytest.raises(reports.NoReportRowsError):
        combine.combine_reports(spark, [str(tmp_path / "gone.csv")])


def test_many_files_take_as_many_jobs_as_few(spark, tmp_path):
    def jobs(n):
        folder = tmp_path / str(n)
        folder.mkdir()
        paths = [
            write_csv(folder / f"report{i:04d}.csv", HEADER, [[f"c{i}", "2024-01-05", "", str(i)]], 1)
            for i in range(n)
        ]
        group = f"survey-{n}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            frame = reports.read_reports(spark, paths)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert frame.count() == n
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    # Beyond 32 paths Spark lists them by a job.
    assert jobs(300) == jobs(50) <= 8


def test_folders_and_patterns_keep_the_order_of_the_list(spark, tmp_path):
    for name in ("b", "a"):
        (tmp_path / name).mkdir()
        write_csv(tmp_path / name / "report.csv", HEADER, [["c", "2024-01-05", "2024-01-01", name]], 5_000)
    for given, last in ((["b", "a"], "a"), (["a", "b"], "b"), (["b/*.csv", "a/r*.csv"], "a")):
        found = combine.combine_reports(spark, [str(tmp_path / x) for x in given])
        assert [row["Sent"] for row in found.collect()] == [last]


def test_headers_with_line_breaks_and_other_quotes(spark, tmp_path):
    names = ["Campaign ID", "Day", "a\nb", "Sent"]
    one = tmp_path / "report1.csv"
    one.write_text('Campaign ID,Day,"a\nb",Sent\nc,2024-01-05,x,1\n')
    two = tmp_path / "report2.csv"
    two.write_text('"Campaign ID","Day","Sent"\n"d","2024-01-06","2"\n')
    found = combine.combine_reports(spark, [str(one), str(two)])
    assert found.columns == names and rows_of(found) == [("c", "1"), ("d", "2")]
