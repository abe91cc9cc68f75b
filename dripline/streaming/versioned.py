"""A combined table that is kept current month by month, with one switch per batch of files.

The table holds one row per campaign and day; reading it compares no rows. A batch of new reports
is reduced to its latest rows, and only the months it touches are merged and written anew. Then the
table switches to a version with those months replaced. The batch's number belongs to the version,
so a batch that is replayed after a failure changes nothing twice, and compaction or a second writer
beside the stream only makes one of the two start again.

A row's month follows from its day, which is part of the key, so rows of one key are never in two
months. If a batch brings the column that changes the key, all months are merged anew.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from dripline.schema import MONTH
from dripline.sources import versions
from dripline.sources.combine import align, dedupe_key, dedupe_latest, drop_provenance, render_dates
from dripline.sources.reports import NoReportRowsError, read_reports, typed_dates
from dripline.sources.sinks import with_month
from dripline.sources.versions import Version
from dripline.streaming.incremental import arrivals

# Rows take many times the room of their Parquet files when a task sorts them.
FILE_BYTES = 16 << 20

# The folder name Spark gives to a null month.
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"


def _name(month: int | None) -> str:
    return _NO_MONTH if month is None else str(month)


def _in_months(names: Iterable[str]) -> Column:
    """Rows of the months with these names."""
    numbers = [int(x) for x in names if x != _NO_MONTH]
    chosen = F.col(MONTH).isin(numbers)
    return chosen | F.col(MONTH).isNull() if _NO_MONTH in names else chosen


def write_months(rows: DataFrame, root: str, folder: str | None = None) -> dict[str, str]:
    """Write rows by month; returns the folder of each month that has rows."""
    return _write_as_dealt(rows.hint("rebalance", F.col(MONTH)), root, folder)


def _write_as_dealt(rows: DataFrame, root: str, folder: str | None = None) -> dict[str, str]:
    folder = folder or versions.new_folder()
    rows.write.partitionBy(MONTH).parquet(f"{root}/{folder}")
    # The months stand in the names of the folders, so the rows are not computed for them.
    written = rows.sparkSession.read.schema(f"{MONTH} int").parquet(f"{root}/{folder}")
    months = [row[0] for row in written.select(MONTH).distinct().collect()]
    return {_name(x): f"{folder}/{MONTH}={_name(x)}" for x in months}


def merge(
    spark: SparkSession,
    root: str,
    new: DataFrame,
    batch: tuple[str, int] | None = None,
    reduced: bool = False,
) -> Version:
    """Bring rows with provenance into the table.

    ``batch`` is the name of a stream and the number of its batch; a batch that is in the table
    already is left out. ``reduced`` says that the rows are the latest of their campaign-days
    among themselves; months the table does not have then come to it as they were written.
    """
    dated = with_month(new, "Day")
    folder = versions.new_folder()
    if reduced:
        arrival = write_months(dated, root, folder)
    else:
        dated.write.parquet(f"{root}/{folder}")
    arrived = spark.read.schema(dated.schema).parquet(f"{root}/{folder}")
    touched = {_name(row[0]) for row in arrived.select(MONTH).distinct().collect()}

    def build(base: Version) -> Version | None:
        batches = dict(base.notes.get("batches", {}))
        if batch is not None:
            if batches.get(batch[0], -1) >= batch[1]:
                return None
            batches[batch[0]] = batch[1]
        before = base.notes.get("columns", [])
        columns = [*before, *(x for x in arrived.columns if x not in before and x != MONTH)]
        months = touched
        if before and dedupe_key(columns) != dedupe_key(before):
            months = touched | set(base.folders)
        stored = {x: base.folders[x] for x in months if x in base.folders}
        notes = {"columns": columns, "batches": batches}
        folders = {x: y for x, y in base.folders.items() if x not in months}
        rows = arrived
        # With the same key and columns, the rows of new months meet none they have not met.
        if reduced and set(columns) | {MONTH} == set(arrived.columns):
            folders |= {x: y for x, y in arrival.items() if x not in stored}
            if not stored:
                return Version(0, folders, notes)
            rows = arrived.where(_in_months(stored))
        if stored:
            rows = align([versions.read(spark, root, Version(0, stored)), rows])
        missing = [x for x in columns if x not in rows.columns]
        rows = rows.withColumns({x: F.lit(None).cast("string") for x in missing})
        # In the order in which the columns came, whichever months are read.
        rows = dedupe_latest(rows.select(*(f"`{x}`" for x in columns), MONTH))
        folders |= write_months(rows, root)
        return Version(0, folders, notes)

    return versions.change(spark, root, build)


def start_versioned_combine(
    spark: SparkSession,
    folder: str,
    root: str,
    checkpoint_path: str,
    pattern: str = "report*.csv",
    max_files_per_batch: int = 1_000,
    once: bool = True,
    name: str = "reports",
) -> StreamingQuery:
    """Merge arriving report files into the table below ``root``.

    The stream carries file names only. ``name`` tells apart the streams that write to one table;
    a stream that lost its checkpoint needs a new name.
    """

    def merge_batch(batch: DataFrame, batch_id: int) -> None:
        paths = sorted(row["path"] for row in batch.collect())
        if not paths:
            return
        try:
            rows = read_reports(batch.sparkSession, paths)
        except NoReportRowsError:
            return
        latest = dedupe_latest(typed_dates(rows))
        merge(batch.sparkSession, root, latest, (name, batch_id), reduced=True)

    files = arrivals(spark, folder, pattern, max_files_per_batch)
    writer = files.writeStream.foreachBatch(merge_batch).option(
        "checkpointLocation", checkpoint_path
    )
    writer = writer.trigger(availableNow=True) if once else writer
    return writer.start()


def current_rows(spark: SparkSession, root: str) -> DataFrame:
    """The table's rows with provenance; a filter on ``report_month`` reads those months only."""
    version = versions.latest(spark, root)
    rows = versions.read(spark, root, version)
    if rows is None:
        raise NoReportRowsError(f"no report was merged into {root}")
    return rows.select(*(f"`{x}`" for x in version.notes["columns"]), MONTH)


def current_table(spark: SparkSession, root: str) -> DataFrame:
    """The combined table as of the last finished batch."""
    return drop_provenance(render_dates(current_rows(spark, root).drop(MONTH)))


def _month_by_month(
    spark: SparkSession, root: str, stored: dict[str, str], file_bytes: int
) -> DataFrame:
    """Stored months, each read in as many tasks as it is to have files. A month lies in a folder of
    its own, so its files are put together where they are read and no row is shuffled."""
    files = spark.read.format("binaryFile").load([f"{root}/{x}" for x in stored.values()])
    sizes = dict.fromkeys(stored.values(), 0)
    for path, length in files.select("path", "length").collect():
        # The last three folders are those of a version's data: data, version and month.
        sizes["/".join(path.split("/")[-4:-1])] += length
    whole = versions.read(spark, root, Version(0, stored))
    reader = spark.read.schema(whole.schema).option("basePath", f"{root}/data")
    tasks = {x: max(1, -(-size // file_bytes)) for x, size in sizes.items()}
    # A union of tables of one task each would be read by one task, all months together.
    if len(tasks) > 1 and max(tasks.values()) == 1:
        tasks[max(sizes, key=sizes.get)] = 2
    names = [f"`{x}`" for x in whole.columns]
    parts = [
        reader.parquet(f"{root}/{folder}").coalesce(n).select(*names) for folder, n in tasks.items()
    ]
    return reduce(DataFrame.union, parts)


def compact(
    spark: SparkSession,
    root: str,
    months: Sequence[int | None] | None = None,
    file_bytes: int = FILE_BYTES,
) -> Version:
    """Write months anew in files of about ``file_bytes``, beside streams that go on.

    If a stream was first, the compaction starts again from its version.
    """

    def build(base: Version) -> Version | None:
        wanted = set(base.folders) if months is None else {_name(x) for x in months}
        stored = {x: y for x, y in base.folders.items() if x in wanted}
        if not stored:
            return None
        rows = _month_by_month(spark, root, stored, file_bytes)
        return Version(0, {**base.folders, **_write_as_dealt(rows, root)}, base.notes)

    return versions.change(spark, root, build)
