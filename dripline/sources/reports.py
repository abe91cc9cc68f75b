"""Reading report CSV files whose columns drift from file to file."""

from __future__ import annotations

import logging
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from fnmatch import fnmatchcase
from functools import reduce
from pathlib import PurePosixPath
from typing import TypeVar
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from dripline.config import MetricConfig
from dripline.functions.exprs import missing_to_null, parse_day
from dripline.operators.lookups import _INLINE_ROWS, local_table, with_segments
from dripline.operators.rows import clean_numeric, clean_strings, parse_days, with_row_metrics
from dripline.schema import (
    HEADER_TO_COLUMN,
    PROVENANCE_COLUMNS,
    SOURCE_BLOCK,
    SOURCE_FILE,
    SOURCE_RANK,
    SOURCE_ROW,
    SOURCE_TS,
)

log = logging.getLogger(__name__)


def discover(spark: SparkSession, folder: str, pattern: str = "report*.csv") -> list[str]:
    """Report files of a folder, sorted by path; file listing only, no content is read."""
    listing = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path")
    )
    return sorted(row["path"] for row in listing.collect())


class NoReportRowsError(ValueError):
    """None of the given files holds a row."""


@dataclass(frozen=True)
class RejectedFile:
    """A file that is left out, and why."""

    path: str
    reason: str


@dataclass
class _HeaderGroup:
    """Files that share one header, and of each its path, its rank and its path as rows give it."""

    paths: list[str] = field(default_factory=list)
    file_ranks: list[tuple[str, str, str]] = field(default_factory=list)


def _read_raw(spark: SparkSession, paths: str | list[str], multi_line: bool) -> DataFrame:
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.csv(paths)


def _spelled(path: str) -> str:
    """One spelling of local paths, which Spark gives with one slash or with three."""
    return re.sub("^file:/+", "file:/", path)


_FILE = "_metadata.file_path"


def _file_path(file: str) -> Column:
    """The path of a file, spelled as :func:`_spelled` does."""
    # "+" stays as it is in a file path, but url_decode would take it for a blank.
    path = F.url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(path, "^file:/+", "file:/")


_MISSING = re.compile(r"\[PATH_NOT_FOUND\] Path does not exist: (.*?)\. SQLSTATE")
_UNREADABLE = re.compile(r"\[FAILED_READ_FILE[^]]*\] Encountered error while reading file (.*?)\.\s")

Found = TypeVar("Found")


def _without_failing(
    paths: list[str], run: Callable[[list[str]], Found]
) -> tuple[Found | None, list[RejectedFile]]:
    """Run over paths; a path that is missing or breaks is set aside and the rest is run again."""
    rejected: list[RejectedFile] = []
    left = {_spelled(path): path for path in paths}
    while left:
        try:
            return run(list(left.values())), rejected
        except (PySparkException, Py4JJavaError) as error:
            text = str(error)
            missing, broken = _MISSING.search(text), _UNREADABLE.search(text)
            found = missing[1] if missing else unquote(broken[1]) if broken else None
            # Paths given without a scheme are reported with one.
            names = [x for x in left if found and _spelled(found).endswith(x)]
            if not names:
                raise
            reason = "missing" if missing else "breaks while it is read"
            name = max(names, key=len)
            log.warning("skipping %s: %s", left[name], reason)
            rejected.append(RejectedFile(left.pop(name), reason))
    return None, rejected


def _list_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files below some paths, from a listing alone."""
    listing = spark.read.format("binaryFile").load(paths).select("path")
    return [row["path"] for row in listing.collect()]


def _ranks(paths: Sequence[str], files: list[str]) -> dict[str, str]:
    """The place in the list of the path that each file was given by."""
    given: dict[str, int] = {}
    for rank, path in enumerate(paths):
        given.setdefault(re.sub("^[a-z0-9]+:/+", "/", path).rstrip("/"), rank)
    patterns = [(x, rank) for x, rank in given.items() if any(c in x for c in "*?[{")]
    out = {}
    for file in files:
        plain = re.sub("^[a-z0-9]+:/+", "/", file)
        places = [plain, *map(str, PurePosixPath(plain).parents)]
        # A relative path is the end of the whole one.
        rank = next((given[x] for x in places if x in given), None)
        if rank is None:
            rank = next((r for x, r in given.items() if plain.endswith(f"/{x}")), None)
        if rank is None:
            hits = (r for x, r in patterns if any(fnmatchcase(y, x) for y in places))
            rank = next(hits, len(given))
        out[_spelled(file)] = f"{rank:012d}"
    return out


def _rank_table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """The ranks of files as a table of known size, so that rows get theirs without a shuffle."""
    blocks = [rows[i : i + _INLINE_ROWS] for i in range(0, len(rows), _INLINE_ROWS)]
    tables = [local_table(spark, block, (SOURCE_RANK, "_rank")) for block in blocks]
    return reduce(DataFrame.union, tables)


def _group_by_header(
    spark: SparkSession, paths: Sequence[str]
) -> tuple[list[_HeaderGroup], list[RejectedFile]]:
    """Group files by header, in order of first appearance; files without rows drop out.

    One listing and one pass over the lines, whatever the number of files: the first line of every
    file comes from the executors. A header with a line break inside quotes is its file's own.
    """
    listed, missing = _without_failing(list(paths), lambda left: _list_files(spark, left))
    ranks = _ranks(paths, listed or [])

    def first_lines(files: list[str]) -> list:
        place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        lines = spark.read.text(files).select(F.col(_FILE).alias("file"), "value", place.alias("at"))
        return (
            lines.where(F.trim("value") != "")
            .groupBy("file")
            .agg(F.min_by("value", "at").alias("header"), F.count(F.lit(1)).alias("n"))
            .where("n > 1")
            .select("file", _file_path("file").alias("path"), "header")
            .collect()
        )

    found, broken = _without_failing(listed or [], first_lines)
    rows = sorted(found or [], key=lambda row: (ranks[row["path"]], row["path"]))
    groups: dict[tuple[str, str], _HeaderGroup] = {}
    for row in rows:
        alone = row["path"] if row["header"].count('"') % 2 else ""
        group = groups.setdefault((row["header"], alone), _HeaderGroup())
        group.paths.append(row["path"])
        group.file_ranks.append((row["path"], ranks[row["path"]], row["file"]))
    return list(groups.values()), [*missing, *broken]


def _unsound(spark: SparkSession, group: _HeaderGroup, multi_line: bool) -> DataFrame:
    """(path, reason) of the files of a group that do not fit their header, or are not UTF-8."""
    names = _read_raw(spark, group.paths, multi_line).columns
    more = "_more"
    while more in names:
        more += "_"
    fields = [StructField(name, StringType()) for name in (*names, more)]
    reader = spark.read.schema(StructType(fields)).option("header", True).option("escape", '"')
    rows = reader.option("multiLine", multi_line).csv(group.paths)
    unreadable = F.lit(False)
    for name in names:
        unreadable |= F.coalesce(F.contains(F.col(f"`{name}`"), F.lit("\ufffd")), F.lit(False))
    counted = (
        rows.groupBy(F.col(_FILE).alias("file"))
        .agg(F.count_if(F.col(more).isNotNull()).alias("longer"), F.count_if(unreadable).alias("odd"))
        .withColumn("path", _file_path("file"))
    )
    longer = F.concat("longer", F.lit(" rows with more cells than the header"))
    odd = F.concat("odd", F.lit(" rows that are not UTF-8"))
    return counted.where("longer > 0 OR odd > 0").select(
        "path", F.when(F.col("longer") > 0, longer).otherwise(odd).alias("reason")
    )


def _sound(
    spark: SparkSession, groups: list[_HeaderGroup], multi_line: bool
) -> tuple[list[_HeaderGroup], list[RejectedFile]]:
    """The groups without the files that cannot be read to their end as their header says."""
    rejected = []
    for group in groups:
        found = _unsound(spark, group, multi_line).collect()
        rejected += [RejectedFile(row["path"], row["reason"]) for row in found]
    bad = {x.path for x in rejected}
    for file in rejected:
        log.warning("skipping %s: %s", file.path, file.reason)
    kept = [
        _HeaderGroup(
            [x for x in group.paths if x not in bad],
            [x for x in group.file_ranks if x[0] not in bad],
        )
        for group in groups
    ]
    return [group for group in kept if group.paths], rejected


def read_reports(
    spark: SparkSession,
    paths: Sequence[str],
    multi_line: bool = True,
    skip_bad: bool = False,
    rejected: list[RejectedFile] | None = None,
) -> DataFrame:
    """All report files as one text table with provenance columns.

    One scan per distinct header, matched by name: the first file sets the column order,
    later columns append, and a column a file lacks is null. Missing files, and files that break
    while their lines are read, are left out. With ``skip_bad`` so are, as a whole, files with a
    row that has more cells than the header or is not UTF-8; that takes one more pass. All that
    are left out are added to ``rejected``.

    Quoted cells may span lines, so each file is read by one task. ``multi_line=False`` splits
    large files over tasks, for reports without line breaks in cells.
    """
    groups, left_out = _group_by_header(spark, list(paths))
    if skip_bad:
        groups, unsound = _sound(spark, groups, multi_line)
        left_out += unsound
    if rejected is not None:
        rejected += left_out
    if not groups:
        raise NoReportRowsError("no report rows found in the given files")
    in_path_order = list(paths) == sorted(paths)
    parts = []
    for group in groups:
        raw = _read_raw(spark, group.paths, multi_line)
        texts = [missing_to_null(F.col(f"`{name}`")).alias(name) for name in raw.columns]
        # Position of a row: file in the list, block in the file, row in the block.
        part = raw.select(
            *texts,
            F.col("_metadata.file_modification_time").alias(SOURCE_TS),
            F.col("_metadata.file_name").alias(SOURCE_FILE),
            F.col(_FILE).alias(SOURCE_RANK),
            F.col("_metadata.file_block_start").alias(SOURCE_BLOCK),
            F.monotonically_increasing_id().alias(SOURCE_ROW),
        )
        # The path is spelled once per file, not once per row.
        ranks = [(file, path if in_path_order else rank) for path, rank, file in group.file_ranks]
        part = part.join(_rank_table(spark, ranks), SOURCE_RANK, "left")
        part = part.withColumn(SOURCE_RANK, F.col("_rank"))
        parts.append(part.select(*(f"`{x}`" for x in raw.columns), *PROVENANCE_COLUMNS))
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part, allowMissingColumns=True)
    return combined


def standardize(df: DataFrame) -> DataFrame:
    """Rename known report headers to engine columns; unknown columns pass through."""
    return df.withColumnsRenamed({k: v for k, v in HEADER_TO_COLUMN.items() if k in df.columns})


def load_report(
    spark: SparkSession,
    path: str,
    config: MetricConfig,
    strict_days: bool = False,
    trim: bool = True,
    strip_nan: bool = True,
    multi_line: bool = True,
) -> DataFrame:
    """One report file, or a folder of part files with one header, as the analytic table."""
    raw = _read_raw(spark, path, multi_line)
    texts = raw.select(*[missing_to_null(F.col(f"`{name}`")).alias(name) for name in raw.columns])
    cleaned = clean_strings(clean_numeric(standardize(texts), strip_nan=strip_nan), trim=trim)
    return with_row_metrics(with_segments(parse_days(cleaned, strict_days), config), config)


def typed_dates(df: DataFrame) -> DataFrame:
    """Report dates as timestamps, unreadable ones null."""
    present = [name for name in ("Day", "Start Date") if name in df.columns]
    return df.withColumns({name: parse_day(F.col(f"`{name}`")) for name in present})
