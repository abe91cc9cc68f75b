"""Tables that change by one switch: readers see one version whole, never a half-written one.

A table is a folder. Data is written to folders of its own below ``data``, each used once. Which of
them make up the table stands in small numbered files below ``versions``; the file with the highest
number is the table. A writer puts its data in place first and then adds the next number. If someone
else has added that number meanwhile, the writer starts again from the new version, so no change is
lost. A job that dies before the switch leaves the table as it was.

Old versions stay readable until :func:`expire` removes them. A version file holds one entry per
folder: a few hundred for a table by months.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

ATTEMPTS = 10


class ConflictError(RuntimeError):
    """Another writer has added the next version."""


@dataclass(frozen=True)
class Version:
    """Number 0 is a table that was never written. ``folders`` maps names of parts to paths below
    the table, ``notes`` holds what else belongs to the version."""

    number: int = 0
    folders: dict[str, str] = field(default_factory=dict)
    notes: dict = field(default_factory=dict)


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path):
    return path.getFileSystem(spark._jsc.hadoopConfiguration())


def _numbers(spark: SparkSession, root: str) -> list[int]:
    place = _path(spark, f"{root}/versions")
    files = _files(spark, place)
    if not files.exists(place):
        return []
    names = [x.getPath().getName() for x in files.listStatus(place)]
    return sorted(int(x.removesuffix(".json")) for x in names if x[0].isdigit())


def _read(spark: SparkSession, root: str, number: int) -> Version:
    text = spark.read.text(f"{root}/versions/{number:012d}.json", wholetext=True).first()[0]
    return Version(number, **json.loads(text))


def latest(spark: SparkSession, root: str) -> Version:
    numbers = _numbers(spark, root)
    return _read(spark, root, numbers[-1]) if numbers else Version()


def new_folder() -> str:
    """A folder for data, below the table."""
    return f"data/version={uuid.uuid4().hex}"


def commit(spark: SparkSession, root: str, version: Version) -> None:
    """Add a version: the switch. Raises :class:`ConflictError` if its number is taken."""
    target = _path(spark, f"{root}/versions/{version.number:012d}.json")
    staged = _path(spark, f"{root}/versions/_{uuid.uuid4().hex}")
    files = _files(spark, target)
    out = files.create(staged, True)
    out.write(json.dumps({"folders": version.folders, "notes": version.notes}).encode())
    out.close()
    jvm = spark._jvm
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    qualified = files.makeQualified(target)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        qualified.toUri(), spark._jsc.hadoopConfiguration()
    )
    try:
        context.rename(files.makeQualified(staged), qualified, none)
    except Py4JJavaError as error:
        files.delete(staged, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            raise ConflictError(str(qualified)) from error
        raise


def change(
    spark: SparkSession,
    root: str,
    build: Callable[[Version], Version | None],
    attempts: int = ATTEMPTS,
) -> Version:
    """Build the next version from the latest and switch to it; again if another writer was first.

    ``build`` writes the data of the new version and returns it, or None if nothing is to change.
    """
    for _ in range(attempts):
        base = latest(spark, root)
        built = build(base)
        if built is None:
            return base
        following = Version(base.number + 1, built.folders, built.notes)
        try:
            commit(spark, root, following)
        except ConflictError:
            continue
        return following
    raise ConflictError(f"{attempts} attempts to change {root}")


def read(spark: SparkSession, root: str, version: Version | None = None) -> DataFrame | None:
    """All rows of a version (the latest unless given); None of a table without data."""
    version = version or latest(spark, root)
    if not version.folders:
        return None
    paths = [f"{root}/{x}" for x in sorted(set(version.folders.values()))]
    reader = spark.read.option("mergeSchema", True).option("basePath", f"{root}/data")
    return reader.parquet(*paths).drop("version")


def replace(df: DataFrame, root: str) -> Version:
    """Write a table in place of the one that is there."""

    def build(_: Version) -> Version:
        folder = new_folder()
        df.write.parquet(f"{root}/{folder}")
        return Version(folders={"all": folder})

    return change(df.sparkSession, root, build)


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the newest ``keep`` versions and the data only they hold; returns how many
    folders went. Folders that no version names yet belong to writers at work and stay."""
    numbers = _numbers(spark, root)
    old, kept = numbers[: -max(1, keep)], numbers[-max(1, keep) :]
    used = {x for n in kept for x in _read(spark, root, n).folders.values()}
    gone = {x for n in old for x in _read(spark, root, n).folders.values()} - used
    for number in old:
        place = _path(spark, f"{root}/versions/{number:012d}.json")
        _files(spark, place).delete(place, False)
    for folder in sorted(gone):
        place = _path(spark, f"{root}/{folder}")
        _files(spark, place).delete(place, True)
    return len(gone)
