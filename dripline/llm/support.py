"""What the text operators share: shipping code, hold-outs, bounded samples, vectorised words.

Words are found in the UTF-8 bytes of whole Arrow columns with numpy, a few hundred documents at
a time, so that no Python object is made per word.
"""

from __future__ import annotations

import hashlib
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import Window

from dripline.session import new_work_path, remove_work_path, work_size

CHUNK_BYTES = 1 << 18

# Texts are long: a batch of Spark's usual 10,000 rows takes a worker hundreds of MB.
BATCH_ROWS = 1_000
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Prepare a session for Python workers on long texts.

    Arrow batches are cut to :data:`BATCH_ROWS` rows if the session allows more. The workers of a
    local session can import this package wherever it was started; on a cluster the package is
    given with ``--py-files`` or installed, as usual.
    """
    rows = int(spark.conf.get(_BATCH_ROWS))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(_BATCH_ROWS, str(BATCH_ROWS))
    context = spark.sparkContext
    master = context.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        return
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="dripline-code-")) / "dripline.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, str(source.relative_to(package.parent)))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def store(df: DataFrame, label: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it again.

    What has been written survives the loss of executors. Unlike a checkpoint it has a known size,
    so that small tables are joined without a shuffle, and few partitions if it is small.
    """
    spark = df.sparkSession
    path = new_work_path(spark, label)
    df.write.parquet(path)
    return stored_at(spark.read.schema(df.schema).parquet(path), path)


def store_parts(parts: Iterable[DataFrame], label: str) -> DataFrame:
    """Write several frames with equal columns into one table, one after the other.

    With :func:`shuffles_freed` the disk holds the shuffle files of one part at a time.
    """
    path = None
    for part in parts:
        spark, schema = part.sparkSession, part.schema
        path = path or new_work_path(spark, label)
        part.write.mode("append").parquet(path)
    return stored_at(spark.read.schema(schema).parquet(path), path)


# Below this a table is one partition when adaptive execution merges its partitions.
SMALL_BYTES = 1 << 20


def gathered(stored: DataFrame) -> DataFrame:
    """A stored table that one task reads if it is small.

    Joins and aggregates of such tables need no shuffle. Larger tables are left as they are.
    """
    path = folder_of(stored)
    if work_size(stored.sparkSession, path) > SMALL_BYTES:
        return stored
    return stored_at(stored.coalesce(1), path)


_STORED_AT = "_dripline_stored_at"


def stored_at(df: DataFrame, path: str | None) -> DataFrame:
    """The frame with a note of the folder that holds its rows, for :func:`discard`."""
    df.__dict__[_STORED_AT] = path
    return df


def folder_of(df: DataFrame) -> str | None:
    return df.__dict__.get(_STORED_AT)


def discard(*frames: DataFrame | None) -> None:
    """Remove stored tables that no frame still to be computed reads.

    What was made of them is stored itself, so no lost executor asks for them again. Frames that
    were not stored are left alone.
    """
    for frame in frames:
        path = None if frame is None else folder_of(frame)
        if path is not None:
            remove_work_path(frame.sparkSession, path)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Within this, Spark removes the shuffle files of each action when the action is over.

    For loops whose results are all stored: their old shuffles would fill the executors' disks.
    """
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)


def held_out(doc_id: Column, folds: int, remainder: int) -> Column:
    """True for the ids of one fold. A null id is in no fold."""
    return F.coalesce(fold(doc_id, folds) == F.lit(remainder), F.lit(False))


def smallest_by_hash(keys: DataFrame, group: str, key: str, size: int) -> DataFrame:
    """At most ``size`` distinct keys for each group: those whose hashes are smallest.

    A pseudo-random sample that is the same in every run. Spark cuts each task's rows to ``size``
    per group before the shuffle, so a hot group does not gather anywhere.
    """
    ranked = Window.partitionBy(group).orderBy(F.xxhash64(key), key)
    return (
        keys.where(F.col(group).isNotNull() & F.col(key).isNotNull())
        .dropDuplicates([group, key])
        .withColumn("__rank", F.row_number().over(ranked))
        .where(F.col("__rank") <= size)
        .drop("__rank")
    )


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, folds: int, remainder: int, per_class: int
) -> DataFrame:
    """(doc_id, text, label) of at most ``per_class`` documents of each label, none held out.

    Labels are 0 and 1; others are not learned. An id with several label rows has the largest of
    them. An id with several texts gives the first by content, so that repeated rows are learned
    once. At most ``2 * per_class`` ids are chosen, so they go to the documents by broadcast and
    only texts of the sample are shuffled.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(fold(F.col("doc_id"), folds) != remainder)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = smallest_by_hash(known, "label", "doc_id", per_class)
    return (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min("text").alias("text"))
    )


def collect_sorted(sample: DataFrame, by: str) -> pa.Table:
    """A bounded sample on the driver, sorted there: a sort in Spark would compute it twice."""
    found = sample.toArrow()
    return found.sort_by(by) if found.num_rows else found


# ------------------------------------------------------------------ Arrow columns


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """The texts of a column; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


@dataclass
class Texts:
    """Bytes of consecutive texts: text i is ``data[bounds[i]:bounds[i + 1]]``."""

    data: np.ndarray
    bounds: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.bounds) - 1


def text_chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Texts]:
    """The texts of a column in runs of about ``size`` bytes, whole texts only; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return
    _, offset_buffer, data_buffer = column.buffers()
    offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = (
        np.frombuffer(data_buffer, dtype=np.uint8)
        if data_buffer is not None
        else np.zeros(0, np.uint8)
    )
    start = 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1
        end = min(n, max(start + 1, end))
        low = offsets[start]
        yield Texts(data[low : offsets[end]], offsets[start : end + 1] - low, start)
        start = end


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to words, given those that do not."""
    inside = np.ones(256, dtype=bool)
    for low, high in ranges:
        inside[low : high + 1] = False
    return inside


# Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
NOT_SPACE = byte_class((0x20, 0x20), (0x09, 0x0D))
LETTER_OR_DIGIT = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def _constant(name: str) -> np.uint64:
    """An odd 64-bit number derived from a name."""
    return np.uint64(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little") | 1)


def _constants(name: str, n: int) -> np.ndarray:
    return np.array([_constant(f"{name} {i}") for i in range(n)], dtype=np.uint64)


_BYTE_VALUES = _constants("byte", 256)
_WORD_BASE = _constant("word base")
_GRAM_BASE = _constant("gram base")
_LENGTH = _constant("length")
_MIX_1, _MIX_2 = _constant("mix one"), _constant("mix two")
_powers = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept and extended as longer words come."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        factors = np.full(max(n, 64), base, dtype=np.uint64)
        factors[0] = 1
        known = _powers[int(base)] = np.cumprod(factors, dtype=np.uint64)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit values over the whole value."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX_1
    x = x ^ (x >> np.uint64(29))
    x = x * _MIX_2
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """Hashes of the words of consecutive texts: those of text i are at bounds[i]:bounds[i + 1]."""

    hashes: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def _runs(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True; a run does not go on into the next text."""
    n = len(inside)
    starts_here = inside.copy()
    starts_here[1:] &= ~inside[:-1]
    edges = bounds[1:-1]
    edges = edges[(edges > 0) & (edges < n)]
    starts_here[edges] = inside[edges]
    ends_here = inside.copy()
    ends_here[:-1] &= ~inside[1:]
    ends_here[edges - 1] = inside[edges - 1]
    return np.flatnonzero(starts_here), np.flatnonzero(ends_here) + 1


def word_hashes(texts: Texts, inside: np.ndarray) -> Words:
    """64-bit hashes of all words, A-Z lower-cased."""
    lowered = LOWER[texts.data]
    mask = inside[lowered]
    starts, ends = _runs(mask, texts.bounds)
    bounds = np.searchsorted(starts, texts.bounds).astype(np.int64)
    if len(starts) == 0:
        return Words(np.zeros(0, np.uint64), bounds)
    lengths = ends - starts
    firsts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(firsts, lengths)
    values = _BYTE_VALUES[lowered[mask]] * powers(_WORD_BASE, int(lengths.max()))[place]
    sums = np.add.reduceat(values, firsts)
    return Words(mix(sums + lengths.astype(np.uint64) * _LENGTH), bounds)


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words; runs over text edges are for the caller."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, dtype=np.uint64)
    for i, factor in enumerate(powers(_GRAM_BASE, k)):
        total += hashes[i : i + n] * factor
    return mix(total)


def sequence_hash(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of words, different from that of any longer one."""
    terms = hashes * powers(_GRAM_BASE, len(hashes))
    length = np.array([len(hashes)], dtype=np.uint64) * _LENGTH
    return mix(terms.sum(dtype=np.uint64, keepdims=True) + length)[0]


class HashSet:
    """A fixed set of 64-bit hashes. A table of bits turns most absent values away at once."""

    def __init__(self, values: np.ndarray):
        self.values = np.unique(values)
        self.bits = max(12, min(24, int(len(self.values)).bit_length() + 5))
        self.table = np.zeros(1 << self.bits, dtype=bool)
        self.table[self._slot(self.values)] = True

    def _slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(64 - self.bits)).astype(np.int64)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """For each hash, whether it is in the set."""
        found = self.table[self._slot(hashes)]
        maybe = np.flatnonzero(found)
        if len(maybe):
            at = np.searchsorted(self.values, hashes[maybe])
            at[at == len(self.values)] = 0
            found[maybe] = self.values[at] == hashes[maybe]
        return found
