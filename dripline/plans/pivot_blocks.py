"""Journey x channel tables of any width, stored in blocks of channels.

Channels are numbered in their order; a block is a run of ``width`` of them. Every row of the stored
table is one journey in one block and holds an array per metric with a cell for each channel of the
block, so no number of channels makes a plan or a schema wide, and names that differ only by case do
not meet as columns. All blocks come from one shuffle by (journey, block): a hot journey or channel
is spread over its blocks or journeys. A journey without rows in a block has no row there; reading
gives it zeros. The table changes by one switch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dripline.config import MetricConfig
from dripline.operators.aggregates import journey_channel_totals
from dripline.operators.reshape import PIVOT_METRICS
from dripline.session import materialize
from dripline.sources import versions
from dripline.sources.versions import Version

# Channels of a block: its columns when it is read as a wide table.
BLOCK_CHANNELS = 100

_CELLS = ", ".join(
    ["journey_name string", "block int", *(f"{metric} array<double>" for metric in PIVOT_METRICS)]
)


def numbered_channels(totals: DataFrame, width: int) -> DataFrame:
    """(channel, block, slot) of every channel, in the order of the names.

    Names are sorted by ranges; the ranges' sizes, one row each, give every range its first number.
    """
    names = materialize(totals.where(F.col("channel").isNotNull()).select("channel").distinct())
    ranged = names.repartitionByRange("channel").sortWithinPartitions("channel")
    # The upper bits of the number tell the range, the lower 33 the place in it.
    placed = materialize(ranged.withColumn("place", F.monotonically_increasing_id()))
    own = placed.select(
        "channel",
        F.shiftright("place", 33).alias("range"),
        F.col("place").bitwiseAND((1 << 33) - 1).alias("place"),
    )
    sizes = own.groupBy("range").agg(F.count(F.lit(1)).alias("n"))
    # One row for each range of names.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.col("start") + F.col("place")
    return own.join(starts, "range").select(
        "channel",
        F.floor(number / width).cast("int").alias("block"),
        (number % width).cast("int").alias("slot"),
    )


def _cell(metric: str) -> Callable[[Column], Column]:
    return lambda cells: F.coalesce(cells[metric], F.lit(0.0))


def write_pivot_blocks(
    df: DataFrame, config: MetricConfig, root: str, width: int = BLOCK_CHANNELS
) -> Version:
    """Store the matrices of all six metrics below ``root``, from report rows."""
    if width < 1:
        raise ValueError("a block needs at least one channel")
    spark = df.sparkSession
    totals = materialize(
        journey_channel_totals(df, config).select("journey_name", "channel", *PIVOT_METRICS)
    )
    channels = materialize(numbered_channels(totals, width))
    entry = F.struct("slot", F.struct(*PIVOT_METRICS).alias("cells"))
    found = F.map_from_entries(F.collect_list(entry))
    dense = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.col("found")[i])
    cells = (
        totals.join(channels, "channel")
        .groupBy("journey_name", "block")
        # At most one entry for each channel of the block.
        .agg(found.alias("found"))
        .withColumn("dense", dense)
        .select(
            "journey_name",
            "block",
            *[F.transform("dense", _cell(metric)).alias(metric) for metric in PIVOT_METRICS],
        )
    )
    sums = totals.groupBy("journey_name").agg(
        *[F.sum(metric).cast("double").alias(metric) for metric in PIVOT_METRICS]
    )

    def build(_: Version) -> Version:
        folders = {name: versions.new_folder() for name in ("cells", "sums", "channels")}
        balanced = cells.hint("rebalance", F.col("block"))
        balanced.write.partitionBy("block").parquet(f"{root}/{folders['cells']}")
        sums.write.parquet(f"{root}/{folders['sums']}")
        channels.write.parquet(f"{root}/{folders['channels']}")
        return Version(0, folders, {"width": width})

    return versions.change(spark, root, build)


def _part(spark: SparkSession, root: str, version: Version, name: str) -> DataFrame:
    if name not in version.folders:
        raise FileNotFoundError(f"no pivot was written to {root}")
    # A table without cells has folders without files, so the schema is given.
    reader = spark.read.schema(_CELLS) if name == "cells" else spark.read
    return reader.parquet(f"{root}/{version.folders[name]}")


def block_count(spark: SparkSession, root: str) -> int:
    channels = _part(spark, root, versions.latest(spark, root), "channels")
    return (channels.agg(F.max("block")).first()[0] or 0) + 1 if not channels.isEmpty() else 0


def pivot_block(
    spark: SparkSession, root: str, metric: str, block: int, total: str = "Total"
) -> DataFrame:
    """One block of one metric as a wide table: every journey, a column for each channel of the
    block, and the row sum over all channels of all blocks."""
    if metric not in PIVOT_METRICS:
        raise ValueError(f"unknown metric: {metric}")
    version = versions.latest(spark, root)
    # At most ``width`` names.
    named = _part(spark, root, version, "channels").where(F.col("block") == block).collect()
    names = [row["channel"] for row in sorted(named, key=lambda row: row["slot"])]
    own = (
        _part(spark, root, version, "cells")
        .where(F.col("block") == block)
        .select(F.col("journey_name").alias("own_journey"), F.col(metric).alias("cells"))
    )
    sums = _part(spark, root, version, "sums").select("journey_name", F.col(metric).alias("sums"))
    joined = sums.join(own, F.col("journey_name").eqNullSafe(F.col("own_journey")), "left")
    cells = [
        F.coalesce(F.col("cells")[i], F.lit(0.0)).alias(name) for i, name in enumerate(names)
    ]
    return joined.select("journey_name", *cells, F.col("sums").alias(total))


def pivot_cells(spark: SparkSession, root: str) -> DataFrame:
    """(journey_name, channel, block, metrics) of every cell of the rows that are stored."""
    version = versions.latest(spark, root)
    channels = _part(spark, root, version, "channels")
    zipped = F.arrays_zip(*PIVOT_METRICS)
    return (
        _part(spark, root, version, "cells")
        .select("journey_name", "block", F.posexplode(zipped).alias("slot", "cell"))
        .join(channels, ["block", "slot"])
        .select("journey_name", "channel", "block", *[F.col(f"cell.{m}") for m in PIVOT_METRICS])
    )
