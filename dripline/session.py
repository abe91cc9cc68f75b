"""Session settings the engine expects, and the shared work folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# UTC because report timestamps carry no zone; adaptive execution because partition counts,
# join strategy and skew splits should follow measured sizes, not guesses.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    # Parquet on disk is several times smaller than its rows in memory. Broadcast decisions
    # should rest on the latter.
    "spark.sql.sources.fileCompressionFactor": "4.0",
    # Join by hash instead of sorting when every build partition is measured to be small.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
}

CHECKPOINT_DIR_KEY = "spark.checkpoint.dir"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Apply :data:`SESSION_CONF` to a session builder."""
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    return builder


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local-mode session without the setting falls back to a temporary folder; on a
    cluster, also one of executors on this machine, a missing setting is an error, because the
    driver's temporary folder is not the executors'.
    """
    configured = spark.conf.get(CHECKPOINT_DIR_KEY, None)
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set {CHECKPOINT_DIR_KEY} to a folder shared by all executors")
    fallback = tempfile.mkdtemp(prefix="dripline-")
    spark.conf.set(CHECKPOINT_DIR_KEY, fallback)
    return fallback


def new_work_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/dripline/{label}-{uuid.uuid4().hex}"


def remove_work_path(spark: SparkSession, path: str) -> None:
    """Remove a folder below the shared one that :func:`new_work_path` named, if it is there."""
    if not path.startswith(f"{shared_dir(spark).rstrip('/')}/dripline/"):
        raise ValueError(f"not a work folder: {path}")
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def work_size(spark: SparkSession, path: str) -> int:
    """Bytes of the files in a work folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength()


def materialize(df: DataFrame) -> DataFrame:
    """Write an aggregate once to the shared folder, so several results can read it.

    Reliable checkpoint: it survives executor loss and, unlike a cache, holds no memory.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()
