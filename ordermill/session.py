"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Cores, memory and spark.sql.shuffle.partitions are left to the cluster.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs another shuffle afterwards.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # A JSON object with a repeated key keeps the last value.
    "spark.sql.variant.allowDuplicateKeys": "true",
    # State of running streams lies on disk, not in the executors' heap.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Stored lineage cuts go when nothing refers to them any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(name: str = "ordermill", **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors can reach, from ``spark.checkpoint.dir``.

    A temporary folder stands in only in local mode, where there is one machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="ordermill-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_scratch: list[str] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the shared one; nothing else writes to it.

    Results may be read from it as long as the program runs; then it goes.
    """
    if not _scratch:
        atexit.register(remove_scratch, spark)
    path = f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def remove_scratch(spark: SparkSession) -> None:
    """Remove this program's scratch folders. A session that has been stopped leaves them."""
    if spark.sparkContext._jsc is None:
        return
    for path in _scratch:
        remove_folder(spark, path)
    _scratch.clear()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Store ``df`` in the shared folder, so that lost executors cannot change it.

    Needed where two jobs must see the very same partitions: range boundaries come
    from a sample, and a recomputed exchange may draw another one. A reliable
    checkpoint keeps partition numbers and the order within partitions.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lies, if it is there."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
