"""Streaming forms of log ingest, admission, insert-if-absent and running reports.

What has to be remembered between micro-batches lies in Spark's own state, and what has been
written is known from the file sink's own log; both belong to the checkpoint folder. A batch
that is run again after a failure so changes nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ordermill.operators.admission import Limit
from ordermill.plans import snapshots
from ordermill.plans.reports import failed_logins, failure_bursts
from ordermill.sources.access_logs import parse_proxy_lines
from ordermill.streaming.processors import Admission, FirstOfKey

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# A job of a scheduler takes what is there and stops; ``{"processingTime": "1 minute"}``
# keeps it running.
AVAILABLE_NOW = {"availableNow": True}
Trigger = Mapping[str, object]


def keyed_state(spark: SparkSession) -> None:
    """Processors with keyed state need the state store that lies on disk."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def _start(writer: DataStreamWriter, checkpoint: str, trigger: Trigger) -> StreamingQuery:
    return writer.option("checkpointLocation", checkpoint).trigger(**trigger).start()


def log_stream(spark: SparkSession, path: str, delay: str, files_per_batch: int = 1000) -> DataFrame:
    """Proxy log lines as they arrive, parsed, with a watermark on the request time."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path)
    return parse_proxy_lines(lines).withWatermark("time_local", delay)


def ingest_log(parsed: DataFrame, folder: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW) -> StreamingQuery:
    """Append parsed lines; those that were not understood go to a partition of their own."""
    return _start(parsed.writeStream.partitionBy("understood").option("path", folder), checkpoint, trigger)


def append_rows(stream: DataFrame, folder: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW) -> StreamingQuery:
    return _start(stream.writeStream.option("path", folder), checkpoint, trigger)


def store_changes(aggregate: DataFrame, folder: str, checkpoint: str, trigger: Trigger = AVAILABLE_NOW) -> StreamingQuery:
    """Append, after each micro-batch, the groups of a running aggregate that changed, under the batch's number."""

    def step(changed: DataFrame, batch_id: int) -> None:
        snapshots.append_rows(changed, folder, batch_id)

    return _start(aggregate.writeStream.outputMode("update").foreachBatch(step), checkpoint, trigger)


def current_groups(spark: SparkSession, folder: str, keys: Sequence[str], columns: T.StructType) -> DataFrame:
    """The last stored state of every group."""
    return snapshots.newest_rows(spark, folder, columns, keys)


def failed_login_stream(attempts: DataFrame, user: str, time: str, failed: str, width: str, delay: str) -> DataFrame:
    """Closed time windows only. Watermarks need a zoned time, so the column is cast."""
    timed = attempts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return failed_logins(timed, user, time, failed, width)


def failure_burst_stream(attempts: DataFrame, user: str, time: str, failed: str, gap: str, least: int, delay: str) -> DataFrame:
    """Bursts of failures that are over; one that goes on over micro-batches stays in Spark's state."""
    timed = attempts.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    return failure_bursts(timed, user, time, failed, gap, least)


def admission_stream(stream: DataFrame, client: str, time: str, id: str, limit: Limit, delay: str = "0 seconds") -> DataFrame:
    """``client, id, admitted`` of each request, equal to the batch decisions.

    A request waits in its client's state until the newest time seen, less ``delay``, has reached it; a
    timer in event time then decides all that is due, in order. A request that comes after a later one of
    its client was decided gets NULL: it has no place in the order any more. A drained level is
    removed by a timer as well, so state is kept for clients with recent requests only; a request that is
    later than that counts as the client's first. Requests without a client are not limited, those without a time get NULL.
    """
    keyed_state(stream.sparkSession)
    zoned = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    # The time goes on as a number: late requests then are rows like others and not dropped.
    requests = zoned.select(F.col(client).alias("client"), F.unix_micros("_at").alias("time"), F.col(id).alias("id"))
    counted = F.col("client").isNotNull() & F.col("time").isNotNull()
    types = {name: stream.schema[column].dataType.simpleString() for name, column in (("client", client), ("id", id))}
    # Rows, not pandas: a frame per client costs far more than its few requests.
    answers = requests.where(counted).groupBy("client").transformWithState(
        Admission(limit, types["id"]), f"client {types['client']}, ids array<{types['id']}>, admitted array<boolean>", "Append", "EventTime"
    )
    decided = answers.select("client", F.inline(F.arrays_zip(F.col("ids").alias("id"), "admitted")))
    others = requests.where(~counted).select("client", "id", F.when(F.col("client").isNull(), F.lit(True)).alias("admitted"))
    return decided.unionByName(others).select(F.col("client").alias(client), F.col("id").alias(id), "admitted")


def first_rows(
    stream: DataFrame, keys: Sequence[str], order: Sequence[str], held: DataFrame | None = None, keep_hours: float | None = None
) -> DataFrame:
    """The rows that an insert-if-absent adds: of each new key the first row of the first micro-batch that has one.

    ``held`` are the rows that are there already; their keys count as seen from the start. Keys are remembered for
    ``keep_hours`` after their row, or for ever. Rows with a NULL key clash with nothing and all go through.
    """
    keyed_state(stream.sparkSession)
    whole = F.lit(True)
    for key in keys:
        whole = whole & F.col(key).isNotNull()
    initial = None if held is None else held.where(whole).select(*keys).groupBy(*keys)
    mode = "None" if keep_hours is None else "ProcessingTime"
    added = stream.where(whole).groupBy(*keys).transformWithStateInPandas(
        FirstOfKey(tuple(order), keep_hours), stream.schema, "Append", mode, initial
    )
    return added.unionByName(stream.where(~whole))


def distinct_rows(stream: DataFrame, keys: Sequence[str], time: str, delay: str) -> DataFrame:
    """Rows of a source that may deliver a row more than once: one row per key within ``delay``.

    A row is forgotten once the newest time seen is more than ``delay`` after it; rows that are older than that
    when they come are dropped. Of rows with one key in one micro-batch Spark keeps any, so
    repeated rows are taken to be equal.
    """
    timed = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    return timed.dropDuplicatesWithinWatermark(list(keys)).drop("_at")
