"""Snapshots of all tables with checksums, retention and restore, and tables that only grow.

Spark writes are atomic per folder, not over several tables. A snapshot
counts only once its rows in the manifest are there, and these are written last.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ordermill import schema
from ordermill.functions.expressions import at, micros
from ordermill.operators import checks
from ordermill.operators.changes import first_per_key
from ordermill.session import remove_folder

# Snapshots older than this many whole days go; how their names are dated.
RETENTION_DAYS = 7
NAME_FORMAT = "%Y%m%d_%H%M%S"

MANIFEST = "snapshot string, table_name string, rows long, checksum long, columns string, taken_at timestamp_ntz"

VERSION = "_version"


class DamagedSnapshot(ValueError):
    """Raised where stored tables differ from what was recorded about them."""


def _as_text(field: T.StructField) -> Column:
    """A value as text that tells equal from different values; NULL differs from all."""
    value = F.col(field.name)
    if isinstance(field.dataType, T.BinaryType):
        value = F.hex(value)
    elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        value = F.to_json(value)
    return F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("-"))


def content_sum(columns: Sequence[T.StructField]) -> Column:
    """An aggregate that is the same for the same rows in any order, and differs if any value does.

    Each row counts as a number of 60 bits, the first 15 digits of the md5 of its values with their lengths; the
    numbers are added up modulo 2^60. So it combines before any shuffle, and repeated rows count
    as often as they occur.
    """
    texts = [_as_text(field) for field in columns]
    row = F.concat(*(F.concat(F.char_length(t).cast("string"), t) for t in texts)) if texts else F.lit("")
    number = F.conv(F.substring(F.md5(row.cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.coalesce(F.sum(number), F.lit(0).cast("decimal(38,0)")) % F.lit(1 << 60).cast("decimal(38,0)")


def content_sums(df: DataFrame, column_sets: Sequence[Sequence[str]]) -> DataFrame:
    """One row per set of columns (columns, rows, checksum), from one scan.

    Sets of single columns show where two tables differ.
    """
    fields = {field.name: field for field in df.schema.fields}
    sums = [content_sum([fields[c] for c in names]).cast("bigint").alias(f"_sum{i}") for i, names in enumerate(column_sets)]
    found = df.agg(F.count(F.lit(1)).alias("rows"), *sums)
    listed = F.array(
        *(F.struct(F.lit(", ".join(names)).alias("columns"), F.col(f"_sum{i}").alias("checksum")) for i, names in enumerate(column_sets))
    )
    return found.select("rows", F.explode(listed).alias("s")).select("s.columns", "rows", "s.checksum")


def _contents(df: DataFrame) -> list[Column]:
    return [F.count(F.lit(1)).alias("rows"), content_sum(df.schema.fields).cast("bigint").alias("checksum")]


def write_checked(df: DataFrame, path: str) -> tuple[int, int]:
    """Write gzip Parquet, with row count and checksum from the same pass, and compare the files with them."""
    seen = Observation()
    df.observe(seen, *_contents(df)).write.option("compression", "gzip").parquet(path)
    given = seen.get["rows"], seen.get["checksum"]
    _compare(df.sparkSession.read.schema(df.schema).parquet(path), given, path)
    return given


def _compare(df: DataFrame, recorded: tuple[int, int], what: str) -> None:
    found = df.agg(*_contents(df)).first()
    if found.rows != recorded[0]:
        raise DamagedSnapshot(f"{what}: recorded {recorded[0]} rows, found {found.rows}")
    if found.checksum != recorded[1]:
        raise DamagedSnapshot(f"{what}: the checksum is {found.checksum}, recorded was {recorded[1]}")


def take_snapshot(
    spark: SparkSession, tables: Mapping[str, DataFrame], base: str, database: str, now: datetime
) -> str:
    """Write every table below ``base/<database>_<time>`` and record it; gives the name."""
    name = f"{database}_{now.strftime(NAME_FORMAT)}"
    recorded = [
        (name, table, *write_checked(df, f"{base}/{name}/{table}"), df.schema.json(), now)
        for table, df in tables.items()
    ]
    spark.createDataFrame(recorded, MANIFEST).coalesce(1).write.mode("append").partitionBy("snapshot").parquet(f"{base}/manifest")
    return name


def manifest(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def age_in_days(taken_at: Column, now: datetime) -> Column:
    """Whole days, rounded down: 7 days and 23 hours are 7."""
    return F.floor((micros(at(now)) - micros(taken_at)) / F.lit(86_400_000_000))


def retention(recorded: DataFrame, now: datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Every snapshot with its age and whether its time is up."""
    taken = recorded.groupBy("snapshot").agg(F.min("taken_at").alias("taken_at"))
    aged = taken.withColumn("age_days", age_in_days(F.col("taken_at"), now))
    return aged.withColumn("expired", F.col("age_days") > days)


def drop_expired(spark: SparkSession, base: str, good: str, now: datetime, days: int = RETENTION_DAYS) -> list[str]:
    """Remove expired snapshots and their records, once snapshot ``good`` is in place."""
    known = manifest(spark, base)
    if known.where(F.col("snapshot") == good).isEmpty():
        raise DamagedSnapshot(f"snapshot {good} is not recorded; nothing was removed")
    # A list of snapshot names, one per backup run.
    names = [row.snapshot for row in retention(known, now, days).where("expired").collect()]
    removed = [name for name in names if name != good]
    for name in removed:
        remove_folder(spark, f"{base}/{name}")
        remove_folder(spark, f"{base}/manifest/snapshot={name}")
    return removed


def read_snapshot(spark: SparkSession, base: str, name: str) -> dict[str, DataFrame]:
    """The tables of a snapshot, with the types they had when it was taken.

    Raises unless every table holds the very rows that were recorded.
    """
    # One row per table.
    recorded = manifest(spark, base).where(F.col("snapshot") == name).collect()
    if not recorded:
        raise DamagedSnapshot(f"snapshot {name} is not recorded")
    tables = {}
    for row in recorded:
        df = spark.read.schema(T.StructType.fromJson(json.loads(row.columns))).parquet(f"{base}/{name}/{row.table_name}")
        _compare(df, (row.rows, row.checksum), f"{name}/{row.table_name}")
        tables[row.table_name] = df
    return tables


def restore(spark: SparkSession, base: str, name: str, target: str) -> dict[str, DataFrame]:
    """Write the tables of a snapshot below ``target``, each in the place of what was there.

    Contents are checked against the record; if the declared tables are complete, their rules are checked
    as well. Nothing is written unless all is well. What was written is compared with the record again.
    """
    tables = read_snapshot(spark, base, name)
    if set(schema.TABLES) <= set(tables):
        checks.require(checks.check_all(tables))
    sums = {r.table_name: (r.rows, r.checksum) for r in manifest(spark, base).where(F.col("snapshot") == name).collect()}
    restored = {}
    for table, df in tables.items():
        df.write.mode("overwrite").parquet(f"{target}/{table}")
        restored[table] = spark.read.schema(df.schema).parquet(f"{target}/{table}")
        _compare(restored[table], sums[table], f"{target}/{table}")
    return restored


def append_rows(df: DataFrame, path: str, version: int) -> None:
    """Add rows to a table that only grows: new rows, and later states of rows that are there.

    A call that is repeated with its version changes nothing for readers.
    """
    df.withColumn(VERSION, F.lit(version)).write.mode("append").parquet(path)


def newest_rows(spark: SparkSession, path: str, columns: T.StructType, keys: Sequence[str], as_of: int | None = None) -> DataFrame:
    """The last state of every key, up to version ``as_of`` if given; one shuffle, one row per key and task."""
    stored = spark.read.schema(T.StructType([*columns.fields, T.StructField(VERSION, T.IntegerType())])).parquet(path)
    if as_of is not None:
        stored = stored.where(F.col(VERSION) <= as_of)
    latest_first = stored.withColumn("_age", -F.col(VERSION))
    return first_per_key(latest_first, keys, ["_age"]).select(*columns.names)
