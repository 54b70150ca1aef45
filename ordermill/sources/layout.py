"""How tables lie on disk, so that the usual look-ups read little.

A file layout takes the place of indexes: a day folder for times, order within files
for columns of few values, and Bloom filters for single keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession, functions as F, types as T

from ordermill import schema
from ordermill.functions.expressions import as_variant

DAY = "day"


class Layout(NamedTuple):
    """``day_of`` is the time column whose date names the folder; rows are ordered by
    ``clustered`` within files; single values of ``looked_up`` are found by filter."""

    day_of: str | None = None
    clustered: tuple[str, ...] = ()
    looked_up: tuple[str, ...] = ()


# The columns by which the tables are looked up. No status is used as a
# folder: it changes, and its rows would have to move.
LAYOUTS: dict[str, Layout] = {
    "customers": Layout(looked_up=("phone_number", "email")),
    "addresses": Layout(clustered=("customer_id",)),
    "menu_items": Layout(clustered=("restaurant_id", "category")),
    "users": Layout(clustered=("role",), looked_up=("username", "email")),
    "orders": Layout("created_at", ("restaurant_id", "order_status"), ("customer_id",)),
    "order_items": Layout("created_at", ("order_id",), ("item_id",)),
    "login_attempts": Layout("attempted_at", ("user_id",)),
    "user_sessions": Layout("expires_at", ("user_id",)),
}


def _writer(df: DataFrame, table: str) -> DataFrameWriter:
    """Rows are spread by day and key first, so that one day is neither one task nor one
    file per task; Spark splits or merges what comes out too large or too small."""
    layout, key = LAYOUTS.get(table, Layout()), schema.TABLES[table].key
    ordered = [*layout.clustered, key]
    if layout.day_of:
        df = df.withColumn(DAY, F.to_date(layout.day_of)).repartitionByRange(DAY, *ordered)
        writer = df.sortWithinPartitions(DAY, *ordered).write.partitionBy(DAY)
    else:
        writer = df.repartitionByRange(*ordered).sortWithinPartitions(*ordered).write
    for column in (key, *layout.looked_up):
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    return writer


def write_laid_out(df: DataFrame, table: str, path: str) -> None:
    """Write a declared table in its layout."""
    _writer(df, table).parquet(path)


def overwrite_days(df: DataFrame, table: str, path: str) -> None:
    """Replace the day folders that ``df`` has rows for; all others stay as they are."""
    if not LAYOUTS.get(table, Layout()).day_of:
        raise ValueError(f"{table} has no day folders")
    _writer(df, table).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def day_folder(path: str, day: date | None) -> str:
    return f"{path}/{DAY}={'__HIVE_DEFAULT_PARTITION__' if day is None else day.isoformat()}"


def read_laid_out(spark: SparkSession, table: str, path: str) -> DataFrame:
    """The table, with its day as one more column if it has one.

    Filters on that column choose folders; unknown times lie in a folder of their own.
    """
    columns = schema.struct(table)
    if LAYOUTS.get(table, Layout()).day_of:
        columns = T.StructType([*columns.fields, T.StructField(DAY, T.DateType())])
    return spark.read.schema(columns).parquet(path)


def store_variants(df: DataFrame, column: str, rows: str, rejects: str) -> None:
    """Write a table whose JSON texts become VARIANT, and the rows with broken texts as they are.

    The text is parsed once, when it is stored; readers take fields by path. The last of repeated keys counts. A NULL is no
    broken text.
    """
    df.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    parsed = df.withColumn("_parsed", as_variant(F.col(column)))
    broken = F.col(column).isNotNull() & F.col("_parsed").isNull()
    names = [F.col("_parsed").alias(c) if c == column else F.col(c) for c in df.columns]
    parsed.where(~broken).select(*names).write.parquet(rows)
    parsed.where(broken).select(*df.columns).write.parquet(rejects)


def write_buckets(df: DataFrame, name: str, path: str, keys: Sequence[str], buckets: int) -> None:
    """Write a table in buckets of its keys, or append to it; one file per bucket and call.

    The catalog knows the buckets, so a join on the keys takes the table as it lies.
    """
    writer = df.repartition(buckets, *keys).write.mode("append").bucketBy(buckets, *keys).sortBy(*keys)
    writer.option("path", path).saveAsTable(name)
