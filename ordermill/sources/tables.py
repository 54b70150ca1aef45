"""Table readers with explicit schemas."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ordermill import schema


def conform(df: DataFrame, target: T.StructType) -> DataFrame:
    """Give ``df`` exactly the target columns: absent ones are added as NULL."""
    present = set(df.columns)
    return df.select(
        *(
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.fields
        )
    )


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Scan one table at rest. Files written before a column existed yield NULLs."""
    return spark.read.schema(schema.struct(table)).parquet(path)


def read_tables(spark: SparkSession, base: str, names: Iterable[str] = schema.TABLES) -> dict[str, DataFrame]:
    return {name: read_table(spark, f"{base}/{name}", name) for name in names}


def literal_rows(spark: SparkSession, table: str, rows: Sequence[dict]) -> DataFrame:
    """Rows given in code. Only the columns named by some row are present, so that
    defaults can tell an omitted column from an explicit NULL."""
    named = {column for row in rows for column in row}
    fields = [f for f in schema.struct(table).fields if f.name in named]
    values = [tuple(row.get(f.name) for f in fields) for row in rows]
    return spark.createDataFrame(values, T.StructType(fields))


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    properties: dict[str, str],
    split_column: str,
    lower: object,
    upper: object,
    partitions: int,
) -> DataFrame:
    """Scan a table of a relational database in parallel slices of ``split_column``.

    The bounds only shape the slices; rows beyond them are read as well.
    """
    return spark.read.jdbc(
        url,
        table,
        column=split_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=partitions,
        properties=properties,
    )
