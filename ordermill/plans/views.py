"""The stored view and the small lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ordermill import schema
from ordermill.functions.expressions import not_listed

# Fixed value: the statuses that end an order.
CLOSED_STATUSES = ("delivered", "cancelled")


def join_columns(
    facts: DataFrame, dimension: DataFrame, fact_key: str, key: str, columns: Mapping[str, str]
) -> DataFrame:
    """Inner join that adds columns of a dimension, under new names, to every fact row.

    Rows without a key drop before the shuffle. No broadcast hint: Spark broadcasts
    the dimension only below its own size threshold and otherwise sort-merge joins,
    where adaptive execution splits a key that holds a large share of the facts.
    """
    named = dimension.select(
        F.col(key).alias("_dimension_key"), *(F.col(c).alias(alias) for c, alias in columns.items())
    )
    return (
        facts.where(F.col(fact_key).isNotNull())
        .join(named, F.col(fact_key) == F.col("_dimension_key"), "inner")
        .drop("_dimension_key")
    )


def active_orders_unsorted(orders: DataFrame, customers: DataFrame, restaurants: DataFrame) -> DataFrame:
    """Open orders with both names. Callers that aggregate should use this one."""
    pinned = orders.select(*(f.name for f in schema.struct("orders").fields))
    opened = pinned.where(not_listed(F.col("order_status"), CLOSED_STATUSES))
    named = join_columns(opened, customers, "customer_id", "customer_id", {"name": "customer_name"})
    return join_columns(named, restaurants, "restaurant_id", "restaurant_id", {"name": "restaurant_name"})


def newest_first(df: DataFrame, created: str, tie_break: str) -> DataFrame:
    """Latest first with unknown times on top.

    The second sort column lets the range exchange spread rows of one time, or all
    the rows without one, over several partitions.
    """
    return df.orderBy(F.col(created).desc_nulls_first(), F.col(tie_break))


def active_orders(tables: Mapping[str, DataFrame]) -> DataFrame:
    view = active_orders_unsorted(tables["orders"], tables["customers"], tables["restaurants"])
    return newest_first(view, "created_at", "order_id")


def lookup(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def found(df: DataFrame, predicate: Column) -> DataFrame:
    """One row holding 1 if any row matches, else no row; stops at the first match."""
    return df.where(predicate).select(F.lit(1).alias("found")).limit(1)


def first_row(df: DataFrame) -> DataFrame:
    return df.limit(1)


def fewer_than(df: DataFrame, minimum: int) -> bool:
    """Whether ``df`` has fewer than ``minimum`` rows; reads no more than it must."""
    return df.limit(minimum).count() < minimum
