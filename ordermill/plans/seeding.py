"""Guarded first rows: what an application start or a set-up run puts in."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ordermill import schema
from ordermill.functions.expressions import unless
from ordermill.operators import changes
from ordermill.plans.views import fewer_than


class IfAbsent(NamedTuple):
    """Insert the rows whose ``key`` is not there yet; of several rows with one key,
    the first by ``order`` counts (by all columns if none is given)."""

    rows: DataFrame
    key: str
    order: tuple[str, ...] = ()


class IfEmpty(NamedTuple):
    """Insert all rows if the table has none."""

    rows: DataFrame


class IfFewer(NamedTuple):
    """Insert all rows if the table has fewer than ``minimum``; present keys clash."""

    rows: DataFrame
    minimum: int


def with_workplace(users: DataFrame, restaurant: str) -> DataFrame:
    """Everybody but plain users belongs to a restaurant."""
    return users.withColumn("restaurant_id", unless(F.col("role"), "user", restaurant))


def rows_to_insert(target: DataFrame, guard: IfAbsent | IfEmpty | IfFewer) -> DataFrame | None:
    """The rows that the guard lets in; None if it keeps all of them out."""
    if isinstance(guard, IfAbsent):
        return changes.absent_rows(target, guard.rows, [guard.key], guard.order or guard.rows.columns)
    wanted = target.isEmpty() if isinstance(guard, IfEmpty) else fewer_than(target, guard.minimum)
    return guard.rows if wanted else None


def seed(
    tables: Mapping[str, DataFrame], guards: Mapping[str, IfAbsent | IfEmpty | IfFewer], now: datetime
) -> dict[str, DataFrame]:
    """The tables with their first rows, in the order of ``guards``.

    Every inserted row passes the same checks as any other insert.
    """
    result = dict(tables)
    for table, guard in guards.items():
        new = rows_to_insert(result[table], guard)
        if new is None:
            continue
        result[table] = changes.insert_rows(result, table, new, now, key_order=[numbering_column(table, new)])
    return result


def start_up(
    tables: Mapping[str, DataFrame], guards: Mapping[str, IfAbsent | IfEmpty | IfFewer], now: datetime
) -> dict[str, DataFrame]:
    """What each start of the application does to the tables: seed, then purge sessions.

    Ask ``purge_counts`` for the number of sessions that went.
    """
    result = seed(tables, guards, now)
    result["user_sessions"] = changes.purge_expired(result["user_sessions"], "expires_at", now)
    return result


def numbering_column(table: str, rows: DataFrame) -> str:
    """A column that is present and unique, to number new rows by."""
    spec = schema.TABLES[table]
    return next(c for c in (spec.key, *reversed(spec.unique), *spec.required) if c in rows.columns)
