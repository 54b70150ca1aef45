"""Changes of large tables in day folders that rewrite the days they touch, and no others.

The days come first, from a scan of two columns; then only their folders are read, changed and
replaced by dynamic partition overwrite. A few changed rows of a table of many terabytes so cost
a few folders. The list of days is bounded by the calendar, so the driver may hold it.

The new rows are stored in the shared folder before any folder is replaced: replacing several
folders is not one step, and after a failure the same call can be made again or the stored
rows written once more. There is one writer per table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ordermill import schema
from ordermill.functions.expressions import at
from ordermill.operators import changes, checks
from ordermill.session import remove_folder, scratch_dir
from ordermill.sources.layout import DAY, LAYOUTS, day_folder, overwrite_days, read_laid_out

Days = list[date | None]


def days_of(rows: DataFrame) -> Days:
    """The different days of some rows, one value per folder; None for unknown times."""
    found = [row[0] for row in rows.select(DAY).distinct().collect()]
    return sorted(found, key=lambda day: (day is not None, day))


def in_days(days: Days) -> Column:
    """A filter that chooses folders."""
    known = [day for day in days if day is not None]
    chosen = F.col(DAY).isin(known) if known else F.lit(False)
    return chosen | F.col(DAY).isNull() if None in days else chosen


def rewrite_days(spark: SparkSession, table: str, path: str, days: Days, change: Callable[[DataFrame], DataFrame]) -> Days:
    """Replace all rows of ``days`` by what ``change`` makes of them; gives the days that were rewritten.

    ``days`` must hold the days that rows are moved to, as these folders are replaced as well. A
    day without rows afterwards loses its folder.
    """
    if not days:
        return []
    rows = read_laid_out(spark, table, path).where(in_days(days))
    changed = change(rows.drop(DAY))
    staged = scratch_dir(spark, f"staged-{table}")
    changed.withColumn(DAY, F.to_date(LAYOUTS[table].day_of)).write.partitionBy(DAY).parquet(staged)
    new = read_laid_out(spark, table, staged)
    filled = days_of(new)
    if stray := [day for day in filled if day not in days]:
        raise ValueError(f"rows moved to days that were not asked for: {stray}")
    if filled:
        overwrite_days(new.drop(DAY), table, path)
    for day in days:
        if day not in filled:
            remove_folder(spark, day_folder(path, day))
    return days


def update_partitions(spark: SparkSession, table: str, path: str, updates: DataFrame, now: datetime) -> Days:
    """Update rows of a declared table in day folders, and stamp them; gives the days that were rewritten.

    Unknown keys change nothing. A row whose day changes moves to its new folder. Two updates of
    one key raise, as in ``changes.update_with_stamp``; rules are checked by ``changes.update_report``.
    """
    spec, day_of = schema.TABLES[table], LAYOUTS[table].day_of
    checks.require(checks.check_unique(updates, "updates", [spec.key]))
    held = read_laid_out(spark, table, path).select(spec.key, DAY)
    touched = held.join(updates.select(spec.key), spec.key, "left_semi").select(DAY)
    if day_of in updates.columns:
        moved = updates.join(held.select(spec.key), spec.key, "left_semi").select(F.to_date(day_of).alias(DAY))
        touched = touched.unionByName(moved)
    stamp = "updated_at" if spec.stamped else None
    return rewrite_days(
        spark, table, path, days_of(touched), lambda rows: changes.update_with_stamp(rows, updates, [spec.key], now, stamp)
    )


def delete_partitions(spark: SparkSession, table: str, path: str, column: str, gone: DataFrame, key: str) -> Days:
    """Delete the rows whose ``column`` is among ``gone``'s ``key``; gives the days that were rewritten."""
    held = read_laid_out(spark, table, path).select(column, DAY)
    touched = days_of(changes.rows_of(held, column, gone, key))
    return rewrite_days(spark, table, path, touched, lambda rows: changes.rows_left(rows, column, gone, key))


def delete_with_children(
    spark: SparkSession, paths: Mapping[str, str], others: Mapping[str, DataFrame], table: str, gone: DataFrame
) -> dict[str, Days]:
    """Delete the keys ``gone`` of a table in day folders, with its cascading children.

    ``paths`` names the folders of the table and of its cascading children, ``others`` the tables whose rows
    block a delete. Children go first, so that a failure in between leaves no row without its parent.
    """
    spec = schema.TABLES[table]
    blocking = {child: r for child, r in schema.children(table) if not r.cascade}
    if blocking:
        checks.require(changes.blocking_counts(others, table, gone))
    rewritten = {}
    for child, reference in schema.children(table):
        if reference.cascade:
            rewritten[child] = delete_partitions(spark, child, paths[child], reference.column, gone, reference.parent_column)
    rewritten[table] = delete_partitions(spark, table, paths[table], spec.key, gone, spec.key)
    return rewritten


def purge_days(spark: SparkSession, table: str, path: str, now: datetime) -> Days:
    """Remove the rows whose day column lies before ``now``: past days as folders, and of today's folder what has expired."""
    day_of = LAYOUTS[table].day_of
    known = [day for day in days_of(read_laid_out(spark, table, path)) if day is not None]
    for day in known:
        if day < now.date():
            remove_folder(spark, day_folder(path, day))
    today = [day for day in known if day == now.date()]
    rewrite_days(spark, table, path, today, lambda rows: rows.where(F.col(day_of) >= at(now)))
    return [day for day in known if day <= now.date()]
