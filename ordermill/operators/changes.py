"""Row changes as functions from a table to its next state.

Nothing is changed in place: each function returns DataFrames, and a sink writes
them under a new version (see ``plans.snapshots``). Where a change touches little of
a large table, the touched rows are available on their own as well.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ordermill import schema
from ordermill.functions.expressions import at
from ordermill.operators import checks
from ordermill.operators.runs import numbered_rows
from ordermill.plans.views import fewer_than
from ordermill.session import scratch_dir
from ordermill.sources.layout import DAY


def with_defaults(df: DataFrame, columns: Mapping[str, str], defaults: Mapping[str, Column]) -> DataFrame:
    """Fill columns that ``df`` lacks: with their default, or NULL if they have none.

    A column that is present stays as it is, its NULLs included. ``columns`` maps the
    full column list to types.
    """
    present = set(df.columns)
    return df.select(
        *(
            (F.col(c) if c in present else defaults.get(c, F.lit(None))).cast(kind).alias(c)
            for c, kind in columns.items()
        )
    )


def prepare(df: DataFrame, table: str, now: datetime, next_key: int = 1, key_order: Sequence[str] = ()) -> DataFrame:
    """Turn incoming rows into rows of a declared table: defaults, types and keys.

    Missing integer keys are numbered from ``next_key`` in the order of ``key_order``.
    """
    spec = schema.TABLES[table]
    computed = {schema.NOW: at(now), schema.RANDOM_UUID: F.uuid()}
    defaults = {
        c: computed[v] if isinstance(v, schema.Marker) else F.lit(v) for c, v in spec.defaults.items()
    }
    if spec.serial and spec.key not in df.columns:
        df = numbered_rows(df, key_order or df.columns, spec.key, start=next_key - 1)
    columns = {f.name: f.dataType for f in schema.struct(table).fields}
    return with_defaults(df, columns, defaults)


def without_excess_blanks(df: DataFrame, table: str) -> DataFrame:
    """Values that are too long by blanks at their end only, cut to the allowed length."""

    def cut(column: str, limit: int) -> Column:
        whole = F.col(column)
        only_blanks = (F.char_length(whole) > limit) & (F.rtrim(F.substring(whole, limit + 1, 1 << 30)) == "")
        return F.when(only_blanks, F.substring(whole, 1, limit)).otherwise(whole)

    return df.withColumns({c: cut(c, n) for c, n in schema.lengths(table).items()})


def next_key(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key), F.lit(0)).alias("last")).first()["last"] + 1


def _whole(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first in ``order``.

    Spark keeps only the first row per key on the map side already, so a key with
    many rows does not travel whole.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") == 1).drop("_rank")


def absent_rows(target: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The incoming rows that an insert-if-absent adds: unknown keys, first row each.

    The target is first reduced to the incoming keys. With a small batch this semi
    join broadcasts the batch, so the large target is scanned but not shuffled. A key
    with a NULL part clashes with nothing; such rows pass by the joins.
    """
    keyed = incoming.where(_whole(keys))
    held = target.select(*keys).join(keyed.select(*keys).distinct(), list(keys), "left_semi")
    added = first_per_key(keyed, keys, order).join(held, list(keys), "left_anti")
    return added.select(*incoming.columns).unionByName(incoming.where(~_whole(keys)))


def insert_if_absent(
    target: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    other_unique: Iterable[Sequence[str]] = (),
) -> DataFrame:
    """Add rows whose key is new; existing rows win.

    Only ``keys`` is forgiving: a clash on one of ``other_unique`` raises.
    """
    added = absent_rows(target, incoming, keys, order).select(*target.columns)
    for unique in other_unique:
        checks.require(clashes(target, added, "target", unique))  # the target itself was checked when its rows came
    return target.unionByName(added)


def absent_from_buckets(
    spark: SparkSession, name: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str], buckets: int
) -> DataFrame:
    """The rows that an insert-if-absent adds to a table in buckets of its keys.

    For batches too large to broadcast: they are dealt into as many buckets, and each meets its
    bucket of the table, which is read as it lies, without a shuffle.
    """
    return absent_rows(spark.table(name), incoming.repartition(buckets, *keys), keys, order)


def clashes(target: DataFrame, new: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """How many new rows repeat a key of each other or of the target."""
    counted = new.where(_whole(keys)).groupBy(*keys).agg(F.count("*").alias("_new"))
    wanted = counted.select(*keys)
    held = target.select(*keys).join(wanted, list(keys), "left_semi").distinct().withColumn("_held", F.lit(1))
    surplus = F.col("_new") - F.when(F.col("_held") == 1, 0).otherwise(1)
    total = counted.join(held, list(keys), "left").agg(F.sum(surplus).alias("surplus"))
    return total.select(*checks.report_line(table, ", ".join(keys), "unique", F.col("surplus")))


def insert_rows(
    tables: Mapping[str, DataFrame], table: str, incoming: DataFrame, now: datetime, key_order: Sequence[str] = ()
) -> DataFrame:
    """Insert into a declared table: fill defaults and keys, check every rule, append.

    Only the new rows are checked, the old ones were when they came. Raises if any
    rule is broken; then nothing is inserted.
    """
    spec, target = schema.TABLES[table], tables[table]
    numbered = spec.serial and spec.key not in incoming.columns
    prepared = prepare(incoming, table, now, next_key(target, spec.key) if numbered else 1, key_order)
    # Stored once: every check and the write see the same keys and random ids.
    path = scratch_dir(prepared.sparkSession, "incoming")
    without_excess_blanks(prepared, table).write.parquet(path)
    new = prepared.sparkSession.read.schema(prepared.schema).parquet(path)
    checks.require(
        checks.union_all(
            [
                checks.check_rows(new, table, checks.row_rules(table)),
                *(clashes(target, new, table, [column]) for column in (spec.key, *spec.unique)),
                *(
                    checks.check_reference(new, table, r.column, tables[r.parent], r.parent, r.parent_column)
                    for r in spec.references
                ),
            ]
        )
    )
    return target.unionByName(new)


def insert_if_empty(target: DataFrame, incoming: DataFrame) -> DataFrame:
    """All incoming rows if the target has none, else the target."""
    return incoming.select(*target.columns) if target.isEmpty() else target


def insert_if_fewer(target: DataFrame, incoming: DataFrame, minimum: int, keys: Sequence[str]) -> DataFrame:
    """Append all incoming rows if the target has fewer than ``minimum`` rows.

    The guard looks at the count only, so a key that is already there raises.
    """
    if not fewer_than(target, minimum):
        return target
    result = target.unionByName(incoming.select(*target.columns))
    checks.require(checks.check_unique(result, "target", keys))
    return result


def update_with_stamp(
    target: DataFrame,
    updates: DataFrame,
    keys: Sequence[str],
    now: datetime,
    stamp: str | None = "updated_at",
) -> DataFrame:
    """Replace values of matched rows and stamp them with the statement time.

    ``updates`` has any of the target's columns. A NULL in it is a new value. Two
    updates of one key raise: neither may win by chance. The stamp is set even if
    nothing changed or ``updates`` names it; tables without a stamp pass ``stamp=None``.
    """
    checks.require(checks.check_unique(updates, "updates", keys))
    changed = [c for c in updates.columns if c in target.columns and c not in keys and c != stamp]
    new = updates.select(
        *(F.col(k).alias(f"_key_{k}") for k in keys),
        *(F.col(c).alias(f"_new_{c}") for c in changed),
        F.lit(True).alias("_matched"),
    )
    meets = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_key_{k}") for k in keys))
    joined = target.join(new, meets, "left")

    def value(field) -> Column:
        c, old = field.name, F.col(field.name)
        if c == stamp:
            fresh = at(now)
        elif c in changed:
            fresh = F.col(f"_new_{c}")
        else:
            return old
        return F.when(F.col("_matched"), fresh.cast(field.dataType)).otherwise(old).alias(c)

    return joined.select(*(value(field) for field in target.schema.fields))


def touched_rows(table: str, target: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """The rows of a declared table that an update matches, as they will be."""
    spec = schema.TABLES[table]
    matched = target.join(updates.select(spec.key), spec.key, "left_semi").select(*target.columns)
    return update_with_stamp(matched, updates, [spec.key], now, "updated_at" if spec.stamped else None)


def update_report(tables: Mapping[str, DataFrame], table: str, updates: DataFrame, now: datetime) -> DataFrame:
    """What an update would break: every rule that its columns take part in.

    Only touched rows are checked; a changed unique column is also compared with the
    rows that stay.
    """
    spec, target = schema.TABLES[table], tables[table]
    new = touched_rows(table, target, updates, now)
    rest = target.join(updates.select(spec.key), spec.key, "left_anti").select(*target.columns)
    changed = set(updates.columns) - {spec.key}
    return checks.union_all(
        [
            checks.check_rows(new, table, checks.row_rules(table)),
            *(clashes(rest, new, table, [column]) for column in spec.unique if column in changed),
            *(
                checks.check_reference(new, table, r.column, tables[r.parent], r.parent, r.parent_column)
                for r in spec.references
                if r.column in changed
            ),
        ]
    )


def update_table(tables: Mapping[str, DataFrame], table: str, updates: DataFrame, now: datetime) -> DataFrame:
    """Update a declared table; raises if a touched row would break a rule."""
    spec = schema.TABLES[table]
    checks.require(update_report(tables, table, updates, now))
    return update_with_stamp(tables[table], updates, [spec.key], now, "updated_at" if spec.stamped else None)


def expired(column: str, now: datetime) -> Column:
    """Strictly before ``now``; an unknown time is not expired."""
    return F.coalesce(F.col(column) < at(now), F.lit(False))


def purge_expired(df: DataFrame, column: str, now: datetime) -> DataFrame:
    """The rows that stay. The filter reaches the scan.

    A table read in its layout has the day of this time as a column: days that have passed
    are folders that are not read.
    """
    stays = df.where((F.col(column) >= at(now)) | F.col(column).isNull())
    if DAY not in df.columns:
        return stays
    return stays.where((F.col(DAY) >= F.lit(now.date())) | F.col(DAY).isNull())


def purge_counts(df: DataFrame, column: str, now: datetime) -> DataFrame:
    """How many rows a purge deletes and keeps, in one scan of one column."""
    gone = expired(column, now)
    return df.agg(F.count_if(gone).alias("purged"), F.count_if(~gone).alias("kept"))


def rows_of(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that refer to a deleted parent."""
    gone = deleted.select(F.col(key).alias("_deleted_key"))
    return child.join(gone, F.col(column) == F.col("_deleted_key"), "left_semi")


def rows_left(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """Child rows that stay when the deleted parents take theirs along."""
    gone = deleted.select(F.col(key).alias("_deleted_key"))
    return child.join(gone, F.col(column) == F.col("_deleted_key"), "left_anti")


def count_children(child: DataFrame, column: str, deleted: DataFrame, key: str) -> DataFrame:
    """How many child rows refer to deleted parents, as one row.

    Children are counted per key before the join, so a parent with very many children
    is one row there.
    """
    held = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("child_rows"))
    total = F.coalesce(F.sum("child_rows"), F.lit(0)).alias("child_rows")
    return rows_of(held, column, deleted, key).agg(total)


def blocking_counts(tables: Mapping[str, DataFrame], table: str, deleted: DataFrame) -> DataFrame:
    """Per blocking reference, the child rows that forbid the delete."""
    return checks.union_all(
        count_children(tables[child], r.column, deleted, r.parent_column).select(
            F.lit(child).alias("table_name"),
            F.lit(f"{r.column} -> {table}.{r.parent_column}").alias("rule"),
            F.lit("blocks delete").alias("kind"),
            F.col("child_rows").alias("violations"),
        )
        for child, r in schema.children(table)
        if not r.cascade
    )


def delete_rows(tables: Mapping[str, DataFrame], table: str, predicate: Column) -> dict[str, DataFrame]:
    """Delete rows of a declared table together with its cascading children.

    Raises if a child that does not cascade still refers to a deleted row. Returns
    the next state of every table that changes.
    """
    target = tables[table]
    deleted = target.where(predicate)
    if any(not reference.cascade for _, reference in schema.children(table)):
        checks.require(blocking_counts(tables, table, deleted))
    changed = {table: target.where(~predicate | predicate.isNull())}
    for child, reference in schema.children(table):
        if reference.cascade:
            changed[child] = rows_left(tables[child], reference.column, deleted, reference.parent_column)
    return changed
