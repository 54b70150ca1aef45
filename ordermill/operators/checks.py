"""Data-quality rules: one scan per table, one shuffle per key or reference.

Every report has the columns ``table_name, rule, kind, violations``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from decimal import Decimal
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ordermill import schema
from ordermill.functions.expressions import well_formed


class Rule(NamedTuple):
    """``violated`` is true for a bad row. NULL counts as good, as in a CHECK."""

    name: str
    kind: str
    violated: Column


def not_null(column: str) -> Rule:
    return Rule(column, "not_null", F.col(column).isNull())


def allowed(column: str, values: Sequence[str]) -> Rule:
    return Rule(column, "allowed_values", ~F.col(column).isin(*values))


def not_negative(column: str) -> Rule:
    return Rule(column, "not_negative", F.col(column) < 0)


def positive(column: str) -> Rule:
    return Rule(column, "positive", F.col(column) <= 0)


def max_length(column: str, limit: int) -> Rule:
    return Rule(column, "max_length", F.char_length(column) > limit)


def fits_decimal(column: str, precision: int, scale: int) -> Rule:
    """Whether the value, rounded to ``scale``, keeps within ``precision`` digits.

    The value is compared with the first one that does not fit. Casting to the narrow
    type instead would raise and catch an error for each row that does not fit.
    """
    value = F.col(column).try_cast("decimal(38,18)")
    too_large = F.lit(Decimal(10) ** (precision - scale) - Decimal(5).scaleb(-scale - 1))
    return Rule(
        column, "numeric_fit", F.col(column).isNotNull() & (value.isNull() | (F.abs(value) >= too_large))
    )


def has_form(column: str, form: str) -> Rule:
    return Rule(column, "format", F.col(column).isNotNull() & ~well_formed(F.col(column), form))


def row_rules(table: str) -> list[Rule]:
    """All rules of a declared table that look at one row at a time."""
    spec = schema.TABLES[table]
    return [
        *(not_null(c) for c in (spec.key, *spec.required)),
        *(allowed(c, values) for c, values in spec.allowed.items()),
        *(not_negative(c) for c in spec.not_negative),
        *(positive(c) for c in spec.positive),
        *(max_length(c, n) for c, n in schema.lengths(table).items()),
        *(fits_decimal(c, p, s) for c, (p, s) in schema.decimals(table).items()),
        *(has_form(c, form) for c, form in spec.formats.items()),
    ]


def report_line(table_name: str, rule: str, kind: str, violations: Column) -> list[Column]:
    return [
        F.lit(table_name).alias("table_name"),
        F.lit(rule).alias("rule"),
        F.lit(kind).alias("kind"),
        F.coalesce(violations, F.lit(0)).cast("long").alias("violations"),
    ]


def check_rows(df: DataFrame, table_name: str, rules: Sequence[Rule]) -> DataFrame:
    """Count the violations of all row rules in a single scan.

    Each rule is one partial count; what reaches the last stage is one row per task.
    """
    counts = df.agg(*(F.count_if(rule.violated).alias(f"_{i}") for i, rule in enumerate(rules)))
    lines = [F.struct(*report_line(table_name, r.name, r.kind, F.col(f"_{i}"))) for i, r in enumerate(rules)]
    return counts.select(F.inline(F.array(*lines)))


def broken_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """The rows that break at least one rule, with the names of those rules."""
    broken = F.filter(
        F.array(*(F.when(r.violated, F.lit(f"{r.kind}:{r.name}")) for r in rules)),
        lambda name: name.isNotNull(),
    )
    return df.withColumn("broken_rules", broken).where(F.size("broken_rules") > 0)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count.

    A key with a NULL part never clashes. Counting combines before the shuffle, so a
    key with many copies travels as one row per task.
    """
    whole = reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))
    return df.where(whole).groupBy(*keys).agg(F.count("*").alias("copies")).where(F.col("copies") > 1)


def check_unique(df: DataFrame, table_name: str, keys: Sequence[str], kind: str = "unique") -> DataFrame:
    """Rows beyond the first of each key."""
    surplus = duplicate_keys(df, keys).agg(F.sum(F.col("copies") - 1).alias("surplus"))
    return surplus.select(*report_line(table_name, ", ".join(keys), kind, F.col("surplus")))


def orphan_keys(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Key values without a parent row, with the number of child rows holding them.

    Children are counted per key before the join: however often one key occurs, the
    join sees it once. A NULL key refers to nothing and is fine.
    """
    held = child.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("child_rows"))
    known = parent.select(F.col(parent_column).alias("_parent_key"))
    return held.join(known, F.col(column) == F.col("_parent_key"), "left_anti")


def orphan_rows(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """The child rows themselves; adaptive execution splits a key with many rows."""
    known = parent.select(F.col(parent_column).alias("_parent_key"))
    return child.where(F.col(column).isNotNull()).join(
        known, F.col(column) == F.col("_parent_key"), "left_anti"
    )


def check_reference(
    child: DataFrame, table_name: str, column: str, parent: DataFrame, parent_name: str, parent_column: str
) -> DataFrame:
    total = orphan_keys(child, column, parent, parent_column).agg(F.sum("child_rows").alias("orphans"))
    return total.select(
        *report_line(table_name, f"{column} -> {parent_name}.{parent_column}", "reference", F.col("orphans"))
    )


def union_all(reports: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, reports)


def check_table(tables: Mapping[str, DataFrame], table: str) -> DataFrame:
    """The full report of one declared table; ``tables`` must hold its parents."""
    spec, df = schema.TABLES[table], tables[table]
    return union_all(
        [
            check_rows(df, table, row_rules(table)),
            check_unique(df, table, [spec.key], "primary_key"),
            *(check_unique(df, table, [column]) for column in spec.unique),
            *(
                check_reference(df, table, r.column, tables[r.parent], r.parent, r.parent_column)
                for r in spec.references
            ),
        ]
    )


def check_all(tables: Mapping[str, DataFrame]) -> DataFrame:
    return union_all(check_table(tables, name) for name in schema.TABLES)


def failures(report: DataFrame) -> DataFrame:
    return report.where(F.col("violations") > 0)


class BrokenRules(ValueError):
    """Raised where rows would not have been accepted."""


def require(report: DataFrame) -> None:
    """Raise if the report lists any violation. A report has one row per rule."""
    bad = failures(report).collect()
    if bad:
        raise BrokenRules(
            "; ".join(f"{r.table_name}: {r.kind} {r.rule}: {r.violations}" for r in bad)
        )
