"""Column expressions shared by the jobs; all stay inside Spark's own functions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

# Fixed value: how a time is written in a snapshot name.
STAMP_FORMAT = "yyyyMMdd_HHmmss"

# Written forms of the string-held types. Java regular expressions,
# matched against the whole value.
UUID_PATTERN = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_OCTET = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_GROUP = "[0-9a-fA-F]{1,4}"
INET_PATTERN = (
    f"^({_OCTET}(\\.{_OCTET}){{3}}(/(3[0-2]|[12]?[0-9]))?"
    f"|(({_GROUP}:){{7}}{_GROUP}|({_GROUP}:){{1,7}}:|({_GROUP}:){{1,6}}:{_GROUP}"
    f"|({_GROUP}:){{1,5}}(:{_GROUP}){{1,2}}|({_GROUP}:){{1,4}}(:{_GROUP}){{1,3}}"
    f"|({_GROUP}:){{1,3}}(:{_GROUP}){{1,4}}|({_GROUP}:){{1,2}}(:{_GROUP}){{1,5}}"
    f"|{_GROUP}:(:{_GROUP}){{1,6}}|:((:{_GROUP}){{1,7}}|:)"
    f"|({_GROUP}:){{6}}{_OCTET}(\\.{_OCTET}){{3}}|::(ffff:)?{_OCTET}(\\.{_OCTET}){{3}})"
    "(/(12[0-8]|1[01][0-9]|[1-9]?[0-9]))?)$"
)


def at(moment: datetime) -> Column:
    """A point in time without a zone, as every time column holds it."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def money(column: Column) -> Column:
    """decimal(10,2), half away from zero; too large a value is an error."""
    return column.cast("decimal(10,2)")


def unless(column: Column, excluded: str, value: str) -> Column:
    """``value`` where ``column`` differs from ``excluded``; a NULL differs too."""
    return F.when(~column.eqNullSafe(F.lit(excluded)), F.lit(value))


def not_listed(column: Column, values: tuple[str, ...]) -> Column:
    """NOT IN: neither true nor false for NULL, so a filter drops such rows."""
    return ~column.isin(*values)


def stamp_text(moment: Column) -> Column:
    return F.date_format(moment, STAMP_FORMAT)


def snapshot_name(database: str, moment: Column) -> Column:
    return F.concat(F.lit(database), F.lit("_"), stamp_text(moment))


def json_value(column: Column, path: str, kind: str) -> Column:
    """One field of a JSON text; extract it before grouping, as VARIANT is no key."""
    return F.try_variant_get(F.try_parse_json(column), path, kind)


def well_formed(column: Column, form: str) -> Column:
    """Whether a string-held uuid, inet or json value has the right form."""
    if form == "json":
        return F.try_parse_json(column).isNotNull()
    return column.rlike({"uuid": UUID_PATTERN, "inet": INET_PATTERN}[form])


def micros(column: Column) -> Column:
    """Whole microseconds from 1970 to a time without a zone, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), column.cast("timestamp_ntz"))


def as_variant(column: Column) -> Column:
    """JSON text as VARIANT, to be stored; NULL where it is not well formed. The last of repeated keys counts."""
    return F.try_parse_json(column)


def variant_field(column: Column, path: str, kind: str) -> Column:
    """One field of a stored VARIANT; NULL where it is missing or of another kind."""
    return F.try_variant_get(column, path, kind)
