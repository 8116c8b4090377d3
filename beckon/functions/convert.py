"""Type conversion of source values to target types, null on failure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INT_TEXT = r"^[+-]?\d+$"
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
DATE_TEXT = r"^\d{4}-\d{2}-\d{2}"
TIME_TEXT = r"T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?"
ZONE_TEXT = r"(Z|[+-]\d{2}(:\d{2})?)(\[[^\]]+\])?"


def parse_instant(col: Column) -> Column:
    """Zoned ISO date-time or epoch-millis digits; a zone-less date-time is a failure (null)."""
    zoned = F.regexp_replace(col, r"\[[^\]]+\]$", "").try_cast("timestamp")
    return F.when(col.rlike(DATE_TEXT + TIME_TEXT + ZONE_TEXT + "$"), zoned).when(
        col.rlike(INT_TEXT), F.timestamp_millis(col.try_cast("bigint"))
    )


def is_iso_date(col: Column) -> Column:
    """ISO text accepted by validation: date-time with or without zone, or a date with optional zone."""
    shape = col.rlike(DATE_TEXT + f"({TIME_TEXT})?({ZONE_TEXT})?$")
    day = F.substring(col, 1, 10).try_cast("date").isNotNull()
    clock = F.when(col.contains("T"), F.substring(col, 1, 19).try_cast("timestamp_ntz").isNotNull()).otherwise(True)
    return F.coalesce(shape & day & clock, F.lit(False))


def convert_type(col: Column, target: str, source: T.DataType | None = None) -> Column:
    """Convert ``col`` of type ``source`` (text by default) to one of the eight target types.

    A value that cannot be converted becomes null; the caller decides whether that is an
    error or takes the default (P3).
    """
    source = source or T.StringType()
    text = isinstance(source, T.StringType)
    number = isinstance(source, T.NumericType)
    nothing = F.lit(None)
    if target == "STRING":
        return col.cast("string")
    if target in ("INTEGER", "LONG"):
        sql = "int" if target == "INTEGER" else "bigint"
        if text:
            return F.when(col.rlike(INT_TEXT), col.try_cast(sql))
        return col.try_cast(sql) if number else nothing.cast(sql)
    if target == "DOUBLE":
        if text:
            return F.when(col.rlike(NUMBER_TEXT), F.trim(col).try_cast("double"))
        return col.cast("double") if number else nothing.cast("double")
    if target == "BOOLEAN":
        if text:
            return F.lower(col) == "true"
        if number:
            return col != 0
        return col if isinstance(source, T.BooleanType) else nothing.cast("boolean")
    if target == "INSTANT":
        if text:
            return parse_instant(col)
        if number:
            return F.timestamp_millis(col.try_cast("bigint"))
        return col.cast("timestamp") if isinstance(source, T.TimestampType | T.TimestampNTZType) else nothing.cast("timestamp")
    if target == "LIST":
        if text:
            return F.when(col.isNotNull(), F.transform(F.split(col, ","), lambda x: F.trim(x)))
        return col if isinstance(source, T.ArrayType) else F.when(col.isNotNull(), F.array(col))
    if target == "MAP":
        return col if isinstance(source, T.MapType) else nothing.cast("map<string,string>")
    raise ValueError(f"unknown target type {target}")


def messages(*parts: tuple[Column, Column]) -> Column:
    """Array of the messages whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, msg) for cond, msg in parts]))


def days_between(start: Column, end: Column) -> Column:
    """Whole days from start to end, truncated toward zero."""
    diff = F.unix_micros(end) - F.unix_micros(start)
    whole = F.floor(F.abs(diff) / F.lit(86_400_000_000))
    return F.when(diff < 0, -whole).otherwise(whole).cast("bigint")


def as_ts(value) -> Column:
    """A timestamp literal from text, or the column unchanged."""
    return value if isinstance(value, Column) else F.lit(value).cast("timestamp")


def iso(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")
