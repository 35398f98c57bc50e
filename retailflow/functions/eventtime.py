"""Event-time parsing, ranges and calendar labels."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}


def parse_iso(text: Column | str) -> Column:
    """ISO-8601 text to TIMESTAMP; NULL when it does not parse."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def duration(text: str) -> timedelta:
    """'30 minutes' -> timedelta."""
    number, unit = text.split()
    return timedelta(seconds=float(number) * _UNIT_SECONDS[unit.rstrip("s")])


def in_range(ts: Column | str, start, end) -> Column:
    """Half-open range on the bare column, so it reaches the file scan as a pushed filter."""
    c = F.col(ts) if isinstance(ts, str) else ts
    if start is None or end is None:
        return c >= start if end is None else c < end
    return (c >= start) & (c < end)


def month_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def week_label(ts: Column) -> Column:
    """ISO week with its ISO year; calendar year and ISO week must not be paired."""
    iso_year = F.extract(F.lit("YEAROFWEEK"), ts)
    return F.concat(iso_year.cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def quarter_label(ts: Column) -> Column:
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def as_ntz(df: DataFrame) -> DataFrame:
    """Top-level TIMESTAMP columns as TIMESTAMP_NTZ (UTC wall time)."""
    return df.select(*[
        F.col(f"`{f.name}`").cast("timestamp_ntz").alias(f.name)
        if isinstance(f.dataType, T.TimestampType) else F.col(f"`{f.name}`")
        for f in df.schema.fields])
