"""Instants, UTC days and local calendar parts as column expressions."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
MINUTE_US = 60 * SECOND_US
HOUR_US = 60 * MINUTE_US
DAY_US = 24 * HOUR_US

CYCLE_FORMAT = "yyyyMMdd'T'HHmmss'Z'"


def micros(column: str | Column) -> Column:
    """Microseconds since the epoch; zone-less input is taken as UTC."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_micros(column.cast("timestamp"))


def floor_div(value: Column, width: int) -> Column:
    """Integer division that rounds down for negative values too."""
    return F.call_function("div", value - F.pmod(value, F.lit(width)), F.lit(width))


def utc_day(column: str | Column) -> Column:
    """UTC calendar day of an instant, whatever the session zone."""
    return F.date_from_unix_date(floor_div(micros(column), DAY_US).cast("int"))


def minutes(value: float) -> Column:
    """A minute count as an interval."""
    return F.make_dt_interval(mins=F.lit(int(value)))


def instant(value: dt.datetime | str | Column) -> Column:
    """A fixed point in time; text must carry an explicit zero offset."""
    if isinstance(value, Column):
        return value.cast("timestamp")
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.utcoffset() is None:
        raise ValueError(f"instant must carry a UTC offset: {value!r}")
    if value.utcoffset() != dt.timedelta(0):
        raise ValueError(f"instant must be UTC: {value!r}")
    since = value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)
    return F.timestamp_micros(F.lit(since // dt.timedelta(microseconds=1)).cast("bigint"))


def day_bounds(day: dt.date) -> tuple[Column, Column]:
    """First instant of a UTC day and of the day after."""
    start = dt.datetime(day.year, day.month, day.day, tzinfo=dt.timezone.utc)
    return instant(start), instant(start + dt.timedelta(days=1))


def cycle_stamp(column: str | Column) -> Column:
    """An instant as the compact text used in snapshot keys."""
    return F.date_format(column, CYCLE_FORMAT)


def day_of_key(key: str | Column, table: str) -> Column:
    """Day named by a staged object's key; null for a foreign or malformed key."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.regexp_extract(key, rf"^snapshots/{table}/date=([^/]*).*\.parquet$", 1)
    plain = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)
    return F.try_to_date(plain)


def to_local(column: str | Column, zone: str) -> Column:
    """Wall-clock time of an instant in a zone (UTC session)."""
    column = F.col(column) if isinstance(column, str) else column
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), column.cast("timestamp_ntz"))


def cycle_position(value: Column, period: int) -> tuple[Column, Column]:
    """Sine and cosine of a position on a repeating scale."""
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def local_hour(column: str | Column, zone: str) -> Column:
    return F.hour(to_local(column, zone))


def local_weekday(column: str | Column, zone: str) -> Column:
    """ISO weekday, Monday 1 to Sunday 7."""
    return F.weekday(to_local(column, zone)) + F.lit(1)


def seconds_between(newer: str | Column, older: str | Column) -> Column:
    return (micros(newer) - micros(older)) / F.lit(float(SECOND_US))
