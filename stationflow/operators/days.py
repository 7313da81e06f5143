"""Day sets: what is present, what to export, what is safe to drop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import day_of_key, utc_day


def days_present(df: DataFrame, time: str = "observed_at") -> DataFrame:
    """Distinct UTC days holding rows."""
    return df.select(utc_day(time).alias("day")).distinct()


def observed_day_range(df: DataFrame) -> DataFrame:
    """One row: first and last UTC day, null for no rows."""
    return df.agg(
        utc_day(F.min("observed_at")).alias("first_day"),
        utc_day(F.max("observed_at")).alias("last_day"),
    )


def staged_days(keys: DataFrame, table: str, key: str = "key") -> DataFrame:
    """Distinct days named by staged object keys; foreign and malformed keys are skipped."""
    return keys.select(day_of_key(key, table).alias("day")).dropna().distinct()


def _day(value: dt.date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def days_needing_export(
    present: DataFrame,
    archived: DataFrame,
    *,
    today: dt.date | Column,
    start: dt.date | Column | None = None,
) -> DataFrame:
    """Complete days (before ``today``, from ``start`` on) the archive does not hold."""
    complete = present.select("day").where(F.col("day") < _day(today))
    if start is not None:
        complete = complete.where(F.col("day") >= _day(start))
    return complete.subtract(archived.select("day"))


def days_safe_to_trim(
    present: DataFrame, archived: DataFrame, *, today: dt.date | Column, keep_days: int
) -> DataFrame:
    """Days both present and archived, older than the retention period."""
    if keep_days < 0:
        raise ValueError("keep_days must not be negative")
    cutoff = F.date_sub(_day(today), keep_days)
    return (
        present.select("day").intersect(archived.select("day")).where(F.col("day") < cutoff)
    )


def plan_export(
    present: DataFrame,
    archived: DataFrame,
    *,
    today: dt.date,
    start: dt.date | None = None,
    day: dt.date | None = None,
    backfill: bool = False,
) -> DataFrame:
    """Days to export: one named day, every staged day, or the missing ones."""
    if day is not None:
        return present.sparkSession.range(1).select(F.lit(day).alias("day"))
    if backfill:
        archived = archived.where(F.lit(False))
    return days_needing_export(present, archived, today=today, start=start)


def gap_report(missing: DataFrame, archived: DataFrame) -> DataFrame:
    """One row: number of missing days, and whether that deserves a warning."""
    held = archived.agg(F.count("*") > 0).scalar()
    return missing.agg(F.count("*").alias("missing_days")).select(
        "missing_days", ((F.col("missing_days") > 1) & held).alias("warn")
    )


def without_days(df: DataFrame, days: DataFrame, time: str = "observed_at") -> DataFrame:
    """Rows outside the given UTC days."""
    marked = df.withColumn("_day", utc_day(time))
    return marked.join(
        days.select(F.col("day").alias("_day")).distinct(), "_day", "left_anti"
    ).drop("_day")
