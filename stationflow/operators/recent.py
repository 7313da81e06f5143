"""The rolling window and its extent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.functions.clock import minutes, seconds_between
from stationflow.schemas import LOOKBACK_MINUTES, WINDOW_MINUTES


def trim_to_window(df: DataFrame, window_minutes: int = WINDOW_MINUTES) -> DataFrame:
    """Rows at most ``window_minutes`` older than the newest row of the whole frame."""
    newest = df.agg(F.max("observed_at")).scalar()
    return df.where(F.col("observed_at") >= newest - minutes(window_minutes))


def lookback(df: DataFrame, as_of: Column, lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """Rows observed within ``lookback_minutes`` before ``as_of`` or later."""
    return df.where(F.col("observed_at") >= as_of - minutes(lookback_minutes))


def observed_bounds(df: DataFrame) -> DataFrame:
    """One row: oldest and newest observation, null for no rows."""
    return df.agg(
        F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest")
    )


def history_span(df: DataFrame) -> DataFrame:
    """One row: seconds between the oldest and the newest observation."""
    return observed_bounds(df).select(
        seconds_between("newest", "oldest").alias("span_seconds")
    )


def covers_lookback(df: DataFrame, lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    """One row: whether the history is deep enough; false for no rows."""
    deep = F.col("span_seconds") >= F.lit(60.0 * lookback_minutes)
    return history_span(df).select(F.coalesce(deep, F.lit(False)).alias("covered"))
