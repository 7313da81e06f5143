"""Freshness, depth and volume reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.clock import seconds_between


def readiness(
    window: DataFrame,
    as_of: Column,
    *,
    model_loaded: bool = True,
    storage_reachable: bool = True,
    model_run_id: str | None = None,
    max_age_minutes: int = S.MAX_DATA_AGE_MINUTES,
    lookback_minutes: int = S.LOOKBACK_MINUTES,
) -> DataFrame:
    """One row: could a forecast be served at ``as_of``, and if not, why."""
    extent = window.agg(
        F.min("observed_at").alias("oldest"), F.max("observed_at").alias("newest")
    )
    measured = extent.select(
        F.lit(model_loaded).alias("model_loaded"),
        F.lit(model_run_id).cast("string").alias("model_run_id"),
        F.lit(storage_reachable).alias("storage_reachable"),
        F.col("newest").alias("latest_observed_at"),
        seconds_between(as_of, F.col("newest")).alias("data_age_seconds"),
        F.lit(60.0 * max_age_minutes).alias("max_data_age_seconds"),
        seconds_between("newest", "oldest").alias("history_span_seconds"),
        F.lit(60.0 * lookback_minutes).alias("required_history_seconds"),
    )
    fresh = F.coalesce(F.col("data_age_seconds") <= F.col("max_data_age_seconds"), F.lit(False))
    deep = F.coalesce(
        F.col("history_span_seconds") >= F.col("required_history_seconds"), F.lit(False)
    )
    checked = measured.withColumns({"data_fresh": fresh, "history_deep_enough": deep})
    ready = (
        F.col("model_loaded")
        & F.col("storage_reachable")
        & F.col("data_fresh")
        & F.col("history_deep_enough")
    )
    return checked.withColumn("status", F.when(ready, "ready").otherwise("not_ready"))


def rows_per_table(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of each named table."""
    counted = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counted)
