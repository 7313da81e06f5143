"""Reshaping older table forms into the current ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.operators.newest import last_time, newest_rows
from stationflow.schemas import ELECTRIC_PROPULSION, STATION_KEY

STATION_ATTRIBUTES = ("station_name", "lat", "lon", "capacity")


def split_station_attributes(
    snapshots: DataFrame, attributes: Sequence[str] = STATION_ATTRIBUTES
) -> tuple[DataFrame, DataFrame]:
    """A dimension of distinct station attributes, and the snapshots without them."""
    dimension = snapshots.select(*STATION_KEY, *attributes).distinct()
    return dimension, snapshots.drop(*attributes)


def per_type_rows(df: DataFrame, entries: str, keys: Sequence[str]) -> DataFrame:
    """Long form: one row per key and vehicle type of a per-type list."""
    return df.select(*keys, F.inline(entries)).withColumnRenamed("count", "num_vehicles")


def propulsion_counts(long: DataFrame, types: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Wide form: electric and human-powered counts per key; unknown types count as neither."""
    electric = F.col("propulsion_type").isin(*ELECTRIC_PROPULSION)

    def total(chosen: Column) -> Column:
        return F.sum(F.when(chosen, F.col("num_vehicles")).otherwise(0))

    typed = long.join(types.select("vehicle_type_id", "propulsion_type"), "vehicle_type_id", "left")
    return typed.groupBy(*keys).agg(
        total(electric).alias("num_vehicles_electric"),
        total(~electric).alias("num_vehicles_human"),
    )


def with_baseline_time(stations: DataFrame, status: DataFrame, as_of: Column) -> DataFrame:
    """Date an undated station row by its newest status, or ``as_of`` without one."""
    newest = last_time(status, "_newest")
    return (
        stations.drop("observed_at")
        .join(newest, list(STATION_KEY), "left")
        .withColumn("observed_at", F.coalesce("_newest", as_of))
        .drop("_newest")
    )


def drop_superseded(history: DataFrame) -> DataFrame:
    """Only the newest row per station of a change log."""
    return newest_rows(history)
