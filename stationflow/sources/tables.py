"""Readers of status and station tables."""

from __future__ import annotations

import datetime as dt

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow import schemas as S
from stationflow.functions.clock import day_bounds, instant, utc_day
from stationflow.operators.contract import require_columns
from stationflow.operators.newest import current_capacity, newest_rows
from stationflow.sources import archive, storage


def read_table(spark: SparkSession, path: str, table: str, *, strict: bool = False) -> DataFrame:
    """A day-partitioned table under its declared schema.

    A file that lacks a newer column reads as null there; ``strict`` rejects a table whose
    files lack a declared column. A missing table is an error. Of an archive with manifests, the
    published days are read.
    """
    if archive.has_manifest(spark, path):
        if strict:
            files = archive.scan(spark, path, table).inputFiles()
            require_columns(
                spark.read.option("mergeSchema", "true").parquet(*files) if files else
                archive.read(spark, path, table),
                S.TABLE_SCHEMAS[table].fieldNames(),
                label=path,
            )
        return archive.read(spark, path, table)
    if strict:
        require_columns(
            spark.read.option("mergeSchema", "true").parquet(path),
            S.TABLE_SCHEMAS[table].fieldNames(),
            label=path,
        )
    return spark.read.schema(S.TABLE_SCHEMAS[table]).parquet(path)


def read_serving(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A serving table, or an empty typed frame when it is missing or unreadable.

    All or nothing: one part whose footer cannot be read makes the whole table unreadable, and
    damage further inside a part is an error for whoever reads it.
    """
    schema = S.TABLE_SCHEMAS[table]
    if not storage.exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    try:
        rows.count()  # from the footers of all parts
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], schema)
    return rows


def read_jdbc(
    spark: SparkSession,
    *,
    url: str,
    table: str,
    since: dt.datetime,
    until: dt.datetime,
    tasks: int,
    **options: str,
) -> DataFrame:
    """A database table, read by ``tasks`` connections over slices of observation time."""
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", "observed_at")
        .option("lowerBound", since.isoformat(sep=" "))
        .option("upperBound", until.isoformat(sep=" "))
        .option("numPartitions", str(tasks))
        .options(**options)
    )
    return reader.load()


def staged_path(root: str, table: str) -> str:
    return f"{root}/snapshots/{table}"


def read_staged(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Every staged snapshot, with its ``date`` and ``cycle`` partition columns."""
    path, schema = staged_path(root, table), T.StructType(list(S.TABLE_SCHEMAS[table]))
    schema = schema.add("date", T.DateType()).add("cycle", T.StringType())
    if not storage.children(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def staged_keys_for_day(spark: SparkSession, root: str, table: str, day: dt.date) -> list[str]:
    """Staged objects of one table-day in key order."""
    return storage.data_files(spark, f"{staged_path(root, table)}/date={day.isoformat()}")


def read_staged_day(spark: SparkSession, root: str, table: str, day: dt.date) -> DataFrame:
    """Rows staged for one table-day, oldest first; partition pruning limits the scan."""
    staged = read_staged(spark, root, table).where(F.col("date") == F.lit(day))
    return staged.select(*S.TABLE_SCHEMAS[table].fieldNames()).orderBy("observed_at")


def day_rows(df: DataFrame, day: dt.date) -> DataFrame:
    """Rows of one UTC day, oldest first; a ``date`` partition column limits the scan."""
    start, end = day_bounds(day)
    time = F.col("observed_at")
    rows = df.where((time >= start) & (time < end))
    if "date" in df.columns:
        rows = rows.where(F.col("date") == F.lit(day)).drop("date")
    return rows.orderBy("observed_at")


def status_history(
    df: DataFrame,
    system_id: str,
    *,
    since: dt.datetime | str | Column | None = None,
    ordered: bool = True,
) -> DataFrame:
    """One system's history with the columns training needs.

    ``since`` also prunes by a ``date`` partition column, where there is one.
    ``ordered=False`` skips the global sort, which window operators do not need.
    """
    rows = df.where(F.col("system_id") == system_id)
    if since is not None:
        rows = rows.where(F.col("observed_at") >= instant(since))
        if "date" in df.columns:
            rows = rows.where(F.col("date") >= utc_day(instant(since)))
    rows = rows.select(*S.RAW_COLUMNS)
    return rows.orderBy("station_id", "observed_at") if ordered else rows


def station_history(df: DataFrame, system_id: str) -> DataFrame:
    """Every recorded state of one system's stations, by station then time."""
    return df.where(F.col("system_id") == system_id).orderBy("station_id", "observed_at")


def station_catalog(history: DataFrame, system_id: str | None = None) -> DataFrame:
    """Newest capacity of every station."""
    if system_id is not None:
        history = history.where(F.col("system_id") == system_id)
    return current_capacity(history)


def latest_stations(history: DataFrame, system_id: str) -> DataFrame:
    """Newest recorded row of every station of a system."""
    return newest_rows(history.where(F.col("system_id") == system_id))


def station_details(stations: DataFrame, system_id: str, station_id: str) -> DataFrame:
    """Newest row of one station; no rows when it is unknown."""
    wanted = (F.col("system_id") == system_id) & (F.col("station_id") == station_id)
    return stations.where(wanted).orderBy(F.desc("observed_at")).limit(1)


def recent_status(
    df: DataFrame, system_id: str, station_id: str, since: dt.datetime | str | Column
) -> DataFrame:
    """One station's rows from ``since`` on, oldest first."""
    return df.where(
        (F.col("system_id") == system_id)
        & (F.col("station_id") == station_id)
        & (F.col("observed_at") >= instant(since))
    ).orderBy("observed_at")


def latest_status_time(df: DataFrame, system_id: str) -> DataFrame:
    """One row: newest observation of a system, null for none."""
    return df.where(F.col("system_id") == system_id).agg(
        F.max("observed_at").alias("observed_at")
    )
