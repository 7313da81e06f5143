"""Writers: staged snapshots, the serving window, the day archive, retention."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stationflow import schemas as S
from stationflow.functions.clock import cycle_stamp, utc_day
from stationflow.operators.changes import collapse_changes
from stationflow.operators.contract import conform, union_strict
from stationflow.operators.days import days_safe_to_trim, plan_export
from stationflow.operators.newest import keep_last
from stationflow.operators.recent import trim_to_window
from stationflow.sources import archive as days_of
from stationflow.sources import storage
from stationflow.sources.tables import read_serving, read_staged, staged_path

WINDOW_ORDER = ("observed_at", "station_id", "system_id")


def snapshot_key(table: str, time: str = "observed_at"):
    """Key of the snapshot a row belongs to."""
    return F.concat(
        F.lit(f"snapshots/{table}/date="),
        F.date_format(utc_day(time), "yyyy-MM-dd"),
        F.lit("/"),
        cycle_stamp(time),
        F.lit(".parquet"),
    )


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> int:
    """Write compressed files, replacing only the partitions in ``df``; returns the rows.

    Partitioned writes are rebalanced on the partition columns: small partitions share a
    task and a large one is split over several, so no task writes a whole hot day.
    """
    written = Observation()
    if partition_by:
        df = df.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = (
        df.observe(written, F.count(F.lit(1)).alias("rows"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic" if partition_by else "static")
        .option("compression", S.PARQUET_CODEC)
        .option("parquet.compression.codec.zstd.level", str(S.PARQUET_CODEC_LEVEL))
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return written.get["rows"]


def write_snapshots(df: DataFrame, root: str, table: str) -> int:
    """Write each cycle's rows to its own partition; a replayed cycle is replaced."""
    parts = conform(df, table).select(
        "*", utc_day("observed_at").alias("date"), cycle_stamp("observed_at").alias("cycle")
    )
    return write_parquet(parts, staged_path(root, table), ("date", "cycle"))


# --- versioned serving tables ---------------------------------------------


def _serving_base(root: str, table: str) -> str:
    return f"{root}/serving/{table}"


def read_current(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The serving table its pointer names; empty and typed when there is none."""
    base = _serving_base(root, table)
    version = storage.read_text(spark, f"{base}/CURRENT")
    return read_serving(spark, f"{base}/v={version}", table)


def publish_current(df: DataFrame, root: str, table: str, version: str) -> int:
    """Write a new version, then move the pointer; readers never see a partial table.

    The previous version stays for readers that still hold it; older ones go.
    """
    spark, base = df.sparkSession, _serving_base(root, table)
    previous = storage.read_text(spark, f"{base}/CURRENT")
    rows = write_parquet(df, f"{base}/v={version}")
    storage.write_text(spark, f"{base}/CURRENT", version)
    for name in storage.children(spark, base):
        if name.startswith("v=") and name not in (f"v={version}", f"v={previous}"):
            storage.delete(spark, f"{base}/{name}")
    return rows


def merge_window(
    window: DataFrame, new_rows: DataFrame, window_minutes: int = S.WINDOW_MINUTES
) -> DataFrame:
    """Window plus new rows: replays replace, rows older than the window leave."""
    tagged = union_strict(
        window.withColumn("_source", F.lit(0)), new_rows.withColumn("_source", F.lit(1))
    )
    values = [c for c in window.columns if c not in S.IDENTITY]
    merged = keep_last(tagged, ["_source", *values]).drop("_source")
    return trim_to_window(merged, window_minutes)


def update_window(
    new_rows: DataFrame, root: str, version: str, window_minutes: int = S.WINDOW_MINUTES
) -> DataFrame:
    """Merge rows into the serving window and publish it; returns the new window."""
    spark = new_rows.sparkSession
    window = read_current(spark, root, S.STATION_STATUS)
    merged = merge_window(window, conform(new_rows, S.STATION_STATUS), window_minutes)
    publish_current(
        merged.sortWithinPartitions(*WINDOW_ORDER), root, S.STATION_STATUS, version
    )
    return read_current(spark, root, S.STATION_STATUS)


def current_stations(serving: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Stations of each system's newest cycle; an older cycle arriving late changes nothing."""
    known = keep_last(
        union_strict(
            serving.withColumn("_source", F.lit(0)),
            conform(new_rows, S.STATIONS).withColumn("_source", F.lit(1)),
        ),
        ["_source", *S.TRACKED_STATION_FIELDS],
    ).drop("_source")
    newest = known.groupBy("system_id").agg(F.max("observed_at").alias("observed_at"))
    return known.join(newest, ["system_id", "observed_at"], "left_semi")


@dataclass(frozen=True)
class StagedCycle:
    station_status_rows: int
    stations_rows: int
    window_rows: int
    window_span_seconds: float | None


def stage_cycle(
    status: DataFrame, stations: DataFrame, root: str, version: str
) -> StagedCycle | None:
    """Stage cycles: durable snapshots, then current stations, then the window.

    Nothing is written when there are no status rows.
    """
    if status.isEmpty():
        return None
    status_rows = write_snapshots(status, root, S.STATION_STATUS)
    stations_rows = write_snapshots(stations, root, S.STATIONS)
    publish_current(
        current_stations(read_current(status.sparkSession, root, S.STATIONS), stations),
        root,
        S.STATIONS,
        version,
    )
    window = update_window(status, root, version)
    extent = window.agg(
        F.count("*").alias("rows"),
        (F.unix_micros(F.max("observed_at")) - F.unix_micros(F.min("observed_at"))).alias("us"),
    ).first()
    return StagedCycle(
        station_status_rows=status_rows,
        stations_rows=stations_rows,
        window_rows=extent.rows,
        window_span_seconds=None if extent.us is None else extent.us / 1e6,
    )


# --- day archive -----------------------------------------------------------


def archive_form(df: DataFrame, table: str) -> DataFrame:
    """Rows as archived: stations as a change log per day, status whole."""
    rows = conform(df, table)
    return collapse_changes(rows) if table == S.STATIONS else rows


def write_archive_days(
    df: DataFrame, archive: str, table: str, audits: Sequence[days_of.Audit] = ()
) -> dict[dt.date, int]:
    """Publish whole days of a table; rows per day. See ``archive.publish_days``."""
    return days_of.publish_days(df, f"{archive}/{table}", table, audits)


def export_staged_days(
    spark: SparkSession, root: str, archive: str, days: Sequence[dt.date]
) -> dict[str, dict[dt.date, int]]:
    """Export the given staged days of both tables, all days of a table in one job.

    The status table is last: its archived days are what says that a day is exported.
    """
    totals = {}
    for table in reversed(S.ARCHIVED_TABLES):
        staged = read_staged(spark, root, table).where(F.col("date").isin(list(days)))
        totals[table] = write_archive_days(archive_form(staged, table), archive, table)
    return totals


def export_table_days(
    df: DataFrame, archive: str, table: str, days: Sequence[dt.date]
) -> dict[dt.date, int]:
    """Export days of a table that is not staged, as they are."""
    rows = conform(df, table)
    wanted = rows.where(utc_day("observed_at").isin(list(days)))
    return write_archive_days(wanted, archive, table)


def archived_days(spark: SparkSession, archive: str, table: str = S.STATION_STATUS) -> DataFrame:
    """Days the archive holds, from its manifest; none when there is no archive."""
    manifest = days_of.read_manifest(spark, f"{archive}/{table}")
    return storage.day_frame(spark, sorted(manifest.days))


def staged_days_of(spark: SparkSession, root: str) -> DataFrame:
    """Days staged for the status table, which drives what is exported."""
    listed = storage.partition_days(spark, staged_path(root, S.STATION_STATUS))
    return storage.day_frame(spark, listed)


def publish(
    spark: SparkSession,
    root: str,
    archive: str,
    *,
    today: dt.date,
    start: dt.date | None = None,
    day: dt.date | None = None,
    backfill: bool = False,
) -> dict[str, dict[dt.date, int]]:
    """Export every complete staged day the archive lacks (or one day, or all of them)."""
    plan = plan_export(
        staged_days_of(spark, root),
        archived_days(spark, archive),
        today=today,
        start=start,
        day=day,
        backfill=backfill,
    )
    # one row per calendar day
    days = [row.day for row in plan.orderBy("day").collect()]
    if not days:
        return {}
    return export_staged_days(spark, root, archive, days)


# --- retention -------------------------------------------------------------


def delete_staged_day(spark: SparkSession, root: str, table: str, day: dt.date) -> int:
    """Remove a staged table-day; number of objects removed, 0 when there was none."""
    path = f"{staged_path(root, table)}/date={day.isoformat()}"
    objects = len(storage.data_files(spark, path))
    storage.delete(spark, path)
    return objects


def trim_staged_days(spark: SparkSession, root: str, days: Sequence[dt.date]) -> int:
    return sum(
        delete_staged_day(spark, root, table, day) for day in days for table in S.ARCHIVED_TABLES
    )


def _safe_days(
    present: DataFrame, archived: DataFrame, today: dt.date, keep_days: int
) -> list[dt.date]:
    safe = days_safe_to_trim(present, archived, today=today, keep_days=keep_days)
    # one row per calendar day
    return [row.day for row in safe.orderBy("day").collect()]


def apply_staged_retention(
    spark: SparkSession, root: str, archive: str, *, today: dt.date, keep_days: int | None
) -> int:
    """Trim staged days the archive is confirmed to hold; nothing when ``keep_days`` is unset."""
    if keep_days is None:
        return 0
    days = _safe_days(
        staged_days_of(spark, root), archived_days(spark, archive), today, keep_days
    )
    return trim_staged_days(spark, root, days)


def trim_table_days(spark: SparkSession, path: str, days: Sequence[dt.date]) -> int:
    """Drop whole days of a day-partitioned status table; number of rows dropped."""
    if not days:
        return 0
    table = spark.read.schema(S.STATUS_SCHEMA).parquet(path)
    rows = table.where(F.col("date").isin(list(days))).count()
    for day in days:
        storage.delete(spark, f"{path}/date={day.isoformat()}")
    return rows


def apply_table_retention(
    spark: SparkSession, path: str, archive: str, *, today: dt.date, keep_days: int | None
) -> int:
    """The same for a live status table; the stations change log is never trimmed."""
    if keep_days is None:
        return 0
    present = storage.day_frame(spark, storage.partition_days(spark, path))
    days = _safe_days(present, archived_days(spark, archive), today, keep_days)
    return trim_table_days(spark, path, days)


def partition_sizes(
    spark: SparkSession, path: str, table: str = S.STATION_STATUS
) -> DataFrame:
    """Per day: rows, files, bytes and bytes per row; of an archive, of the published days."""
    file = F.col("_metadata.file_path").alias("file")
    size = F.col("_metadata.file_size").alias("size")
    if days_of.has_manifest(spark, path):
        parts = days_of.scan(spark, path, table, file, size)
    else:
        parts = spark.read.parquet(path).select("date", file, size)
    files = parts.groupBy("date", "file").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    return (
        files.groupBy("date")
        .agg(F.sum("n").alias("rows"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
        .withColumn("bytes_per_row", F.col("bytes") / F.col("rows"))
    )

