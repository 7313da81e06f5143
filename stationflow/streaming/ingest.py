"""Landed cycles as a stream: validate, flatten, stage, report."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stationflow import schemas as S
from stationflow.functions.clock import instant
from stationflow.operators.contract import conform
from stationflow.plans.ingest import cycle_violations, flatten_cycles, landed
from stationflow.plans.monitor import readiness
from stationflow.session import scratch_folder
from stationflow.sources import feeds as G
from stationflow.sources import sinks, storage
from stationflow.streaming.features import batch_features


def read_bundles(spark: SparkSession, landing: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of payload rows; a landed file holds one cycle, one line per feed."""
    lines = (
        spark.readStream.schema(G.BUNDLE_SCHEMA)
        .option("maxFilesPerTrigger", files_per_batch)
        .json(landing)
    )
    return G.from_bundles(lines, arrival=G.FILE_ARRIVAL)


def run_log(
    payloads: DataFrame,
    status: DataFrame,
    violations: DataFrame,
    batch_id: int,
    started_at: dt.datetime,
    finished_at: dt.datetime,
) -> DataFrame:
    """One row per cycle of a batch: success with its rows, or failure with a reason."""
    rows = status.groupBy("observed_at").agg(
        F.min("system_id").alias("system_id"), F.count("*").alias("row_count")
    )
    reasons = violations.groupBy("cycle_id").agg(
        F.min(F.concat_ws(" ", "feed", "rule", "path", "value")).alias("error_message")
    )
    failed = F.col("error_message").isNotNull()
    return conform(
        payloads.select("cycle_id", "observed_at")
        .distinct()
        .join(rows, "observed_at", "left")
        .join(reasons, "cycle_id", "left")
        .select(
            F.lit(batch_id).alias("run_id"),
            "cycle_id",
            "system_id",
            instant(started_at).alias("started_at"),
            instant(finished_at).alias("finished_at"),
            F.when(failed, "failure").otherwise("success").alias("status"),
            F.coalesce("row_count", F.lit(0)).alias("row_count"),
            "error_message",
        ),
        S.RUN_LOG_SCHEMA,
    )


def ingest_batch(
    payloads: DataFrame,
    batch_id: int,
    root: str,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
) -> sinks.StagedCycle | None:
    """Stage one batch of cycles; a bad cycle is logged and leaves the others alone.

    Running a batch again gives the same tables: snapshots are replaced, the window keeps
    the last row per identity, and logs are kept per batch. A feed of a cycle that landed more
    than once counts as it landed last, so the result does not depend on how files are batched.
    """
    started = now()
    spark, payloads = payloads.sparkSession, G.last_arrivals(payloads).persist()
    folder = scratch_folder(spark)
    try:
        held = landed(payloads).settled(folder)
        violations = cycle_violations(held, folder)
        cycles = flatten_cycles(held, violations)
        status = cycles.status.persist()
        version = f"{batch_id:012d}-{uuid.uuid4().hex[:8]}"
        staged = sinks.stage_cycle(status, cycles.stations, root, version)
        violations.write.mode("overwrite").parquet(f"{root}/quarantine/batch={batch_id}")
        log = run_log(payloads, status, violations, batch_id, started, now())
        log.write.mode("overwrite").parquet(f"{root}/ingestion_runs/batch={batch_id}")
        window = sinks.read_current(spark, root, S.STATION_STATUS)
        stations = sinks.read_current(spark, root, S.STATIONS)
        batch_features(window, stations, status).write.mode("overwrite").parquet(
            f"{root}/features/batch={batch_id}"
        )
        readiness(window, instant(now())).write.mode("overwrite").parquet(
            f"{root}/readiness/batch={batch_id}"
        )
        status.unpersist()
        return staged
    finally:
        payloads.unpersist()
        storage.delete(spark, folder)


def start_ingest(
    spark: SparkSession,
    landing: str,
    root: str,
    checkpoint: str,
    *,
    once: bool = False,
    files_per_batch: int = 100,
    now: Callable[[], dt.datetime] = lambda: dt.datetime.now(dt.timezone.utc),
) -> StreamingQuery:
    """Start ingesting: every cycle interval, or (``once``) whatever has landed so far."""
    writer = read_bundles(spark, landing, files_per_batch).writeStream.option(
        "checkpointLocation", checkpoint
    )
    if once:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{S.CYCLE_SECONDS} seconds")

    def stage(batch: DataFrame, batch_id: int) -> None:
        ingest_batch(batch, batch_id, root, now)

    return writer.foreachBatch(stage).start()
