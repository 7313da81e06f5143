"""Session settings every job shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # Instants are stored and compared in UTC; days are UTC days.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Rewriting one day must leave the other days of a table alone.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def apply_settings(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings on a session somebody else created."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "stationflow", **overrides: str) -> SparkSession:
    """A session with the shared settings; master and sizes come from the launcher."""
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SETTINGS, **overrides}.items():
        builder = builder.config(key, value)
    return apply_settings(builder.getOrCreate())


def require_utc(spark: SparkSession) -> None:
    """Zone-less timestamps mean UTC, which holds only under a UTC session."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"session time zone must be UTC, got {zone}")


_LOCAL: list[tempfile.TemporaryDirectory] = []


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; one is made only where none is named."""
    context = spark.sparkContext
    named = context.getCheckpointDir()
    if named is not None:
        return named
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        # one machine only; the folder goes when this process ends
        _LOCAL.append(tempfile.TemporaryDirectory(prefix="stationflow-checkpoint-"))
        shared = _LOCAL[-1].name
    context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def scratch_folder(spark: SparkSession) -> str:
    """A new folder on shared storage, for whoever asks to delete when done."""
    return f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"


def settle(df: DataFrame, folder: str | None = None) -> DataFrame:
    """Compute a frame once, into a table on shared storage, for the reads that follow.

    Unlike a checkpoint, the table is columnar: later reads prune columns and rows. Without
    a ``folder`` it stays in the checkpoint folder, as a checkpoint would.
    """
    path = f"{folder or scratch_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settle_in_order(df: DataFrame) -> DataFrame:
    """Compute a sorted frame once, keeping its partitions and their order."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
