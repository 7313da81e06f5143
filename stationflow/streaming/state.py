"""Features of a stream of status rows, from state that holds the recent rows of every station.

State is kept per system, station and time bucket (buckets with copied edges, as the batch features
use them), so a busy station is spread over its buckets and every bucket's state is complete for the
rows it is home to. A micro-batch touches the buckets of its own rows only. A row that is new, late
or replayed with other values changes the features of the rows up to the reach after it; the state
returns these rows and the rows they look back on, and the batch operator computes the features, so
stream and batch cannot differ. A bucket's state goes when the watermark has passed its end: no row
of it can arrive any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from stationflow import schemas as S
from stationflow.functions.clock import micros
from stationflow.operators.buckets import BUCKET, HOME, bucket_width, with_buckets
from stationflow.operators.newest import keep_last
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec, compute_features
from stationflow.sources import storage
from stationflow.sources.tables import staged_path

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long after newer rows a row may still arrive.
LATENESS_MINUTES = S.WINDOW_MINUTES

_VALUES = tuple(c for c in S.RAW_COLUMNS if c not in S.IDENTITY)
_VALUE_TYPES = "struct<" + ", ".join(
    f"{c}: {S.STATUS_SCHEMA[c].dataType.simpleString()}" for c in _VALUES
) + ">"
_HELD = "times array<bigint>, arrived array<bigint>, rows array<string>"
_RETURNED = "system_id string, station_id string, us bigint, changed boolean, row string"


class RecentRows(StatefulProcessor):
    """The rows of a station's bucket; returns those whose features changed and what they look at."""

    def __init__(self, reach_us: int, width_us: int):
        self.reach_us, self.width_us = reach_us, width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", _HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        system, station, bucket = key
        held: dict[int, tuple[int, str]] = {}
        known = self.held.get()
        if known is not None:
            held = dict(zip(known[0], zip(known[1], known[2])))
        else:
            self.handle.registerTimer((int(bucket) + 1) * self.width_us // 1000)
        changed, newer = set(), False
        for part in rows:
            for us, arrived, row in zip(part["us"].tolist(), part["arrived"].tolist(), part["row"].tolist()):
                before = held.get(us)
                if before is not None and before >= (arrived, row):
                    continue  # an older arrival, or the same again
                held[us], newer = (arrived, row), True
                if before is None or before[1] != row:
                    changed.add(us)
        times = sorted(held)
        if newer:
            self.held.update(
                (times, [held[t][0] for t in times], [held[t][1] for t in times])
            )
        if changed:
            yield self._affected(system, station, int(bucket), times, held, sorted(changed))

    def _affected(self, system, station, bucket: int, times, held, changed: list[int]) -> pd.DataFrame:
        """Rows home to the bucket within reach after a change, and the rows within reach before."""
        at, last, touched = 0, None, []
        for t in times:
            while at < len(changed) and changed[at] <= t:
                last, at = changed[at], at + 1
            touched.append(
                last is not None and t - last <= self.reach_us and t // self.width_us == bucket
            )
        wanted, until = [], None
        for t, hit in zip(reversed(times), reversed(touched)):
            if hit:
                until = t - self.reach_us
            wanted.append(until is not None and t >= until)
        kept = [(t, hit) for t, hit, want in zip(times, touched, reversed(wanted)) if want]
        return pd.DataFrame({
            "system_id": system,
            "station_id": station,
            "us": pd.Series([t for t, _ in kept], dtype="int64"),
            "changed": pd.Series([hit for _, hit in kept], dtype="bool"),
            "row": pd.Series([held[t][1] for t, _ in kept], dtype="object"),
        })

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def changed_rows(
    status: DataFrame, spec: FeatureSpec = DEFAULT_SPEC, lateness_minutes: int = LATENESS_MINUTES
) -> DataFrame:
    """Of a stream of status rows: rows whose features changed, with those they look back on.

    ``status`` has ``RAW_COLUMNS`` and a sortable bigint ``arrived``: of rows of one identity the last
    arrival counts, however they fall into micro-batches. Rows older than the watermark are left out.
    """
    spark = status.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STATE_STORE:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {STATE_STORE}")
    width = spec.bucket_us or bucket_width(spec.reach_us)
    rows = status.withWatermark("observed_at", f"{lateness_minutes} minutes").select(
        "system_id", "station_id", "observed_at", micros("observed_at").alias("us"), "arrived",
        F.to_json(F.struct(*_VALUES)).alias("row"),
    )
    spread = with_buckets(rows, F.col("us"), back_us=spec.reach_us, width_us=width).drop(HOME)
    return spread.groupBy("system_id", "station_id", BUCKET).transformWithStateInPandas(
        RecentRows(spec.reach_us, width), _RETURNED, "Update", "EventTime"
    )


def features_of_changes(
    returned: DataFrame, stations: DataFrame, spec: FeatureSpec = DEFAULT_SPEC
) -> DataFrame:
    """Features of the changed rows of a micro-batch, by the batch operator.

    A row near a bucket's edge may be returned by both buckets, with the same values.
    """
    once = returned.groupBy("system_id", "station_id", "us").agg(
        F.max("changed").alias("changed"), F.max("row").alias("row")
    )
    rows = once.select(
        "system_id", "station_id", F.timestamp_micros("us").alias("observed_at"), "changed",
        F.from_json("row", _VALUE_TYPES).alias("row"),
    ).select("system_id", "station_id", "observed_at", "row.*", "changed")
    features = compute_features(
        rows.select(*S.RAW_COLUMNS), stations.select(*S.STATION_KEY, "capacity"), spec
    )
    changed = rows.where("changed").select(*S.IDENTITY)
    return features.join(changed, list(S.IDENTITY), "left_semi")


def read_snapshot_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """Staged status snapshots as they are written; a replayed cycle's file comes again.

    A file that a replay replaced before it was read is passed over: its successor follows.
    """
    schema = T.StructType(list(S.STATUS_SCHEMA)).add("date", T.DateType()).add("cycle", T.StringType())
    stream = (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .option("ignoreMissingFiles", "true")
        .parquet(staged_path(root, S.STATION_STATUS))
    )
    arrived = F.unix_micros("_metadata.file_modification_time").alias("arrived")
    return stream.select(*S.RAW_COLUMNS, arrived)


def start_features(
    status: DataFrame,
    stations: DataFrame,
    output: str,
    checkpoint: str,
    *,
    spec: FeatureSpec = DEFAULT_SPEC,
    lateness_minutes: int = LATENESS_MINUTES,
    once: bool = False,
) -> StreamingQuery:
    """Write the features of every micro-batch's changed rows to ``output/batch=<id>``.

    A batch that runs again replaces its folder, so nothing is written twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist()
        try:
            features_of_changes(kept, stations, spec).write.mode("overwrite").parquet(
                f"{output}/batch={batch_id}"
            )
        finally:
            kept.unpersist()

    writer = (
        changed_rows(status, spec, lateness_minutes)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
    )
    if once:
        writer = writer.trigger(availableNow=True)
    else:
        writer = writer.trigger(processingTime=f"{S.CYCLE_SECONDS} seconds")
    return writer.foreachBatch(write).start()


def read_features(spark: SparkSession, output: str) -> DataFrame:
    """The last features of every row: those of the newest batch that changed them."""
    if not storage.children(spark, output):
        raise ValueError(f"no features under {output}")
    return keep_last(spark.read.parquet(output), ["batch"]).drop("batch")
