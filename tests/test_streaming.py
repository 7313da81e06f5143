import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from rows import at
from feed_fixtures import cycle, write_bundle
from stationflow import schemas as S
from stationflow.sources import sinks, tables
from stationflow.streaming.ingest import start_ingest

START = at(2026, 9, 10, 10)


def stamp(minutes):
    return (START + dt.timedelta(minutes=minutes)).strftime("%Y%m%dT%H%M%SZ")


def feeds(vehicles, capacity=20):
    out = cycle()
    out["station_status"]["data"]["stations"][0]["num_vehicles_available"] = vehicles
    out["station_information"]["data"]["stations"][0]["capacity"] = capacity
    return out


def run(spark, landing, root):
    query = start_ingest(
        spark, str(landing), str(root), str(root) + "-checkpoint", once=True,
        now=lambda: at(2026, 9, 10, 12, 30),
    )
    query.awaitTermination(300)
    assert query.exception() is None


def window(spark, root):
    rows = sinks.read_current(spark, str(root), S.STATION_STATUS).orderBy("observed_at").collect()
    return [r.num_vehicles_available for r in rows]


def test_cycles_replays_gaps_and_bad_cycles(spark, tmp_path):
    landing, root = tmp_path / "landing", tmp_path / "root"
    landing.mkdir()
    for i in range(3):
        write_bundle(landing, stamp(5 * i), feeds(i))
    bad = feeds(1)
    bad["station_status"]["data"]["stations"] = []
    write_bundle(landing, stamp(15), bad)
    run(spark, landing, root)
    assert window(spark, root) == [0, 1, 2]
    log = spark.read.parquet(f"{root}/ingestion_runs")
    assert log.where("status = 'success'").count() == 3
    failed = log.where("status = 'failure'").first()
    assert failed.cycle_id == stamp(15) and "no_rows" in failed.error_message
    ready = spark.read.parquet(f"{root}/readiness").first()
    assert not ready.data_fresh or not ready.history_deep_enough

    features = spark.read.parquet(f"{root}/features").orderBy("observed_at").collect()
    assert [f.lag_5m_vehicles for f in features] == [None, 0, 1]
    assert [f.roll_mean_30m for f in features] == [0.0, 0.5, 1.0]

    # a replay of a cycle with another value: counted once, the last wins
    replay = write_bundle(landing, stamp(10), feeds(9))
    replay.rename(landing / "replayed.json")
    run(spark, landing, root)
    assert window(spark, root) == [0, 1, 9]
    staged = tables.read_staged(spark, str(root), S.STATION_STATUS)
    assert staged.count() == 3

    # a cycle after a gap empties the window, but not the durable snapshots
    write_bundle(landing, stamp(10 + 125), feeds(4, capacity=33))
    run(spark, landing, root)
    assert window(spark, root) == [4]
    assert tables.read_staged(spark, str(root), S.STATION_STATUS).count() == 4

    # a late cycle stays out of the window and does not become the current stations
    write_bundle(landing, stamp(1), feeds(6))
    run(spark, landing, root)
    assert window(spark, root) == [4]
    assert tables.read_staged(spark, str(root), S.STATION_STATUS).count() == 5
    stations = sinks.read_current(spark, str(root), S.STATIONS).collect()
    assert [s.capacity for s in stations] == [33]


@pytest.mark.parametrize("files_per_batch", [1, 100])
def test_a_cycle_landed_twice_counts_as_it_landed_last(spark, tmp_path, files_per_batch):
    landing, root = tmp_path / "landing", tmp_path / "root"
    landing.mkdir()
    for name, vehicles, second in (("b-first", 3, 100), ("a-last", 8, 200)):
        path = write_bundle(landing, stamp(0), feeds(vehicles)).rename(landing / f"{name}.json")
        os.utime(path, (1_788_000_000 + second,) * 2)
    query = start_ingest(
        spark, str(landing), str(root), str(root) + "-checkpoint", once=True,
        files_per_batch=files_per_batch, now=lambda: at(2026, 9, 10, 12, 30),
    )
    query.awaitTermination(300)
    assert query.exception() is None
    assert window(spark, root) == [8]
    log = spark.read.parquet(f"{root}/ingestion_runs")
    assert log.where("status = 'failure'").count() == 0


def test_running_a_batch_twice_changes_nothing(spark, tmp_path):
    from stationflow.sources.feeds import BUNDLE_SCHEMA, from_bundles
    from stationflow.streaming.ingest import ingest_batch

    write_bundle(tmp_path, stamp(0), feeds(3))
    batch = from_bundles(spark.read.schema(BUNDLE_SCHEMA).json(str(tmp_path / "*.json")))
    root = str(tmp_path / "root")
    first = ingest_batch(batch, 0, root)
    again = ingest_batch(batch, 0, root)
    assert first == again and first.window_rows == 1 and first.window_span_seconds == 0
    assert spark.read.parquet(f"{root}/ingestion_runs").count() == 1
    assert tables.read_staged(spark, root, S.STATION_STATUS).count() == 1


def test_no_valid_cycle_stages_nothing(spark, tmp_path):
    from stationflow.sources import storage

    landing, root = tmp_path / "landing", tmp_path / "root"
    landing.mkdir()
    broken = feeds(1)
    broken["vehicle_types"] = "[]"
    write_bundle(landing, stamp(0), broken)
    run(spark, landing, root)
    assert window(spark, root) == []
    assert not storage.exists(spark, f"{root}/snapshots")
    assert spark.read.parquet(f"{root}/quarantine").where(F.col("rule") == "object").count() == 1
