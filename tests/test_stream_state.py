"""Features from streaming state against the batch features of the same rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rows import at
from stationflow import schemas as S
from stationflow.operators.newest import keep_last
from stationflow.plans.features import FeatureSpec, compute_features
from stationflow.streaming import state

START = at(2026, 9, 10)
DDL = (
    "system_id string, station_id string, observed_at timestamp, num_vehicles_available bigint, "
    "num_docks_available bigint, is_installed boolean, is_renting boolean, is_returning boolean, "
    "arrived bigint"
)


@pytest.fixture()
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, state.STATE_STORE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", before)


def row(minute, station="a", vehicles=1, arrived=0, docks=None):
    return ("s", station, START + dt.timedelta(minutes=minute), vehicles, docks, True, None, False, arrived)


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, folder, out, spec, lateness=120, files=1):
    status = (
        spark.readStream.schema(DDL).option("maxFilesPerTrigger", files)
        .option("recursiveFileLookup", "true").parquet(str(folder))
    )
    stations = spark.createDataFrame([("s", "a", 20), ("s", "b", None)], "system_id string, station_id string, capacity bigint")
    query = state.start_features(
        status, stations, str(out), f"{out}-checkpoint", spec=spec, lateness_minutes=lateness, once=True
    )
    query.awaitTermination(600)
    assert query.exception() is None
    return stations, query


def same(spark, found, rows, stations, spec):
    """Streamed features are those of the last arrivals, computed at once."""
    frame = spark.createDataFrame(rows, DDL)
    last = keep_last(frame, ["arrived"]).select(*S.RAW_COLUMNS)
    whole = compute_features(last, stations, spec)
    columns = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in whole.dtypes]
    one, two = found.select(*whole.columns).select(*columns), whole.select(*columns)
    assert one.count() == two.count()
    assert one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


@pytest.mark.parametrize("bucket_minutes", [None, 30])
def test_stream_equals_batch_over_restarts(stateful, tmp_path, bucket_minutes):
    """Late and replayed rows, rows out of order, over three runs from one checkpoint."""
    spark, rng = stateful, random.Random(5)
    spec = FeatureSpec(bucket_us=None if bucket_minutes is None else bucket_minutes * 60 * 10**6)
    landing, out = tmp_path / "landing", tmp_path / "features"
    base = [row(5 * i + rng.random(), s, rng.randint(0, 20), 0, rng.randint(0, 9)) for i in range(60) for s in "ab"]
    late = [r for r in base if rng.random() < 0.2]
    ontime = [r for r in base if r not in late]
    # replays: some with other values, one that arrived earlier and must not win
    replays = [(*r[:3], r[3] + 50, *r[4:8], 5) for r in base[60:90:3]]
    loser = [(*base[100][:3], 99, *base[100][4:8], -1)]
    same_again = [(*base[101][:8], 7)]
    landing.mkdir()
    land(spark, landing, "1", ontime[:50])
    run(spark, landing, out, spec, lateness=600)
    land(spark, landing, "2", ontime[50:])
    land(spark, landing, "3", late)
    run(spark, landing, out, spec, lateness=600)
    land(spark, landing, "4", replays + loser)
    land(spark, landing, "5", same_again)
    stations, _ = run(spark, landing, out, spec, lateness=600)
    everything = base + replays + loser + same_again
    same(spark, state.read_features(spark, str(out)), everything, stations, spec)


def test_batching_does_not_matter_and_only_changes_are_written(stateful, tmp_path):
    spark, spec = stateful, FeatureSpec()
    rows = [row(5 * i, "a", i) for i in range(40)]
    replay = [row(100, "a", 77, arrived=3), row(100, "a", 66, arrived=2)]
    outputs = []
    for files in (1, 10):
        landing, out = tmp_path / f"landing{files}", tmp_path / f"out{files}"
        landing.mkdir()
        for name, part in enumerate((rows[:20], rows[20:], replay[:1], replay[1:])):
            land(spark, landing, str(name), part)
        stations, _ = run(spark, landing, out, spec, lateness=600, files=files)
        outputs.append(state.read_features(spark, str(out)))
        same(spark, outputs[-1], rows + replay, stations, spec)
    written = spark.read.parquet(str(tmp_path / "out1")).groupBy("batch").count().collect()
    # the replay changes its own row and the thirteen within 65 minutes after it
    assert sorted(r["count"] for r in written if r["count"]) == [14, 20, 20]


def test_state_of_passed_buckets_goes(stateful, tmp_path):
    spark, spec = stateful, FeatureSpec(bucket_us=30 * 60 * 10**6)
    landing, out = tmp_path / "landing", tmp_path / "out"
    landing.mkdir()
    sizes = []
    for day in range(4):
        land(spark, landing, str(day), [row(1440 * day + 5 * i, "a", i) for i in range(24)])
        _, query = run(spark, landing, out, spec, lateness=60)
        sizes.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(sizes) <= 2 * sizes[0]
    # a row older than the watermark changes nothing
    before = state.read_features(spark, str(out)).count()
    land(spark, landing, "old", [row(7, "a", 5)])
    run(spark, landing, out, spec, lateness=60)
    assert state.read_features(spark, str(out)).count() == before


def test_staged_snapshots_are_streamed(stateful, tmp_path):
    from stationflow.operators.contract import conform
    from stationflow.sources import sinks

    spark, root, out = stateful, str(tmp_path / "root"), str(tmp_path / "out")
    stations = spark.createDataFrame([("s", "a", 20)], "system_id string, station_id string, capacity bigint")

    def stage(minutes, vehicles):
        rows = [("s", "a", START + dt.timedelta(minutes=m), vehicles, None, 3, None, True, True, True, None, None) for m in minutes]
        sinks.write_snapshots(
            conform(spark.createDataFrame(rows, S.STATUS_SCHEMA), S.STATION_STATUS), root, S.STATION_STATUS
        )
        query = state.start_features(
            state.read_snapshot_stream(spark, root), stations, out, f"{out}-checkpoint", once=True
        )
        query.awaitTermination(300)
        assert query.exception() is None
        return state.read_features(spark, out).orderBy("observed_at").collect()

    stage((0, 5), 4)
    found = stage((5,), 9)  # the second cycle landed again
    assert [(r.num_vehicles_available, r.lag_5m_vehicles) for r in found] == [(4, None), (9, 4)]


def test_needs_a_state_store(spark):
    with pytest.raises(ValueError, match="RocksDB"):
        state.changed_rows(spark.createDataFrame([], DDL))
