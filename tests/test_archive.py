import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rows import at
from stationflow import schemas as S
from stationflow.operators import changes, contract, days, recent
from stationflow.sources import archive, sinks, storage, tables

D = dt.date


def status_rows(spark, points):
    """Rows from (time, station, vehicles)."""
    return contract.conform(
        spark.createDataFrame(
            [("toronto", s, t, v, None, 20 - v, None, True, True, True, None, None) for t, s, v in points],
            S.STATUS_SCHEMA,
        ),
        S.STATION_STATUS,
    )


def station_rows(spark, points):
    """Rows from (time, station, capacity)."""
    return spark.createDataFrame(
        [("toronto", s, f"Name {s}", None, 43.6, -79.4, c, None, t) for t, s, c in points],
        S.STATIONS_SCHEMA,
    )


@pytest.fixture()
def status(spark):
    return status_rows(
        spark,
        [(at(2026, 9, 4, 0), "a", 5), (at(2026, 9, 4, 12), "a", 7), (at(2026, 9, 4, 12), "b", 2),
         (at(2026, 9, 6, 3), "a", 9)],
    )


def day_frame(spark, *found):
    return spark.createDataFrame([(d,) for d in found], "day date")


def listed(df, column="day"):
    return sorted(row[column] for row in df.collect())


def staged_day(spark, root, change_at=None):
    """Six cycles of two stations on one day."""
    start = at(2026, 9, 10, 8)
    times = [start + dt.timedelta(minutes=5 * i) for i in range(6)]
    status = [(t, s, i) for i, t in enumerate(times) for s in "ab"]
    stations = [
        (t, s, 33 if change_at is not None and s == "a" and i >= change_at else 20)
        for i, t in enumerate(times)
        for s in "ab"
    ]
    sinks.write_snapshots(status_rows(spark, status), root, S.STATION_STATUS)
    sinks.write_snapshots(station_rows(spark, stations), root, S.STATIONS)
    return D(2026, 9, 10)


def test_export_writes_days_and_only_those(spark, status, tmp_path):
    archive = str(tmp_path)
    written = sinks.export_table_days(
        status, archive, S.STATION_STATUS, [D(2026, 9, 4), D(2026, 9, 5)]
    )
    assert written == {D(2026, 9, 4): 3}
    assert listed(sinks.archived_days(spark, archive)) == [D(2026, 9, 4)]
    sinks.export_table_days(status, archive, S.STATION_STATUS, [D(2026, 9, 6)])
    again = sinks.export_table_days(status, archive, S.STATION_STATUS, [D(2026, 9, 4)])
    assert again == {D(2026, 9, 4): 3}
    stored = tables.read_table(spark, f"{archive}/{S.STATION_STATUS}", S.STATION_STATUS)
    assert stored.count() == 4
    history = tables.status_history(stored, "toronto").collect()
    assert [r.station_id for r in history] == ["a", "a", "a", "b"]
    assert tables.status_history(stored, "elsewhere").count() == 0
    sizes = sinks.partition_sizes(spark, f"{archive}/{S.STATION_STATUS}")
    assert {r.rows for r in sizes.collect()} == {1, 3}
    assert sizes.where("bytes_per_row <= 0").count() == 0


def scan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned(spark, status, tmp_path):
    archive, root = str(tmp_path / "archive"), str(tmp_path / "root")
    sinks.export_table_days(status, archive, S.STATION_STATUS, [D(2026, 9, 4), D(2026, 9, 6)])
    table = tables.read_table(spark, f"{archive}/{S.STATION_STATUS}", S.STATION_STATUS)
    plan = scan_of(tables.status_history(table, "toronto", since=at(2026, 9, 6), ordered=False))
    assert "PushedFilters: [IsNotNull(system_id), IsNotNull(observed_at), EqualTo(system_id,toronto)" in plan
    assert "PartitionFilters: [isnotnull(date" in plan and "is_returning" in plan
    assert "num_vehicles_electric" not in plan
    assert tables.status_history(table, "toronto", since=at(2026, 9, 6)).count() == 1
    one = tables.day_rows(table, D(2026, 9, 4))
    assert "PartitionFilters: [isnotnull(date" in scan_of(one) and one.count() == 3
    day = staged_day(spark, root)
    assert "PartitionFilters: [isnotnull(date" in scan_of(
        tables.read_staged_day(spark, root, S.STATIONS, day)
    )


def test_exported_files_are_compressed(spark, status, tmp_path):
    import pyarrow.parquet as pq

    sinks.export_table_days(status, str(tmp_path), S.STATION_STATUS, [D(2026, 9, 4)])
    name = storage.data_files(spark, str(tmp_path))[0].removeprefix("file:")
    group = pq.ParquetFile(name).metadata.row_group(0)
    assert group.column(0).compression == "ZSTD"


def test_old_files_read_with_nulls(spark, status, tmp_path):
    path = f"{tmp_path}/t"
    old = status.drop("num_vehicles_electric", "num_vehicles_human")
    old.withColumn("date", F.to_date("observed_at")).write.partitionBy("date").parquet(path)
    table = tables.read_table(spark, path, S.STATION_STATUS)
    assert table.where("num_vehicles_electric is not null").count() == 0
    with pytest.raises(ValueError, match="num_vehicles_electric"):
        tables.read_table(spark, path, S.STATION_STATUS, strict=True)


def test_collapse(spark, tmp_path):
    root = str(tmp_path)
    day = staged_day(spark, root, change_at=3)
    rows = tables.read_staged_day(spark, root, S.STATIONS, day)
    collapsed = changes.collapse_changes(rows)
    got = [(r.station_id, r.capacity) for r in collapsed.orderBy("station_id", "observed_at").collect()]
    assert got == [("a", 20), ("a", 33), ("b", 20)]
    shuffled = rows.orderBy(F.rand(3)).repartition(3)
    assert changes.collapse_changes(shuffled).exceptAll(collapsed).count() == 0
    assert changes.collapse_changes(collapsed).exceptAll(collapsed).count() == 0
    assert changes.collapse_changes(collapsed).count() == 3


@pytest.mark.parametrize("bucket_us", [changes.CARRY_US, 3600 * 10**6])
def test_collapse_matches_brute_force_over_gaps(spark, bucket_us):
    """States carried over empty hours and reset at midnight, one busy station."""
    rng = random.Random(11)
    points = []
    for station, n in (("hot", 600), ("cold", 20)):
        for minute in sorted(rng.sample(range(3 * 24 * 60), n)):
            time = at(2026, 9, 1) + dt.timedelta(minutes=minute, seconds=rng.random() * 50)
            points.append((time, station, rng.choice([10, 10, 10, 20, None])))
    expected, last = set(), {}
    for time, station, capacity in sorted(points, key=lambda p: (p[1], p[0])):
        key = (station, time.date())
        if key not in last or last[key] != capacity:
            expected.add((station, time))
        last[key] = capacity
    out = changes.collapse_changes(station_rows(spark, points), bucket_us=bucket_us).collect()
    assert {(r.station_id, r.observed_at.replace(tzinfo=dt.timezone.utc)) for r in out} == expected


def test_publish_then_retain(spark, tmp_path):
    root, archive = str(tmp_path / "root"), str(tmp_path / "archive")
    day = staged_day(spark, root)
    today = D(2026, 9, 14)
    assert len(tables.staged_keys_for_day(spark, root, S.STATION_STATUS, day)) == 6
    # nothing archived: nothing trimmed
    assert sinks.apply_staged_retention(spark, root, archive, today=today, keep_days=1) == 0
    totals = sinks.publish(spark, root, archive, today=today)
    assert totals == {S.STATION_STATUS: {day: 12}, S.STATIONS: {day: 2}}
    assert sinks.publish(spark, root, archive, today=today) == {}
    assert sinks.publish(spark, root, archive, today=today, backfill=True) == totals
    assert sinks.apply_staged_retention(spark, root, archive, today=today, keep_days=None) == 0
    assert sinks.apply_staged_retention(spark, root, archive, today=today, keep_days=4) == 0
    assert sinks.apply_staged_retention(spark, root, archive, today=today, keep_days=1) == 12
    assert listed(sinks.staged_days_of(spark, root)) == []
    assert sinks.delete_staged_day(spark, root, S.STATIONS, day) == 0
    assert tables.read_staged_day(spark, root, S.STATIONS, day).count() == 0


def test_table_retention_keeps_unpublished_days(spark, tmp_path):
    live, archive = str(tmp_path / "live"), str(tmp_path / "archive")
    rows = status_rows(
        spark, [(at(2026, 9, d, h), "a", 1) for d in (4, 5, 6, 7) for h in (0, 12)]
    )
    sinks.write_parquet(rows.withColumn("date", F.to_date("observed_at")), live, ("date",))
    sinks.export_table_days(rows, archive, S.STATION_STATUS, [D(2026, 9, 4), D(2026, 9, 6)])
    removed = sinks.apply_table_retention(
        spark, live, archive, today=D(2026, 9, 7), keep_days=1
    )
    assert removed == 2
    assert storage.partition_days(spark, live) == [D(2026, 9, 5), D(2026, 9, 6), D(2026, 9, 7)]


def test_replayed_cycle_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    for vehicles in (1, 2):
        rows = status_rows(spark, [(at(2026, 9, 10, 8), "a", vehicles)])
        sinks.write_snapshots(rows, root, S.STATION_STATUS)
    stored = tables.read_staged(spark, root, S.STATION_STATUS).collect()
    assert [r.num_vehicles_available for r in stored] == [2]
    assert stored[0].cycle == "20260910T080000Z"


def test_window_keeps_two_hours(spark, tmp_path):
    root, start = str(tmp_path), at(2026, 9, 10, 8)
    cycles = [(start + dt.timedelta(minutes=5 * i), "a", i) for i in range(24)]
    sinks.update_window(status_rows(spark, cycles), root, "1")
    late = [(start + dt.timedelta(minutes=125), "a", 0)]
    out = sinks.update_window(status_rows(spark, late), root, "2")
    assert out.agg(F.min("observed_at")).first()[0] == dt.datetime(2026, 9, 10, 8, 5)
    assert recent.covers_lookback(out).first().covered
    assert not recent.covers_lookback(out.limit(0)).first().covered
    sinks.update_window(status_rows(spark, late), root, "3")
    assert "v=1" not in storage.children(spark, f"{root}/serving/{S.STATION_STATUS}")


def test_serving_table_missing_or_corrupt(spark, tmp_path):
    missing = tables.read_serving(spark, str(tmp_path / "nothing"), S.STATIONS)
    assert missing.count() == 0 and missing.schema == S.STATIONS_SCHEMA
    broken = tmp_path / "broken"
    broken.mkdir()
    (broken / "part-0.parquet").write_bytes(b"this is not parquet")
    assert tables.read_serving(spark, str(broken), S.STATIONS).count() == 0
    # one bad part among several: all or nothing, never a part
    points = [(at(2026, 9, 10), f"s{i}", i) for i in range(40)]
    several = str(tmp_path / "several")
    status_rows(spark, points).repartition(4).write.parquet(several)
    assert tables.read_serving(spark, several, S.STATION_STATUS).count() == 40
    (tmp_path / "several" / "part-9.parquet").write_bytes(b"PAR1 damaged PAR1")
    assert tables.read_serving(spark, several, S.STATION_STATUS).count() == 0


def test_small_files_are_plain_and_replaced_whole(spark, tmp_path):
    from stationflow.sources import storage

    path, text = str(tmp_path / "new" / "metadata.json"), json.dumps({"é": "x" * 100_000})
    storage.write_text(spark, path, "old")
    storage.write_text(spark, path, text)
    assert json.loads((tmp_path / "new" / "metadata.json").read_bytes()) == json.loads(text)
    assert storage.read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "new").iterdir() if not p.name.startswith(".")] == [
        "metadata.json"
    ]


@pytest.mark.parametrize(
    "present, archived, start, expected",
    [
        ((3, 4, 5), (3, 5), None, [4]),
        ((3, 4, 5, 6), (), None, [3, 4, 5]),
        ((3, 4, 5), (), 4, [4, 5]),
        ((), (3,), None, []),
    ],
)
def test_days_needing_export(spark, present, archived, start, expected):
    out = days.days_needing_export(
        day_frame(spark, *[D(2026, 9, d) for d in present]),
        day_frame(spark, *[D(2026, 9, d) for d in archived]),
        today=D(2026, 9, 6),
        start=start and D(2026, 9, start),
    )
    assert [d.day for d in listed(out)] == expected


def test_days_safe_to_trim(spark):
    present = day_frame(spark, *[D(2026, 9, d) for d in (3, 4, 5, 6)])
    archived = day_frame(spark, D(2026, 9, 3), D(2026, 9, 5), D(2026, 9, 6))
    out = days.days_safe_to_trim(present, archived, today=D(2026, 9, 7), keep_days=1)
    assert listed(out) == [D(2026, 9, 3), D(2026, 9, 5)]
    with pytest.raises(ValueError, match="negative"):
        days.days_safe_to_trim(present, archived, today=D(2026, 9, 7), keep_days=-1)


def test_single_day_plan(spark):
    present = day_frame(spark, D(2026, 9, 3))
    plan = days.plan_export(present, present, today=D(2026, 9, 6), day=D(2026, 9, 5))
    assert listed(plan) == [D(2026, 9, 5)]


def test_status_without_stations_is_published(spark, tmp_path):
    root, archive = str(tmp_path / "root"), str(tmp_path / "archive")
    assert sinks.publish(spark, root, archive, today=D(2026, 10, 1)) == {}
    sinks.write_snapshots(status_rows(spark, [(at(2026, 9, 1), "a", 1)]), root, S.STATION_STATUS)
    written = sinks.publish(spark, root, archive, today=D(2026, 10, 1))
    assert written == {S.STATION_STATUS: {D(2026, 9, 1): 1}, S.STATIONS: {}}


# --- write, audit, publish ---------------------------------------------------


def table_of(spark, path):
    rows = archive.read(spark, path, S.STATION_STATUS).orderBy("observed_at", "station_id").collect()
    return [(r.observed_at.day, r.station_id, r.num_vehicles_available) for r in rows]


def test_a_failed_audit_leaves_the_old_day(spark, status, tmp_path, monkeypatch):
    path = str(tmp_path / S.STATION_STATUS)
    archive.publish_days(status, path, S.STATION_STATUS)
    before = table_of(spark, path)
    worse = status.withColumn("num_vehicles_available", F.lit(0).cast("bigint"))

    def negative(rows):
        return ["no vehicles at all"] if rows.where("num_vehicles_available > 0").isEmpty() else []

    with pytest.raises(archive.AuditError, match="no vehicles"):
        archive.publish_days(worse, path, S.STATION_STATUS, [negative])
    write = sinks.write_parquet

    def lossy(df, target, partition_by=()):
        return write(df.where("station_id <> 'b'"), target, partition_by)

    def altered(df, target, partition_by=()):
        return write(df.withColumn("num_docks_available", F.lit(1).cast("bigint")), target, partition_by)

    def misplaced(df, target, partition_by=()):
        return write(df.withColumn("date", F.date_add("date", 1)), target, partition_by)

    for damage, message in ((lossy, "rows: stored 3, expected 4"), (altered, "checksum"), (misplaced, "other days")):
        monkeypatch.setattr(sinks, "write_parquet", damage)
        with pytest.raises(archive.AuditError, match=message):
            archive.publish_days(status, path, S.STATION_STATUS)
    assert table_of(spark, path) == before and archive.read_manifest(spark, path).number == 1
    # nothing is left of the failed versions
    assert len(storage.children(spark, f"{path}/_versions")) == 1


def test_a_task_observed_twice_is_no_damage(spark, status, tmp_path, monkeypatch):
    from pyspark.sql import Observation as RealObservation

    observe = type(status).observe
    held = {}

    def doubled(df, observation, *columns):
        if observation is not None:
            return observe(df, observation, *columns)
        held["real"] = RealObservation()
        return observe(df, held["real"], *columns)

    class Proxy:
        @property
        def get(self):
            return {**held["real"].get, "rows": 2 * held["real"].get["rows"]}

    proxy = Proxy()
    monkeypatch.setattr(archive, "Observation", lambda: proxy)
    monkeypatch.setattr(
        type(status), "observe",
        lambda df, o, *c: doubled(df, None if o is proxy else o, *c),
    )
    path = str(tmp_path / S.STATION_STATUS)
    assert archive.publish_days(status, path, S.STATION_STATUS) == {D(2026, 9, 4): 3, D(2026, 9, 6): 1}


def test_replays_replace_and_clean_up(spark, status, tmp_path):
    path = str(tmp_path / S.STATION_STATUS)
    for times in (1, 2, 3):
        rows = status.withColumn("num_vehicles_available", F.col("num_vehicles_available") * times)
        only = rows.where("day(observed_at) = 4") if times > 1 else rows
        archive.publish_days(only, path, S.STATION_STATUS)
    assert table_of(spark, path) == [(4, "a", 15), (4, "a", 21), (4, "b", 6), (6, "a", 9)]
    assert sorted(storage.children(spark, f"{path}/_manifests"))[-1] == "000000000003.json"
    held = archive.read(spark, path, S.STATION_STATUS)  # a reader of this state
    assert archive.clean(spark, path) == 1
    assert archive.clean(spark, path) == 0
    assert held.count() == 4 and table_of(spark, path)[0] == (4, "a", 15)
    assert len(storage.children(spark, f"{path}/_versions")) == 3
    found = archive.manifest_rows(spark, path).orderBy("day").collect()
    assert [(r.day, r.rows, r.newest) for r in found] == [
        (D(2026, 9, 4), 3, dt.datetime(2026, 9, 4, 12)), (D(2026, 9, 6), 1, dt.datetime(2026, 9, 6, 3))
    ]
    assert archive.publish_days(status.limit(0), path, S.STATION_STATUS) == {}


def test_two_writers(spark, status, tmp_path, monkeypatch):
    path = str(tmp_path / S.STATION_STATUS)
    archive.publish_days(status, path, S.STATION_STATUS)
    commit = archive.commit

    def meanwhile(rows):
        """Another writer publishes between this one's audit and its commit."""
        def hooked(*args):
            monkeypatch.setattr(archive, "commit", commit)
            archive.publish_days(rows, path, S.STATION_STATUS)
            return commit(*args)
        monkeypatch.setattr(archive, "commit", hooked)

    more = status.withColumn("num_vehicles_available", F.col("num_vehicles_available") + 100)
    fourth, sixth = more.where("day(observed_at) = 4"), more.where("day(observed_at) = 6")
    meanwhile(sixth)  # another day: both are kept
    archive.publish_days(fourth, path, S.STATION_STATUS)
    assert [v for *_, v in table_of(spark, path)] == [105, 107, 102, 109]
    meanwhile(status.where("day(observed_at) = 4"))  # the same day: the first one stays
    with pytest.raises(archive.ConflictError, match="2026-09-04"):
        archive.publish_days(fourth, path, S.STATION_STATUS)
    assert [v for *_, v in table_of(spark, path)] == [5, 7, 2, 109]
    # a manifest is never replaced
    number = archive.read_manifest(spark, path).number
    name = f"{path}/_manifests/{number:012d}.json"
    text = storage.read_text(spark, name)
    assert not storage.put_new(spark, name, "other") and storage.read_text(spark, name) == text
    assert not [n for n in storage.children(spark, f"{path}/_manifests") if ".new" in n]


def test_unversioned_days_are_kept_and_adopted(spark, status, tmp_path):
    path = str(tmp_path / S.STATION_STATUS)
    sinks.write_parquet(status.withColumn("date", F.to_date("observed_at")), path, ("date",))
    assert listed(sinks.archived_days(spark, str(tmp_path))) == [D(2026, 9, 4), D(2026, 9, 6)]
    more = status.where("day(observed_at) = 6").withColumn("num_vehicles_available", F.lit(1).cast("bigint"))
    archive.publish_days(more, path, S.STATION_STATUS)
    stored = tables.read_table(spark, path, S.STATION_STATUS)
    assert stored.count() == 4 and tables.read_table(spark, path, S.STATION_STATUS, strict=True).count() == 4
    assert table_of(spark, path)[-1] == (6, "a", 1)
    assert archive.adopt(spark, path, S.STATION_STATUS).days[D(2026, 9, 4)].rows == 3
    assert {r.rows for r in sinks.partition_sizes(spark, path).collect()} == {1, 3}
    assert archive.damaged_days(spark, path, S.STATION_STATUS) == []
    name = storage.data_files(spark, f"{path}/date=2026-09-04")[0]
    storage.delete(spark, name)
    assert archive.damaged_days(spark, path, S.STATION_STATUS) == [D(2026, 9, 4)]


def test_stations_are_published_before_status(spark, tmp_path, monkeypatch):
    root, target = str(tmp_path / "root"), str(tmp_path / "archive")
    day = staged_day(spark, root)
    publish = archive.publish_days

    def failing(df, path, table, audits=()):
        if table == S.STATIONS:
            raise archive.AuditError("stations")
        return publish(df, path, table, audits)

    monkeypatch.setattr(archive, "publish_days", failing)
    with pytest.raises(archive.AuditError):
        sinks.publish(spark, root, target, today=D(2026, 9, 14))
    # the day does not count as archived, so it is neither skipped nor trimmed
    assert sinks.apply_staged_retention(spark, root, target, today=D(2026, 9, 14), keep_days=1) == 0
    monkeypatch.setattr(archive, "publish_days", publish)
    assert sinks.publish(spark, root, target, today=D(2026, 9, 14))[S.STATIONS] == {day: 2}
