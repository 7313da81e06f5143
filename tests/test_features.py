import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rows import at
from stationflow.functions.clock import HOUR_US
from stationflow.operators.asof import asof_join
from stationflow.plans.features import (
    FeatureSpec,
    add_target,
    compute_features,
    labeled_features,
)

EVERY_FIVE = [(5 * i, 10 + i) for i in range(8)]


def by_minute(df, start=at(2026, 1, 5, 12)):
    return {
        (row.observed_at.replace(tzinfo=dt.timezone.utc) - start).total_seconds() / 60: row
        for row in df.collect()
    }


def test_golden_row(make_raw, make_stations):
    rows = by_minute(compute_features(make_raw(EVERY_FIVE), make_stations(("A", 20))))
    row = rows[30]
    assert row.num_vehicles_available == 16
    assert (row.lag_5m_vehicles, row.lag_15m_vehicles, row.lag_30m_vehicles) == (15, 13, 10)
    assert row.lag_60m_vehicles is None
    assert row.delta_15m == 3
    assert row.roll_mean_30m == 13.5  # the row exactly 30 minutes back is out
    assert row.roll_mean_60m == 13.0
    assert row.occupancy_ratio == 0.8


def test_column_order(make_raw, make_stations):
    out = compute_features(make_raw(EVERY_FIVE), make_stations(("A", 20)))
    assert out.columns == [
        "system_id", "observed_at", "station_id", "capacity", "num_vehicles_available",
        "num_docks_available", "occupancy_ratio", "lag_5m_vehicles", "lag_15m_vehicles",
        "lag_30m_vehicles", "lag_60m_vehicles", "delta_15m", "roll_mean_30m", "roll_std_30m",
        "roll_mean_60m", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "is_installed",
        "is_renting", "is_returning",
    ]


def test_zero_capacity(make_raw, make_stations):
    out = compute_features(make_raw(EVERY_FIVE), make_stations(("A", 0)))
    assert out.where("occupancy_ratio is not null").count() == 0


def test_gap_gives_no_stale_value(make_raw, make_stations):
    points = [(0, 1), (5, 2), (10, 3), (50, 100), (55, 101), (60, 102)]
    row = by_minute(compute_features(make_raw(points), make_stations(("A", 20))))[50]
    assert row.lag_5m_vehicles is None and row.lag_30m_vehicles is None
    assert row.roll_mean_30m == 100.0 and row.roll_std_30m is None


def test_no_leakage(make_raw, make_stations):
    stations = make_stations(("A", 20))
    spiked = EVERY_FIVE[:-1] + [(35, 9999)]
    base = compute_features(make_raw(EVERY_FIVE), stations)
    other = compute_features(make_raw(spiked), stations)
    early = F.col("observed_at") < F.lit(at(2026, 1, 5, 12, 35))
    assert base.where(early).exceptAll(other.where(early)).count() == 0


def test_label(make_raw, make_stations):
    raw = make_raw(EVERY_FIVE)
    features = compute_features(raw, make_stations(("A", 20)))
    rows = by_minute(add_target(features, raw, horizon_minutes=15, tolerance_minutes=10))
    assert rows[0].target_num_vehicles_available == 13
    assert rows[0].target_observed_at.replace(tzinfo=dt.timezone.utc) == at(2026, 1, 5, 12, 15)
    assert sorted(rows) == [0, 5, 10, 15, 20]


def test_label_outside_tolerance_is_dropped(make_raw, make_stations):
    points = [(0, 1), (5, 2), (10, 3), (60, 4), (65, 5), (70, 6)]
    raw = make_raw(points)
    features = compute_features(raw, make_stations(("A", 20)))
    rows = by_minute(add_target(features, raw, horizon_minutes=20, tolerance_minutes=5))
    assert 0 not in rows


def test_naive_time_is_utc(spark, make_raw, make_stations):
    raw = make_raw([(0, 1)], start=at(2026, 1, 1, 3)).withColumn(
        "observed_at", F.col("observed_at").cast("timestamp_ntz")
    )
    row = compute_features(raw, make_stations(("A", 20))).first()
    assert row.hour_sin == pytest.approx(math.sin(2 * math.pi * 22 / 24))
    # 2025-12-31 22:00 local is a Wednesday
    assert row.dow_cos == pytest.approx(math.cos(2 * math.pi * 3 / 7))


def test_missing_columns(make_raw, make_stations):
    with pytest.raises(ValueError, match="is_renting"):
        compute_features(make_raw(EVERY_FIVE).drop("is_renting"), make_stations(("A", 1)))


def reference_rows(points, lags, tolerance, means, horizon, label_tolerance):
    """Brute force over one station's sorted (minute, value) points."""
    out = {}
    for t, v in points:
        row = {}
        for m in lags:
            found = [x for x in points if t - m - tolerance <= x[0] <= t - m]
            row[f"lag_{m}"] = found[-1][1] if found else None
        for m in means:
            inside = [x[1] for x in points if t - m < x[0] <= t]
            row[f"mean_{m}"] = sum(inside) / len(inside)
            if len(inside) > 1:
                mean = row[f"mean_{m}"]
                row[f"std_{m}"] = math.sqrt(
                    sum((x - mean) ** 2 for x in inside) / (len(inside) - 1)
                )
            else:
                row[f"std_{m}"] = None
        later = [x for x in points if t + horizon <= x[0] <= t + horizon + label_tolerance]
        row["label"] = later[0][1] if later else None
        out[t] = row
    return out


@pytest.mark.parametrize("bucket_us", [None, HOUR_US, 24 * HOUR_US])
def test_matches_brute_force_across_buckets(make_raw, make_stations, bucket_us):
    """Irregular times, a bucket narrower than the reach, and one station with most rows."""
    rng = random.Random(7)
    hot = sorted(rng.sample(range(0, 4000), 700))
    points = {"A": [(m, rng.randint(0, 30)) for m in hot], "B": [(m, 1) for m in (0, 700, 705)]}
    raw = make_raw(points["A"]).unionByName(make_raw(points["B"], station="B"))
    spec = FeatureSpec(bucket_us=bucket_us, stds=(30, 60))
    stations = make_stations(("A", 20), ("B", 5))
    features = compute_features(raw, stations, spec).cache()
    fused = labeled_features(raw, stations, spec, horizon_minutes=120, tolerance_minutes=10)
    for station, series in points.items():
        expected = reference_rows(series, (5, 15, 30, 60), 5, (30, 60), 120, 10)
        got = by_minute(features.where(F.col("station_id") == station))
        assert len(got) == len(series)
        for t, want in expected.items():
            row = got[t]
            for m in (5, 15, 30, 60):
                assert row[f"lag_{m}m_vehicles"] == want[f"lag_{m}"]
            for m in (30, 60):
                assert row[f"roll_mean_{m}m"] == pytest.approx(want[f"mean_{m}"])
                assert row[f"roll_std_{m}m"] == pytest.approx(want[f"std_{m}"])
        labels = by_minute(fused.where(F.col("station_id") == station))
        assert {t: r.target_num_vehicles_available for t, r in labels.items()} == {
            t: w["label"] for t, w in expected.items() if w["label"] is not None
        }
    separate = add_target(features, raw, horizon_minutes=120, tolerance_minutes=10)
    assert separate.count() == fused.count()
    assert separate.exceptAll(fused.select(separate.columns)).count() == 0
    features.unpersist()


def test_asof_between_tables_keeps_null_apart_from_no_match(spark):
    left = spark.createDataFrame(
        [("k", at(2026, 1, 1, 10), 1), ("k", at(2026, 1, 1, 12), 2), ("z", at(2026, 1, 1, 10), 3)],
        "k string, t timestamp, n int",
    )
    right = spark.createDataFrame(
        [("k", at(2026, 1, 1, 9, 50), 7), ("k", at(2026, 1, 1, 9, 58), None),
         ("k", at(2026, 1, 1, 11, 50), 8)],
        "k string, u timestamp, v int",
    )
    out = asof_join(
        left, right, by=["k"], left_time="t", right_time="u", values={"v": "v"},
        tolerance_minutes=10, matched_time="seen",
    )
    got = {r.n: (r.v, r.seen is not None) for r in out.collect()}
    assert got == {1: (None, True), 2: (8, True), 3: (None, False)}


@pytest.mark.parametrize("strategy", ["backward", "forward"])
@pytest.mark.parametrize("bucket_us", [None, 24 * HOUR_US])
def test_asof_join_matches_brute_force(spark, strategy, bucket_us):
    rng = random.Random(3)
    start = at(2026, 1, 1)
    lefts = [(k, rng.randrange(3000)) for k in "aaaab" for _ in range(60)]
    rights = {(k, m): rng.randrange(100) for k in "ab" for m in rng.sample(range(3000), 150)}
    left = spark.createDataFrame(
        [(k, start + dt.timedelta(minutes=m), m) for k, m in lefts], "k string, t timestamp, m int"
    )
    right = spark.createDataFrame(
        [(k, start + dt.timedelta(minutes=m), v) for (k, m), v in rights.items()],
        "k string, u timestamp, v int",
    )
    out = asof_join(
        left, right, by=["k"], left_time="t", right_time="u", values={"v": "v"},
        strategy=strategy, offset_minutes=7, tolerance_minutes=15, bucket_us=bucket_us,
    )
    steps = [s if strategy == "forward" else -s for s in range(16)]
    want = sorted(
        (k, m, next((rights[k, m + 7 + s] for s in steps if (k, m + 7 + s) in rights), -1))
        for k, m in lefts
    )
    assert sorted((r.k, r.m, -1 if r.v is None else r.v) for r in out.collect()) == want


def test_the_input_is_read_once(spark, make_raw, make_stations, tmp_path):
    make_raw(EVERY_FIVE).write.parquet(str(tmp_path / "status"))
    raw = spark.read.parquet(str(tmp_path / "status"))
    plan = labeled_features(raw, make_stations(("A", 20)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1


def test_one_shuffle_for_all_frames(make_raw, make_stations):
    plan = labeled_features(make_raw(EVERY_FIVE), make_stations(("A", 20)))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Window [") == 2  # one per sort direction
