import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from rows import RAW_DDL, at
from stationflow import schemas as S
from stationflow.functions import measures
from stationflow.functions.clock import instant
from stationflow.plans import boosting as B
from stationflow.plans import dataset as D
from stationflow.plans import forecast as P
from stationflow.plans import monitor
from stationflow.plans import train as T
from stationflow.plans.features import compute_features


@pytest.fixture(scope="module")
def seeded(spark):
    """Three stations, three days at five minutes: a slow wave plus noise."""
    rng, rows = random.Random(42), []
    for n, level in ((1, 6), (2, 10), (3, 14)):
        for i in range(3 * 288):
            value = level + round(3 * math.sin(i / 12) + rng.uniform(-1, 1))
            value = min(20, max(0, value))
            time = at(2026, 1, 1) + dt.timedelta(minutes=5 * i)
            rows.append(("s", f"station-{n}", time, value, 20 - value, True, True, True))
    return spark.createDataFrame(rows, RAW_DDL)


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(
        [("s", f"station-{n}", 20) for n in (1, 2, 3)],
        "system_id string, station_id string, capacity bigint",
    )


@pytest.fixture(scope="module")
def run(spark, seeded, catalog, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("train"))
    trained = T.train(
        seeded, catalog, f"{base}/work", f"{base}/model", run_id="r1",
        settings=T.TreeSettings(rounds=15, depth=4, step=0.2, min_rows_per_leaf=20),
        now=lambda: at(2026, 2, 1),
    )
    return trained, f"{base}/model"


def test_training_run(spark, run):
    trained, path = run
    metrics = {r["split"]: r for r in trained.metrics.collect()}
    baseline = {r["split"]: r for r in trained.baseline.collect()}
    assert set(metrics) == set(baseline) == {"train", "val", "test"}
    for row in (*metrics.values(), *baseline.values()):
        assert math.isfinite(row.mae) and math.isfinite(row.rmse) and row.n_rows > 0
    # on a regular wave the model is not worse than no change at all
    assert metrics["test"].mae <= baseline["test"].mae * 1.05
    parameters = trained.parameters.first()
    assert parameters.train_start < parameters.train_end <= parameters.val_end <= parameters.test_end
    assert parameters.n_stations == 3 and parameters.n_train_rows == baseline["train"].n_rows
    assert trained.metadata["n_stations"] == 3
    assert T.metadata_frame(spark, trained.metadata).first().run_id == "r1"


def test_leafwise_run(spark, seeded, catalog, tmp_path):
    """The same job with leaf-wise trees: learns, stores, loads and forecasts."""
    trained = T.train(
        seeded, catalog, f"{tmp_path}/work", f"{tmp_path}/model", run_id="r2",
        settings=B.LeafSettings(rounds=12, leaves=15, step=0.2, min_rows_per_leaf=20),
        now=lambda: at(2026, 2, 1),
    )
    metrics = {r["split"]: r.mae for r in trained.metrics.collect()}
    baseline = {r["split"]: r.mae for r in trained.baseline.collect()}
    assert metrics["test"] <= baseline["test"] * 1.05 and metrics["train"] < baseline["train"]
    kept = spark.read.parquet(f"{tmp_path}/model/record/round_history").where("split = 'val'")
    best = kept.where(F.col("round") == len(trained.model.trees)).first()
    assert best.mae == pytest.approx(metrics["val"], abs=1e-4)
    assert T.artifacts_exist(spark, f"{tmp_path}/model")
    model, codes, _ = T.load_artifacts(spark, f"{tmp_path}/model")
    assert model == trained.model
    history = catalog.withColumn("observed_at", F.lit(at(2026, 1, 1)))
    out = P.forecast_all(
        seeded, history, codes, P.model_change(model, codes, 3), instant(at(2026, 1, 4)), run_id="r2",
    ).collect()
    assert {r.outcome for r in out} == {"ok"} and len(out) == 3
    assert all(0 <= r.predicted_num_vehicles_available <= 20 for r in out)


def test_artifacts_round_trip(spark, run):
    from stationflow.sources import storage

    trained, path = run
    assert T.artifacts_exist(spark, path)
    model, codes, metadata = T.load_artifacts(spark, path)
    assert metadata["trained_at"] == "2026-02-01T00:00:00+00:00"
    assert codes.exceptAll(trained.codes).count() == 0
    assert model.getNumTrees == trained.model.getNumTrees
    assert not T.artifacts_exist(spark, path + "-elsewhere")
    assert storage.read_text(spark, path + "/nothing") is None


def test_the_record_is_kept(spark, run):
    trained, path = run
    history = spark.read.parquet(f"{path}/record/round_history")
    assert history.where("split = 'val'").count() == trained.model.getNumTrees
    for name in ("baseline", "metrics", "parameters"):
        kept = spark.read.parquet(f"{path}/record/{name}")
        assert kept.count() == getattr(trained, name).count()


@pytest.mark.parametrize("errors, patience, best", [
    ([5, 4, 4.5, 3], 2, 4),  # a weak round before the best
    ([5, 4, 4.5, 4.4, 3], 2, 2),  # too many weak rounds
    ([5, 5, 5], 30, 1),
    ([3.0], 30, 1),
    ([float("nan")] * 4, 2, 4),
])
def test_best_round(errors, patience, best):
    assert T.best_round(errors, patience) == best


@pytest.mark.parametrize(
    "error, fits, best",
    [
        (lambda r: -r, [60, 500], 500),  # falls to the end
        (lambda r: abs(r - 7), [60], 7),
        (lambda r: abs(r - 45), [60, 120], 45),
        (lambda r: abs(r - 95) if r > 70 else 95 + abs(r - 45), [60, 120, 500], 95),
        (lambda r: abs(r - 300), [60, 500], 300),
        (lambda r: math.nan, [60, 500], 500),  # no val rows
    ],
)
def test_a_long_fit_begins_anew_twice_at_most(spark, monkeypatch, error, fits, best):
    asked = []

    class Fake:
        def __init__(self, rounds):
            asked.append(rounds)
            self.getNumTrees = rounds

        def fit(self, _):
            return self

        def evaluateEachIteration(self, *_):
            return [float(error(r)) for r in range(1, self.getNumTrees + 1)]

    monkeypatch.setattr(T, "_boosted", lambda n_codes, settings, rounds: Fake(rounds))
    monkeypatch.setattr(T, "first_trees", lambda model, n: n)
    assert T.fit(spark.createDataFrame([("train",)], "split string"), 1) == best
    assert asked == fits
    everything = [float(error(r)) for r in range(1, 501)]
    assert T.best_round(everything, T.TreeSettings().patience) == best


def test_first_trees_are_the_rounds(spark, run, seeded, catalog):
    trained, _ = run
    split = compute_features(seeded, catalog).withColumns(
        {"split": F.lit("val"), "target_delta": F.lit(0)}
    )
    rows = T.assemble(split, trained.codes, 3)
    short = T.first_trees(trained.model, 2)
    assert short.getNumTrees == 2
    errors = trained.model.evaluateEachIteration(rows, "squared")
    mean = T.predict(short, rows).select(F.avg(F.col(T.PREDICTED_DELTA) ** 2)).first()[0]
    assert math.isclose(mean, errors[1], rel_tol=1e-9)


@pytest.mark.parametrize("settings", [T.TreeSettings(), B.LeafSettings()])
def test_a_fit_reads_rows_dealt_over_all_cores(spark, run, seeded, catalog, settings):
    """All rows of three stations were in the few partitions that the join left."""
    trained, _ = run
    split = compute_features(seeded, catalog).withColumns(
        {"split": F.lit("train"), "target_delta": F.lit(0)}
    )
    rows = T.training_rows(settings, split, trained.codes, 3)
    sizes = rows.groupBy(F.spark_partition_id()).count().toPandas()["count"]
    cores = spark.sparkContext.defaultParallelism
    assert len(sizes) == cores
    assert sizes.sum() == split.count() and sizes.max() <= 2 * sizes.sum() / cores


def test_rounds(spark, run, seeded, catalog):
    trained, _ = run
    features = compute_features(seeded, catalog)
    split = features.withColumns(
        {"split": F.when(F.col("observed_at") < F.lit(at(2026, 1, 3)), "train").otherwise("val"),
         "target_delta": F.lit(0)}
    )
    assembled = T.assemble(split, trained.codes, 3)
    history = T.round_history(trained.model, assembled)
    assert history.count() == 2 * trained.model.getNumTrees
    assert history.where("mae < 0 or rmse < 0").count() == 0


def test_forecast_with_the_model(spark, run, seeded, catalog):
    trained, _ = run
    history = catalog.withColumn("observed_at", F.lit(at(2026, 1, 1)))
    as_of = instant(at(2026, 1, 4))
    out = P.forecast_all(
        seeded, history, trained.codes, P.model_change(trained.model, trained.codes, 3), as_of,
        run_id="r1",
    ).collect()
    assert len(out) == 3
    for row in out:
        assert row.outcome == "ok" and 0 <= row.predicted_num_vehicles_available <= 20
        assert row.predicted_at - row.last_observed_at == dt.timedelta(minutes=120)


def served_rows(spark, now):
    """One station per outcome."""
    five = [now - dt.timedelta(minutes=5 * i) for i in range(12)]
    rows = [("s", "fine", t, 8, 2, True, True, True) for t in five]
    rows += [("s", "closed", t, 8, 2, True, False, True) for t in five]
    rows += [("s", "new", t, 8, 2, True, True, True) for t in five]
    rows += [("s", "stale", now - dt.timedelta(minutes=91), 8, 2, True, True, True)]
    return spark.createDataFrame(rows, RAW_DDL)


@pytest.mark.parametrize(
    "delta, capacity, expected", [(5, 20, 13), (50, 10, 10), (-50, 10, 0), (50, None, 58), (0.5, 20, 8)]
)
def test_outcomes_and_clipping(spark, delta, capacity, expected):
    now = at(2026, 1, 5, 12)
    names = ("fine", "closed", "new", "stale")
    history = spark.createDataFrame(
        [("s", n, capacity, now) for n in names],
        "system_id string, station_id string, capacity bigint, observed_at timestamp",
    )
    codes = spark.createDataFrame(
        [("s", n, i) for i, n in enumerate(("closed", "fine", "stale"))],
        "system_id string, station_id string, station_id_code int",
    )
    asked = history.select(*S.STATION_KEY).union(
        spark.createDataFrame([("s", "nowhere")], "system_id string, station_id string")
    )
    out = P.forecast_all(
        served_rows(spark, now), history, codes, P.constant_change(delta), instant(now),
        run_id="r", requested=asked,
    )
    got = {r.station_id: r for r in out.collect()}
    assert {n: (r.outcome, r.status_code) for n, r in got.items()} == {
        "fine": ("ok", 200), "closed": ("out_of_service", 422), "new": ("unseen_station", 422),
        "stale": ("no_history", 422), "nowhere": ("unknown_station", 404),
    }
    assert got["fine"].predicted_num_vehicles_available == expected
    assert got["closed"].predicted_num_vehicles_available is None


def test_lookback_is_cut_before_features(spark):
    """Newest row 40 minutes old: only 50 minutes of history are left for the features."""
    now = at(2026, 1, 5, 12)
    rows = [("s", "a", now - dt.timedelta(minutes=m), m, 0, True, True, True) for m in (40, 100)]
    raw = spark.createDataFrame(rows, RAW_DDL)
    stations = spark.createDataFrame(
        [("s", "a", 9)], "system_id string, station_id string, capacity bigint"
    )
    row = P.feature_rows(raw, stations, instant(now)).first()
    assert row.num_vehicles_available == 40 and row.lag_60m_vehicles is None


def test_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, 5)], "y int, p int")
    out = rows.agg(
        measures.mean_absolute_error("y", "p").alias("mae"),
        measures.root_mean_squared_error("y", "p").alias("rmse"),
    ).first()
    assert out.mae == pytest.approx(2 / 3) and out.rmse == pytest.approx(math.sqrt(4 / 3))


def test_split_of_no_rows(spark):
    empty = spark.createDataFrame([], "observed_at timestamp, x int")
    assert D.time_split(empty).count() == 0
    assert tuple(D.split_cutoffs(empty).first()) == (None, None)


@pytest.mark.parametrize("ties", [1, 40])
def test_cutoffs_match_sorted_positions(spark, ties):
    rng = random.Random(5)
    times = [at(2026, 1, 1) + dt.timedelta(microseconds=rng.randrange(3 * 86_400_000_000))
             for _ in range(300 // ties)]
    times = sorted(t for t in times for _ in range(ties))
    out = D.split_cutoffs(spark.createDataFrame([(t,) for t in times], "observed_at timestamp")).first()
    want = [times[int(len(times) * f)].replace(tzinfo=None) for f in (0.7, 0.7 + 0.15)]
    assert [out.train_cutoff, out.val_cutoff] == want


def test_station_codes_are_dense_and_sorted(spark):
    names = [f"n{i}" for i in range(500)]
    shuffled = names + names[:100]
    random.Random(1).shuffle(shuffled)
    catalog = spark.createDataFrame([("s", n) for n in shuffled], "system_id string, station_id string")
    codes = {r.station_id: r.station_id_code for r in D.station_codes(catalog.repartition(7)).collect()}
    assert codes == {n: i for i, n in enumerate(sorted(names))}


def test_readiness(spark):
    now = at(2026, 1, 5, 12)
    rows = served_rows(spark, now)
    deep = monitor.readiness(rows, instant(now)).first()
    assert deep.status == "ready" and deep.data_age_seconds == 0
    shallow = monitor.readiness(rows.where("station_id = 'fine'"), instant(now)).first()
    assert shallow.data_fresh and not shallow.history_deep_enough and shallow.status == "not_ready"
    old = monitor.readiness(rows, instant(now + dt.timedelta(minutes=91))).first()
    assert not old.data_fresh
    none = monitor.readiness(rows.limit(0), instant(now)).first()
    assert none.status == "not_ready" and none.latest_observed_at is None
    assert monitor.readiness(rows, instant(now), model_loaded=False).first().status == "not_ready"
