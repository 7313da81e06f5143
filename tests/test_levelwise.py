"""Depth-wise boosting against Spark's own booster, and what a fit costs."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from stationflow.plans import levelwise as W
from stationflow.plans import together as G
from stationflow.plans import train as T

N_CODES = 5


def made(n=900, seed=2):
    """Codes, numbers of few values, one that never changes, and a target with a slow rest."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        code, a, b = float(rng.randrange(N_CODES)), float(rng.randrange(9)), rng.randrange(30) / 4
        y = (4.0 if code in (1, 3) else 0.0) + a * 0.7 + (3 if b > 5 else 0) * (a > 4) + rng.random()
        rows.append((code, a, b, 1.0, y, "val" if i % 4 == 0 else "train"))
    return rows


def assembled(spark, rows):
    base = spark.createDataFrame(
        rows, "code double, a double, b double, c double, target_delta double, split string"
    )
    category = {"ml_attr": {"type": "nominal", "num_vals": N_CODES, "name": "code"}}
    named = base.withColumn("code", F.col("code").alias("code", metadata=category))
    vectors = VectorAssembler(inputCols=["code", "a", "b", "c"], outputCol="features")
    return vectors.transform(named).select("split", "target_delta", "features")


@pytest.fixture(scope="module")
def rows(spark):
    return assembled(spark, made()).repartition(5).persist()


SETTINGS = T.TreeSettings(rounds=7, depth=4, step=0.3, min_rows_per_leaf=12)


def test_trees_are_those_of_spark(rows):
    booster = T._boosted(N_CODES, SETTINGS, SETTINGS.rounds)
    model = booster.fit(rows)
    theirs = booster.estimator.fit(rows.where("split = 'train'"))
    assert model.getNumTrees == theirs.getNumTrees == 7
    for own, other in zip(model.trees, theirs.trees):
        assert (own.numNodes, own.depth) == (other.numNodes, other.depth)
    both = [m.transform(rows).select(T.PREDICTED_DELTA).toPandas() for m in (model, theirs)]
    assert np.allclose(*both, atol=1e-5)
    assert np.allclose(
        model.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-4
    )
    assert model.treeWeights == theirs.treeWeights
    for name in ("maxDepth", "stepSize", "labelCol", "featuresCol", "predictionCol"):
        assert model.getOrDefault(name) == theirs.getOrDefault(name)


def test_the_errors_are_measured_in_the_fit(spark, rows):
    model = T.fit(rows, N_CODES, SETTINGS)
    kept = model.getNumTrees
    measured = {(r.split, r.round): (r.mae, r.rmse) for r in T.round_history(model, rows).collect()}
    again = {
        (r.split, r.round): (r.mae, r.rmse)
        for r in T.round_history(model, rows.select("*")).collect()
    }
    assert measured.keys() == again.keys() and len(again) == 2 * kept
    for key, errors in again.items():
        assert measured[key] == pytest.approx(errors, abs=1e-4)


def test_a_long_fit_starts_no_job_per_round(spark, rows):
    """Rounds beyond twice the patience were fitted anew, and every level was a job."""
    spark.sparkContext.setJobGroup("a long fit", "")
    model = T.fit(rows, N_CODES, T.TreeSettings(rounds=30, patience=2, step=0.005, min_rows_per_leaf=12))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("a long fit")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert model.getNumTrees == 30
    assert len(jobs) < 30


def test_a_fit_stops_where_the_val_error_turns(spark):
    """Val targets that the train rows tell nothing about: the first rounds are the best."""
    rng = random.Random(8)
    noise = [(*r[:4], rng.random(), r[5]) for r in made(400)]
    rows = assembled(spark, noise)
    model = T.fit(rows, N_CODES, T.TreeSettings(rounds=60, patience=3, step=0.5, min_rows_per_leaf=4))
    long = T._boosted(N_CODES, T.TreeSettings(rounds=20, patience=20, step=0.5, min_rows_per_leaf=4), 20)
    errors = long.fit(rows).evaluateEachIteration(rows.where("split = 'val'"), "squared")
    assert model.getNumTrees == T.best_round(errors, 3) < 20


def test_awkward_rows(spark):
    train = [(*r[:5], "train") for r in made(300)]
    model = T.fit(assembled(spark, train), N_CODES, SETTINGS)
    assert model.getNumTrees == SETTINGS.rounds
    assert all(math.isnan(r[3]) for r in model.history if r[0] == "val")
    same = T.fit(assembled(spark, [(1.0, 2.0, 3.0, 4.0, 5.0, s) for s in ["train"] * 60 + ["val"]]), N_CODES, SETTINGS)
    assert {t.numNodes for t in same.trees} == {1}
    assert same.transform(assembled(spark, train)).first()[T.PREDICTED_DELTA] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        T.fit(assembled(spark, [(*r[:5], "val") for r in made(40)]), N_CODES, SETTINGS)


def test_cuts_lie_between_values(spark):
    rng = random.Random(4)
    values = [(float(i % 3), rng.random() ** 2) for i in range(6000)]
    x = spark.createDataFrame([([0.0, a, b],) for a, b in values], "x array<double>").repartition(6)
    few, many = W.thresholds(x, 3, 32)
    assert few.tolist() == [0.5, 1.5]
    got = np.array([b for _, b in values])
    assert len(many) == 31 and not np.isin(many, got).any()
    shares = np.diff([0, *[(got <= cut).mean() for cut in many], 1])
    assert abs(shares - 1 / 32).max() < 0.005


@pytest.mark.parametrize("sizes", [[7, 3, 40, 1, 2, 300], [5000, 2, 2], [70_000, 3]])
def test_columns_hold_every_bin(sizes):
    layout = G.Layout.of(sizes)
    rng = np.random.default_rng(1)
    bins = [rng.integers(0, s, 500) for s in sizes]
    cells = layout.cells(bins)
    assert sorted(f for fs in layout.columns for f in fs) == list(range(len(sizes)))
    for f, own in enumerate(bins):
        c = layout.column_of(f)
        assert (layout.bins(f)[cells[c]] == own).all()
        sums = np.bincount(cells[c], minlength=layout.widths[c])[None]
        got = dict(layout.by_feature(c, sums))[f][0]
        assert (got == np.bincount(own, minlength=sizes[f])).all()


def test_scores_are_those_of_the_stored_model(spark, rows):
    model = T.fit(rows, N_CODES, SETTINGS)
    short = T.first_trees(model, 2)
    odd = [(float(code), 1e9 * i - 1e9, 4.25, 2.0, 0.0, "test") for i in range(3) for code in range(N_CODES + 3)]
    for own in (model, short):
        for frame in (rows, assembled(spark, odd)):
            got = W.predict(own, frame).select(T.PREDICTED_DELTA).toPandas()
            assert np.allclose(got, own.transform(frame).select(T.PREDICTED_DELTA).toPandas(), atol=1e-9)
    assert short.getNumTrees == 2
    assert W.predict(model, rows).columns == model.transform(rows).columns
    assert W.predict(model, rows.limit(0)).collect() == []


def test_many_trees_are_scored_by_levels(rows):
    """Spark went through them row by row and tree by tree, in 0.6 us a tree."""
    model = T.fit(rows, N_CODES, SETTINGS)
    scored = T.predict(model, rows.withColumn("current_vehicles", F.lit(1.0)))
    assert "ArrowEvalPython" in scored._jdf.queryExecution().toString()
    assert scored.where(F.abs(F.col(T.PREDICTED) - F.col(T.PREDICTED_DELTA) - 1) > 1e-9).count() == 0
