"""Leaf-wise boosting against plain loops over the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationflow.plans import boosting as B
from stationflow.plans.features import DEFAULT_SPEC

COLUMNS = ["station_id_code", *DEFAULT_SPEC.columns[1:]]
SMALL = B.LeafSettings(
    rounds=6, step=0.3, leaves=7, min_rows_per_leaf=8, patience=30, store_every=2,
    most_categories=3,
)


def made_rows(n=400, seed=3):
    """Codes, two telling numbers with holes, and columns that never change."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        code = rng.randrange(6)
        a = None if rng.random() < 0.2 else float(rng.randrange(12))
        b = float("nan") if rng.random() < 0.1 else float(rng.randrange(40))
        y = (3 if code in (1, 4) else 0) + (2 if a is None else a // 4) + (b == b and b > 25) * 2
        rows.append((code, a, b, float(y + rng.randrange(2)), "val" if i % 5 == 0 else "train"))
    return rows


def framed(spark, rows):
    base = spark.createDataFrame(
        rows, "station_id_code int, a double, b double, target_delta double, split string"
    )
    numbers = [F.col("a"), F.col("b"), *[F.lit(1.0) for _ in COLUMNS[3:]]]
    return base.select(
        "target_delta", "split", "station_id_code",
        *[c.alias(name) for c, name in zip(numbers, COLUMNS[1:])],
    )


# --- the same trees by plain loops ----------------------------------------------


def plain_bin(bounds, value):
    if value is None or value != value:
        return 0
    if bounds is None:
        return int(value) + 1
    return min(sum(b < value for b in bounds) + 1, len(bounds))


def goes_left(split, bins):
    at = bins[split["feature"]]
    if at == 0:
        return split["missing_left"]
    return at in split["categories"] if split["categories"] else at <= split["bin"]


def plain_split(rows, s):
    """(gain, split) of the rows ``(bins, g)``; the first of equal gains."""
    total, best = sum(g for _, g in rows) / B.SCALE, None
    for f in range(len(rows[0][0])):
        by = {}
        for bins, g in rows:
            by.setdefault(bins[f], []).append(g)
        tried = []
        if f == 0:
            known = [c for c in by if c]
            mean = {c: sum(by[c]) / B.SCALE / (len(by[c]) + s.category_smoothing) for c in known}
            for sign in (1, -1):
                order = sorted(known, key=lambda c: (sign * mean[c], c))[: s.most_categories]
                tried += [(None, sorted(order[: i + 1]), False) for i in range(len(order))]
        else:
            for missing_left in (False, True) if 0 in by else (None,):
                tried += [(cut, None, missing_left) for cut in sorted(by) if cut]
        for cut, categories, missing_left in tried:
            split = {"feature": f, "bin": cut, "categories": categories,
                     "missing_left": bool(missing_left)}
            left = [g for bins, g in rows if goes_left(split, bins)]
            n_left, n_right = len(left), len(rows) - len(left)
            if min(n_left, n_right) < s.min_rows_per_leaf:
                continue
            l2 = s.category_l2 if f == 0 else 0.0
            g_left = sum(left) / B.SCALE
            gain = (g_left**2 / (n_left + l2) + (total - g_left) ** 2 / (n_right + l2)
                    - total**2 / len(rows))
            if missing_left is None:
                split["missing_left"] = 2 * n_left >= len(rows)
            if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                best = (gain, split)
    return best


def plain_tree(rows, s):
    """One split after the other, always of the leaf with most to gain."""
    leaves = {"": (rows, 0.0)}
    splits = {}
    while len(leaves) < s.leaves:
        found = {p: plain_split(r, s) for p, (r, _) in leaves.items()
                 if len(r) >= 2 * s.min_rows_per_leaf}
        found = {p: f for p, f in found.items() if f}
        if not found:
            break
        path = min(found, key=lambda p: (-found[p][0], len(p), p))
        split = splits[path] = found[path][1]
        inside, _ = leaves.pop(path)
        l2 = s.category_l2 if split["feature"] == 0 else 0.0
        leaves[path + "L"] = ([r for r in inside if goes_left(split, r[0])], l2)
        leaves[path + "R"] = ([r for r in inside if not goes_left(split, r[0])], l2)

    def node(path):
        if path in leaves:
            inside, l2 = leaves[path]
            if not path:
                return {"value": 0.0}
            return {"value": -s.step * (sum(g for _, g in inside) / B.SCALE) / (len(inside) + l2)}
        return {**splits[path], "left": node(path + "L"), "right": node(path + "R")}

    return node("")


def value(tree, bins):
    while "value" not in tree:
        tree = tree["left"] if goes_left(tree, bins) else tree["right"]
    return tree["value"]


def same_tree(got, want):
    assert ("value" in got) == ("value" in want)
    if "value" in got:
        assert got["value"] == pytest.approx(want["value"], abs=1e-9)
        return
    for key in ("feature", "bin", "categories", "missing_left"):
        assert got[key] == want[key], key
    same_tree(got["left"], want["left"])
    same_tree(got["right"], want["right"])


@pytest.fixture(scope="module")
def fitted(spark):
    frame = framed(spark, made_rows()).repartition(5).persist()
    return frame, B.fit(frame, SMALL)


def test_equals_plain_boosting(fitted):
    _, model = fitted
    rows = [
        ([plain_bin(b, v) for b, v in zip(model.bounds, (c, x, y, *[1.0] * (len(COLUMNS) - 3)))],
         target, split)
        for c, x, y, target, split in made_rows()
    ]
    train = [(bins, target) for bins, target, split in rows if split == "train"]
    assert model.start == pytest.approx(sum(t for _, t in train) / len(train))
    scores = [model.start] * len(train)
    errors = []
    for tree in model.trees:
        g = [float(np.rint((s - t) * B.SCALE)) for s, (_, t) in zip(scores, train)]
        same_tree(tree, plain_tree([(bins, g) for (bins, _), g in zip(train, g)], SMALL))
        scores = [s + value(tree, bins) for s, (bins, _) in zip(scores, train)]
        off = [abs(s - t) for s, (_, t) in zip(scores, train)]
        errors.append((sum(off) / len(off), math.sqrt(sum(e * e for e in off) / len(off))))
    history = sorted(h for h in model.history if h[0] == "train")
    assert len(history) >= len(model.trees) == 6
    for (_, k, mae, rmse), (want_mae, want_rmse) in zip(history, errors):
        assert (mae, rmse) == (pytest.approx(want_mae, abs=1e-4), pytest.approx(want_rmse, abs=1e-4))
    assert errors[-1][0] < errors[0][0]
    kinds = {n["feature"] for t in model.trees for n in _inner(t)}
    assert {0, 1, 2} <= kinds  # categories and both numbers were of use


def _inner(tree):
    if "value" in tree:
        return []
    return [tree, *_inner(tree["left"]), *_inner(tree["right"])]


def test_partitions_do_not_matter(spark, fitted):
    _, model = fitted
    again = B.fit(framed(spark, made_rows()[::-1]).repartition(2), SMALL)
    assert again.to_json() == model.to_json()


def test_predictions(spark, fitted):
    frame, model = fitted
    read = B.LeafModel.from_json(model.to_json())
    assert read == model
    got = B.predict(read, frame).select(*COLUMNS[:3], B.PREDICTED_DELTA).collect()
    assert len(got) == 400
    for code, a, b, predicted in got:
        bins = [plain_bin(x, v) for x, v in zip(model.bounds, (code, a, b, *[1.0] * (len(COLUMNS) - 3)))]
        assert predicted == pytest.approx(model.start + sum(value(t, bins) for t in model.trees))
    # a station and numbers never seen in training, and nothing at all
    odd = framed(spark, [(99, 1e9, -1e9, 0.0, "val"), (None, None, None, 0.0, "val")])
    assert all(math.isfinite(r[0]) for r in B.predict(model, odd).select(B.PREDICTED_DELTA).collect())


def test_leaves_are_bounded(fitted):
    _, model = fitted
    assert all(1 <= len(_inner(t)) <= SMALL.leaves - 1 for t in model.trees)


def test_awkward_tables(spark):
    rows = made_rows(60)
    empty = B.fit(framed(spark, []), SMALL)
    assert (empty.start, empty.trees, empty.history) == (0.0, [], [])
    no_val = B.fit(framed(spark, [(*r[:4], "train") for r in rows]), SMALL)
    assert len(no_val.trees) == SMALL.rounds
    same = B.fit(framed(spark, [(1, 2.0, 3.0, 5.0, "train")] * 50), SMALL)
    assert same.start == 5.0 and same.trees == []
    no_target = B.fit(framed(spark, [*rows, (1, 1.0, 1.0, None, "train")]), SMALL)
    assert no_target.to_json() == B.fit(framed(spark, rows), SMALL).to_json()


@pytest.mark.parametrize("errors, patience, best", [
    ([(3, 3), (2, 2), (2.5, 2.5), (2.5, 2.5)], 2, 2),
    ([(3, 3), (2, 4), (1, 5)], 2, 1),  # the squared error rose for two rounds
    ([(3, 3), (2, 2), (1, 1)], 2, None),
    ([], 2, None),
])
def test_stop_round(errors, patience, best):
    assert B.stop_round(errors, patience) == best


def test_a_fit_starts_no_job_per_level(spark):
    """Every look at open leaves was a job, about ten a tree, and scores were stored anew."""
    frame = framed(spark, made_rows()).persist()
    spark.sparkContext.setJobGroup("leaves", "")
    model = B.fit(frame, SMALL)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("leaves")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(model.trees) == 6
    assert len(jobs) < 2 * len(model.trees)
