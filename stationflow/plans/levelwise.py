"""Depth-wise boosted trees as Spark's booster grows them, all rounds in one job.

A tree fits the targets, and each one after it twice the errors left, at ``step`` of its value.
Numbers are cut between neighbouring values into equal parts of all train rows, or between all
values if these are few; categories are put in order by mean. The model is Spark's own class.
"""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.plans import together
from stationflow.session import scratch_folder
from stationflow.sources import storage

NODES_DDL = (
    "treeID int, nodeData struct<id:int, prediction:double, impurity:double, "
    "impurityStats:array<double>, rawCount:bigint, gain:double, leftChild:int, rightChild:int, "
    "split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>"
)
TREE_CLASS = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
NOT_OF_A_TREE = (
    "maxIter", "stepSize", "featureSubsetStrategy", "lossType", "subsamplingRate", "validationTol",
)
MODEL_CLASS = "org.apache.spark.ml.regression.GBTRegressionModel"


@dataclass(frozen=True)
class Boosting:
    """What to fit: Spark's estimator holds the parameters, feature 0 is a category."""

    estimator: GBTRegressor
    n_codes: int
    rounds: int
    patience: int
    most_rounds: int

    def fit(self, assembled: DataFrame) -> GBTRegressionModel:
        """Boost on the train rows, on after ``rounds`` while the val error tells to go on.

        The model has every round fitted, and in ``history`` the errors after each, so that
        nothing is fitted or scored a second time.
        """
        spark, estimator = assembled.sparkSession, self.estimator
        label = F.col(estimator.getLabelCol()).cast("double")
        rows = assembled.where(F.col("split").isin("train", "val")).select(
            (F.col("split") == "val").alias("is_val"), label.alias("y"),
            vector_to_array(estimator.getFeaturesCol()).alias("x"),
        )
        train = rows.where("NOT is_val")
        n, n_features, largest = train.agg(
            F.count("*"), F.first(F.size("x")), F.max(F.abs("y"))
        ).first()
        if not n:
            raise ValueError("no train rows")
        bins = min(estimator.getMaxBins(), n)
        cuts: list[np.ndarray | None] = [None, *thresholds(train, n_features, bins)]
        layout = together.Layout.of([self.n_codes if c is None else len(c) + 1 for c in cuts])

        def bins_of(batch: pa.RecordBatch) -> list[np.ndarray]:
            x = _matrix(batch.column(2))
            return [
                x[:, f].astype(np.int64) if c is None else np.searchsorted(c, x[:, f])
                for f, c in enumerate(cuts)
            ]

        # sums over all rows fit 62 bits, those of a chunk a double
        room = min(36, 60 - math.ceil(math.log2(n))) - math.ceil(math.log2(4 * (largest or 1.0)))
        step, depth = estimator.getStepSize(), estimator.getMaxDepth()
        smallest, scale = estimator.getMinInstancesPerNode(), 2.0**room
        least, most, patience = self.rounds, self.most_rounds, self.patience

        def work(own: together.Rows) -> str:
            own.scale = scale
            return json.dumps(boost(own, cuts, step, depth, smallest, least, most, patience))

        found = json.loads(together.run(together.blocks(rows, layout, bins_of), layout, work))
        model = _as_spark_model(spark, estimator, found["trees"], n_features, self.n_codes)
        model.grown, model.n_codes = found["trees"], self.n_codes
        model.history = [tuple(row) for row in found["history"]]
        model.measured_on = assembled
        return model


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def thresholds(train: DataFrame, n_features: int, bins: int) -> list[np.ndarray]:
    """Where each feature ``x[1:]`` is cut into at most ``bins`` bins; a value at a cut is below it."""
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins - 1)]) if bins > 1 else F.array(F.lit(0.5))
    numbers = range(1, n_features)
    found = train.agg(
        *[F.percentile_approx(F.col("x")[f], at, F.lit(10_000)).alias(f"q{f}") for f in numbers]
    ).first()
    ends = [np.unique(found[f"q{f}"]) for f in numbers]

    def seen(batches):
        few: list[np.ndarray | None] = [np.zeros(0) for _ in numbers]
        after = [np.full(len(e), np.inf) for e in ends]
        for batch in batches:
            x = _matrix(batch.column(0))
            for i, f in enumerate(numbers):
                values = np.unique(x[:, f])
                if few[i] is not None:
                    both = np.union1d(few[i], values)
                    few[i] = both if len(both) <= bins else None
                place = np.searchsorted(values, ends[i], side="right")
                inside = place < len(values)
                after[i][inside] = np.minimum(after[i][inside], values[place[inside]])
        for i in range(len(ends)):
            kept = pa.array([few[i].tolist() if few[i] is not None else None], pa.list_(pa.float64()))
            nexts = pa.array([after[i].tolist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i], pa.int32()), kept, nexts], ["i", "few", "after"]
            )

    # a row per task and feature, of at most ``bins`` numbers
    rows = train.select("x").mapInArrow(seen, "i int, few array<double>, after array<double>").collect()
    cuts = []
    for i, e in enumerate(ends):
        own = [r for r in rows if r.i == i]
        values = None
        if all(r.few is not None for r in own):
            values = np.unique(np.concatenate([r.few for r in own]))
        if values is not None and len(values) <= bins:
            low, high = values[:-1], values[1:]
        else:
            low, high = e, np.min([r.after for r in own], axis=0)
        cuts.append(((low + high) / 2)[np.isfinite(high)])
    return cuts


# --- in the tasks ----------------------------------------------------------------


def best_splits(
    g: np.ndarray, n: np.ndarray, cuts: list, starts: np.ndarray, smallest: int
) -> list[tuple[float, int, np.ndarray] | None]:
    """Per node the greatest gain, the feature and the bins that go left; the first of equals."""
    best: list[tuple[float, int, np.ndarray] | None] = [None] * len(g)
    total, rows = g[:, : starts[1]].sum(1), n[:, : starts[1]].sum(1)
    whole = total**2 / np.maximum(rows, 1)
    for f, cut in enumerate(cuts):
        at = slice(starts[f], starts[f + 1])
        own_g, own_n = g[:, at], n[:, at]
        if own_g.shape[1] < 2:
            continue
        order = None
        if cut is None:
            with np.errstate(divide="ignore", invalid="ignore"):
                # no row: last
                mean = np.where(own_n > 0, own_g / own_n, np.inf)
            order = np.argsort(mean, axis=1, kind="stable")
            own_g, own_n = (np.take_along_axis(a, order, 1) for a in (own_g, own_n))
        left_g, left_n = own_g.cumsum(1)[:, :-1], own_n.cumsum(1)[:, :-1]
        right_g, right_n = total[:, None] - left_g, rows[:, None] - left_n
        sides = left_g**2 / np.maximum(left_n, 1) + right_g**2 / np.maximum(right_n, 1)
        gain = np.where(np.minimum(left_n, right_n) >= max(1, smallest), sides - whole[:, None], -1.0)
        where = gain.argmax(1)
        for node, i in enumerate(where):
            won = float(gain[node, i])
            # less is rounding
            if won <= 1e-13 * sides[node, i] or (best[node] and won <= best[node][0]):
                continue
            left = np.zeros(own_g.shape[1], bool)
            left[: i + 1] = True
            if order is not None:
                left[order[node, : i + 1]], left[order[node, i + 1 :]] = True, False
            best[node] = (won, f, left)
    return best


def boost(rows, cuts, step, depth, smallest, least, most, patience) -> dict:
    """Trees as lists of nodes, and the errors after each: the same in all tasks."""
    from stationflow.plans.train import best_round

    starts = rows.layout.starts
    rows.start(0.0)
    trees, history, errors = [], [], []
    sums, _, _ = rows.begin(None)
    while True:
        # gradients are errors; labels are what is left, twice after the first tree
        unit = -(2.0 if trees else 1.0) / rows.scale
        nodes = [{"n": int(sums[1][: starts[1]].sum()), "g": int(sums[0][: starts[1]].sum())}]
        open_, last = {0: sums}, None
        for level in range(depth):
            names = list(open_)
            found = best_splits(
                np.array([open_[i][0] for i in names]) * unit, np.array([open_[i][1] for i in names]),
                cuts, starts, smallest,
            )
            splits, counted, sibling = {}, [], {}
            for i, split in zip(names, found):
                if split is None:
                    continue
                gain, f, left = split
                at = slice(starts[f], starts[f + 1])
                g, n = open_[i][0][at][left].sum(), open_[i][1][at][left].sum()
                children = len(nodes), len(nodes) + 1
                bins = np.flatnonzero(left)
                nodes[i] |= {
                    "gain": gain / nodes[i]["n"], "feature": f, "left": children[0], "right": children[1],
                    "values": bins.astype(float).tolist() if cuts[f] is None else [float(cuts[f][bins[-1]])],
                }
                nodes.append({"n": int(n), "g": int(g)})
                nodes.append({"n": nodes[i]["n"] - int(n), "g": nodes[i]["g"] - int(g)})
                splits[i] = (f, left, *children)
                small, large = sorted(children, key=lambda c: (nodes[c]["n"], c))
                if level + 1 < depth and nodes[large]["n"] >= 2 * smallest:
                    counted.append(small)
                    sibling[small] = (large, i)
            if not counted:
                last = splits
                break
            below = rows.grow(splits, counted)
            before, open_ = open_, {}
            for k, small in enumerate(counted):
                large, parent = sibling[small]
                open_[large] = before[parent] - below[:, k]
                if nodes[small]["n"] >= 2 * smallest:
                    open_[small] = below[:, k]
        weight = step if trees else 1.0
        means = np.array([node["g"] * unit / node["n"] for node in nodes])
        values = weight * means
        sums, wrong, squares = rows.begin(values, last)
        _describe(nodes, means, squares, 4.0 if trees else 1.0)
        trees.append(nodes)
        for split, of in zip(("train", "val"), wrong):
            mae, mse = (float(e) / together.ONE / k if k else math.nan for e, k in of.tolist())
            history.append((split, len(trees), mae, mse**0.5))
        errors.append(mse)
        if len(trees) >= most:
            break
        if len(trees) >= least and best_round(errors, patience) + patience <= len(trees):
            break
    return {"trees": trees, "history": history}


def _describe(nodes: list[dict], means: np.ndarray, squares: np.ndarray, unit: float) -> None:
    """Each node's mean, and the labels' sum and squares; inner nodes have those below them."""
    for i in reversed(range(len(nodes))):
        node = nodes[i]
        own = float(squares[i]) / together.ONE * unit
        if "left" in node:
            own = nodes[node["left"]]["squares"] + nodes[node["right"]]["squares"]
        node |= {"squares": own, "mean": float(means[i])}
        del node["g"]


# --- scores ------------------------------------------------------------------------


class Scorer:
    """Adds up the values of many trees for a batch of rows, all rows a level at a time.

    A tree is a table of the next node by node and bin; a leaf is its own next node.
    """

    def __init__(self, trees: list[list[dict]], weights: list[float], n_codes: int):
        used: dict[int, set[float]] = {}
        for node in (node for nodes in trees for node in nodes if "left" in node):
            used.setdefault(node["feature"], set()).update(node["values"] if node["feature"] else ())
        self.n_codes = n_codes
        self.features = sorted(used)
        self.cuts = [np.array(sorted(used[f])) if f else None for f in self.features]
        self.width = 1 + max([n_codes, *[len(c) for c in self.cuts if c is not None]])
        self.trees = [self._table(nodes, weight) for nodes, weight in zip(trees, weights)]

    def _table(self, nodes: list[dict], weight: float) -> tuple:
        bins, place = np.arange(self.width), {f: i for i, f in enumerate(self.features)}
        table = np.repeat(np.arange(len(nodes), dtype=np.int32)[:, None], self.width, axis=1)
        column, below = np.zeros(len(nodes), np.int32), np.zeros(len(nodes), int)
        for i in reversed(range(len(nodes))):
            node = nodes[i]
            if "left" not in node:
                continue
            column[i] = c = place[node["feature"]]
            cuts = self.cuts[c]
            if cuts is None:
                left = np.isin(bins, node["values"])
                # as in Spark, codes never seen go where more codes go
                left[self.n_codes] = len(node["values"]) > self.n_codes // 2
            else:
                left = bins <= np.searchsorted(cuts, node["values"][0])
            table[i] = np.where(left, node["left"], node["right"])
            below[i] = 1 + max(below[node["left"]], below[node["right"]])
        return column, table, int(below[0]), weight * np.array([node["mean"] for node in nodes])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Of rows of features, their sum over all trees."""
        found = np.zeros(len(x))
        for start in range(0, len(x), 8192):
            own = x[start : start + 8192]
            n, rows = len(own), np.arange(len(own))
            bins = np.empty((max(1, len(self.cuts)), n), np.int32)
            for c, (f, cuts) in enumerate(zip(self.features, self.cuts)):
                if cuts is None:
                    bins[c] = np.minimum(own[:, f], self.n_codes)
                else:
                    bins[c] = np.searchsorted(cuts, own[:, f])
            flat, total = bins.ravel(), found[start : start + 8192]
            for column, table, depth, values in self.trees:
                first, following = column.astype(np.intp) * n, table.ravel()
                node = np.zeros(n, np.intp)
                for _ in range(depth):
                    cell = flat.take(first.take(node) + rows)
                    node = following.take(node * self.width + cell).astype(np.intp)
                total += values.take(node)
        return found


def predict(model: GBTRegressionModel, assembled: DataFrame) -> DataFrame:
    """``transform`` of a model fitted here, by levels instead of row by row and tree by tree."""
    grown, n_codes = model.grown, model.n_codes
    scorer = Scorer(grown, list(model.treeWeights), n_codes)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            x = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, 1))
            yield pd.Series(scorer.scores(x))

    return assembled.withColumn(
        model.getPredictionCol(), scored(vector_to_array(model.getFeaturesCol()))
    )


# --- Spark's model ----------------------------------------------------------------


def _as_spark_model(
    spark, estimator: GBTRegressor, trees: list[list[dict]], n_features: int, n_codes: int
) -> GBTRegressionModel:
    """The trees as Spark stores them, read by Spark."""
    params = {p.name: v for p, v in estimator._paramMap.items()}
    defaults = {p.name: v for p, v in estimator._defaultParamMap.items()}

    def described(kind: str, uid: str, drop: tuple[str, ...] = (), **more) -> str:
        own, usual = ({k: v for k, v in d.items() if k not in drop} for d in (params, defaults))
        return json.dumps({
            "class": kind, "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": uid, "paramMap": own, "defaultParamMap": usual, **more,
        })

    step = estimator.getStepSize()
    heads = [
        (k, described(TREE_CLASS, f"{estimator.uid}_{k}", NOT_OF_A_TREE), step if k else 1.0)
        for k in range(len(trees))
    ]
    rows = [(k, row) for k, nodes in enumerate(trees) for row in _in_order(nodes, n_codes)]
    folder = scratch_folder(spark)
    top = described(MODEL_CLASS, estimator.uid, numFeatures=n_features, numTrees=len(trees))
    try:
        storage.write_text(spark, f"{folder}/metadata/part-00000", top)
        heads = spark.createDataFrame(heads, "_1 int, _2 string, _3 double")
        heads.coalesce(1).write.parquet(f"{folder}/treesMetadata")
        nodes = spark.createDataFrame(rows, NODES_DDL)
        nodes.coalesce(1).write.parquet(f"{folder}/data")
        return GBTRegressionModel.load(folder)
    finally:
        storage.delete(spark, folder)


def _in_order(nodes: list[dict], n_codes: int) -> list[tuple]:
    """The nodes of a tree, each before those below it, numbered in that order."""
    found: list[tuple] = []

    def visit(i: int) -> int:
        node, number = nodes[i], len(found)
        n, total = node["n"], node["mean"] * node["n"]
        impurity = max(0.0, node["squares"] / n - node["mean"] ** 2)
        found.append(())
        gain, left, right, split = -1.0, -1, -1, (-1, [], -1)
        if "left" in node:
            left, right = visit(node["left"]), visit(node["right"])
            gain = node["gain"]
            split = (node["feature"], node["values"], -1 if node["feature"] else n_codes)
        stats = [float(n), total, node["squares"]]
        found[number] = (number, node["mean"], impurity, stats, n, gain, left, right, split)
        return number

    visit(0)
    return found
