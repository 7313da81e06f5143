"""Boosted trees grown leaf by leaf from histograms, all rounds in one job.

Rows never move: every task keeps its rows with the leaf they are in (``together``), and adds up
gradients per open leaf, feature and bin. Only these sums are passed on, and every task finds the
same splits. Gradients are whole numbers (``SCALE`` a vehicle), so that sums, and with them the
trees, do not depend on how rows are spread over tasks.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationflow.plans import dataset as D
from stationflow.plans import together
from stationflow.plans.features import DEFAULT_SPEC, FeatureSpec

DELTA = "target_delta"
PREDICTED_DELTA = "predicted_delta"
SCALE = together.ONE  # 2^37 rows of errors up to 1,024 vehicles fit a 64-bit sum
CODE = "station_id_code"
HISTORY_DDL = "split string, round int, mae double, rmse double"
SPLITS = ("train", "val")


@dataclass(frozen=True)
class LeafSettings:
    """Boosting settings.

    A number falls into one of ``bins`` quantile bins of the train rows. A category goes left if it
    is among the at most ``most_categories`` first, or last, by mean gradient, smoothed by
    ``category_smoothing`` rows; such splits and their leaves carry the penalty ``category_l2``.
    Boosting stops when the absolute or the squared error of the val rows has not fallen for
    ``patience`` rounds. ``store_every`` has no effect: scores stay with the tasks.
    """

    rounds: int = 500
    step: float = 0.05
    leaves: int = 63
    min_rows_per_leaf: int = 50
    patience: int = 30
    bins: int = 255
    most_categories: int = 32
    category_smoothing: float = 10.0
    category_l2: float = 10.0
    store_every: int = 10


@dataclass(frozen=True)
class LeafModel:
    """Trees over named columns; a tree is nested splits with a ``value`` in each leaf.

    ``bounds`` holds the upper ends of a number's bins, None for a category.
    """

    columns: list[str]
    bounds: list[list[float] | None]
    start: float
    trees: list[dict] = field(default_factory=list)
    history: list[tuple[str, int, float, float]] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> LeafModel:
        read = json.loads(text)
        read["history"] = [tuple(row) for row in read["history"]]
        return cls(**read)


# --- rows ----------------------------------------------------------------------


def training_frame(
    df: DataFrame, codes: DataFrame, spec: FeatureSpec = DEFAULT_SPEC
) -> DataFrame:
    """Model columns beside all others; ``current_vehicles`` keeps the present value.

    Missing numbers stay null. Rows of a station without a code are left out.
    """
    keep = tuple(c for c in df.columns if c not in (*spec.columns[1:], "current_vehicles"))
    current = F.col(D.CURRENT).alias("current_vehicles")
    kept = df.drop("current_vehicles").select("*", current)
    framed = D.model_frame(kept, codes, spec, keep=(*keep, "current_vehicles"))
    return framed.where(F.col(CODE).isNotNull())


def bin_bounds(train: DataFrame, columns: list[str], bins: int) -> list[list[float] | None]:
    """Upper ends of the bins of each number: its distinct ``bins``-quantiles in the train rows."""
    numbers = [c for c in columns if c != CODE]
    at = F.array(*[F.lit((i + 1) / bins) for i in range(bins)])
    found = train.agg(
        *[F.percentile_approx(F.nanvl(c, F.lit(None)), at, F.lit(10_000)).alias(c) for c in numbers]
    ).first()
    return [None if c == CODE else sorted(set(found[c] or [])) for c in columns]


def _binned(values: np.ndarray, bounds: list[float] | None) -> np.ndarray:
    """Bin of each value, from 1; 0 if it is missing. A category's bin is its code plus one."""
    missing = np.isnan(values)
    if bounds is None:
        return np.where(missing, 0, np.nan_to_num(values) + 1).astype(np.int32)
    found = np.searchsorted(np.asarray(bounds, dtype=float), values, side="left") + 1
    return np.where(missing, 0, np.minimum(found, max(1, len(bounds)))).astype(np.int32)


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)


def _routed(tree: dict, bins: list[np.ndarray], n: int) -> Iterator[tuple[dict, np.ndarray]]:
    """The leaves of a tree, each with the places of its rows."""
    stack = [(tree, np.arange(n))]
    while stack:
        node, rows = stack.pop()
        if "feature" not in node:
            yield node, rows
            continue
        at = bins[node["feature"]][rows]
        if node["categories"] is not None:
            left = np.isin(at, node["categories"])
        else:
            left = (at <= node["bin"]) & (at > 0)
        if node["missing_left"]:
            left |= at == 0
        stack += [(node["right"], rows[~left]), (node["left"], rows[left])]


def _grown(scores: np.ndarray, trees: list[dict], bins: list[np.ndarray]) -> np.ndarray:
    scores = scores.copy()
    for tree in trees:
        for leaf, rows in _routed(tree, bins, len(scores)):
            scores[rows] += leaf["value"]
    return scores


def predict(model: LeafModel, framed: DataFrame) -> DataFrame:
    """Add ``predicted_delta``, of columns named as the model's; other columns stay in the JVM."""
    bounds, start, trees = model.bounds, model.start, model.trees

    @F.pandas_udf("double")
    def scored(*columns: pd.Series) -> pd.Series:
        bins = [_binned(c.to_numpy(float, na_value=np.nan), b) for c, b in zip(columns, bounds)]
        return pd.Series(_grown(np.full(len(columns[0]), start), trees, bins))

    inputs: list[Column] = [F.col(c).cast("double") for c in model.columns]
    return framed.withColumn(PREDICTED_DELTA, scored(*inputs))


# --- splits ------------------------------------------------------------------------


def best_split(
    bins: np.ndarray, g: np.ndarray, n: np.ndarray, category: bool, settings: LeafSettings
) -> dict | None:
    """The split of one leaf by one feature with the greatest gain; None if none gains.

    ``bins`` ascend and have rows. Ties: the first cut, missing right; categories from the least
    mean gradient. Where the leaf has no missing value, missing goes where more rows go.
    """
    g = g / SCALE
    total, rows = g.sum(), int(n.sum())
    l2 = settings.category_l2 if category else 0.0
    cuts = []  # sums and rows on the left per cut, and how to describe the cut
    if category:
        known = np.flatnonzero(bins > 0)
        mean = g[known] / (n[known] + settings.category_smoothing)
        for order in (np.lexsort((bins[known], mean)), np.lexsort((bins[known], -mean))):
            order = known[order][: settings.most_categories]
            cuts.append((g[order].cumsum(), n[order].cumsum(), order, False))
    else:
        absent = int(bins[0] == 0)
        order = np.arange(absent, len(bins))
        cuts.append((g[order].cumsum(), n[order].cumsum(), order, False))
        if absent:
            cuts.append((g[order].cumsum() + g[0], n[order].cumsum() + n[0], order, True))
    best = None
    for left_g, left_n, order, missing_left in cuts:
        right_g, right_n = total - left_g, rows - left_n
        ok = np.minimum(left_n, right_n) >= settings.min_rows_per_leaf
        if not ok.any():
            continue
        gain = np.full(len(order), -np.inf)
        gain[ok] = (
            left_g[ok] ** 2 / (left_n[ok] + l2)
            + right_g[ok] ** 2 / (right_n[ok] + l2)
            - total**2 / rows
        )
        i = int(gain.argmax())
        if gain[i] > 1e-9 and (best is None or gain[i] > best["gain"]):
            to_left = missing_left
            if not category and not absent:
                to_left = bool(2 * left_n[i] >= rows)
            best = {
                "gain": float(gain[i]),
                "bin": None if category else int(bins[order[i]]),
                "categories": sorted(int(b) for b in bins[order[: i + 1]]) if category else None,
                "missing_left": to_left,
                "left_g": round(float(left_g[i]) * SCALE), "left_n": int(left_n[i]),
                "right_g": round(float(right_g[i]) * SCALE), "right_n": int(right_n[i]),
                "l2": l2,
            }
    return best


def _best(sums: np.ndarray, starts: np.ndarray, categories: set[int], settings) -> dict | None:
    """A leaf's split with the greatest gain, by its sums per bin of all features; the first of equals."""
    best = None
    for f in range(len(starts) - 1):
        g, n = sums[:, starts[f] : starts[f + 1]]
        bins = np.flatnonzero(n)
        found = best_split(bins, g[bins], n[bins], f in categories, settings) if len(bins) else None
        if found and (best is None or found["gain"] > best["gain"]):
            best = {**found, "feature": f}
    return best


def _goes_left(split: dict, size: int) -> np.ndarray:
    """Which of a feature's bins a split passes to the left."""
    bins = np.arange(size)
    if split["categories"] is not None:
        left = np.isin(bins, split["categories"])
    else:
        left = (bins <= split["bin"]) & (bins > 0)
    left[0] |= split["missing_left"]
    return left


# --- growing ---------------------------------------------------------------------


class _Growing:
    """A tree that grows best leaf first, while splits of several leaves are looked up at once."""

    def __init__(self, settings: LeafSettings):
        self.settings = settings
        self.splits: dict[str, dict | None] = {}  # by path of L and R; absent: not looked up yet

    def choose(self) -> tuple[list[str], list[str]]:
        """Paths split, greatest gain first, and the leaves to be looked up before that is final."""
        if "" not in self.splits:
            return [], [""]
        chosen, unknown, open_ = [], [], []
        self._offer(open_, "")
        while open_ and len(chosen) < self.settings.leaves - 1:
            _, _, path = heapq.heappop(open_)
            chosen.append(path)
            if len(chosen) == self.settings.leaves - 1:
                break
            for side, rows in (("L", "left_n"), ("R", "right_n")):
                child = path + side
                if self.splits[path][rows] < 2 * self.settings.min_rows_per_leaf:
                    self.splits[child] = None
                if child in self.splits:
                    self._offer(open_, child)
                else:
                    unknown.append(child)
        return chosen, unknown

    def _offer(self, open_: list, path: str) -> None:
        if self.splits[path] is not None:
            heapq.heappush(open_, (-self.splits[path]["gain"], len(path), path))

    def tree(self, chosen: list[str], leaf) -> dict:
        """The nested tree of the chosen splits; ``leaf(path)`` makes its leaves."""
        inner = set(chosen)

        def node(path):
            if path not in inner:
                return leaf(path)
            split = self.splits[path]
            kept = {k: split[k] for k in ("feature", "bin", "categories", "missing_left")}
            return {**kept, "left": node(path + "L"), "right": node(path + "R")}

        return node("")

    def value(self, path: str) -> float:
        """A leaf's step against its gradient."""
        if not path:
            return 0.0
        split = self.splits[path[:-1]]
        side = "left" if path[-1] == "L" else "right"
        return -self.settings.step * split[f"{side}_g"] / SCALE / (split[f"{side}_n"] + split["l2"])


def stop_round(errors: list[tuple[float, float]], patience: int) -> int | None:
    """The best round, from 1, once a measure has not fallen for ``patience`` rounds; else None."""
    stops = []
    for measure in range(2):
        best = 0
        for place, error in enumerate(errors):
            if error[measure] < errors[best][measure]:
                best = place
            elif place - best >= patience:
                stops.append((place, measure, best + 1))
                break
    return min(stops)[2] if stops else None


def _grow(
    rows: together.Rows, sums: np.ndarray, settings: LeafSettings, categories: set[int]
) -> tuple[dict, np.ndarray, together.Splits] | None:
    """A tree, its step per numbered node, and its splits that no rows were passed through yet."""
    sizes, starts = rows.layout.sizes, rows.layout.starts
    growing, number, held = _Growing(settings), {"": 0}, {"": sums}
    growing.splits[""] = _best(sums, starts, categories, settings)
    if growing.splits[""] is None:
        return None

    def opened(parents: list[str]) -> together.Splits:
        splits = {}
        for path in parents:
            split = growing.splits[path]
            for side in "LR":
                number[path + side] = len(number)
            left = _goes_left(split, sizes[split["feature"]])
            splits[number[path]] = (split["feature"], left, number[path + "L"], number[path + "R"])
        return splits

    while (found := growing.choose())[1]:
        chosen, unknown = found
        parents = list(dict.fromkeys(path[:-1] for path in unknown))
        splits = opened(parents)
        small = [
            p + ("L" if growing.splits[p]["left_n"] <= growing.splits[p]["right_n"] else "R")
            for p in parents
        ]
        below = rows.grow(splits, [number[path] for path in small])
        for i, (parent, path) in enumerate(zip(parents, small)):
            own = below[:, i]
            other = parent + ("R" if path.endswith("L") else "L")
            for child, its in ((path, own), (other, held.pop(parent) - own)):
                if child not in growing.splits:
                    growing.splits[child] = _best(its, starts, categories, settings)
                    held[child] = its
    chosen = found[0]
    inner = set(chosen)
    last = opened([path for path in chosen if path + "L" not in number])

    def leaf_of(path: str) -> str:
        return next(path[:i] for i in range(len(path) + 1) if path[:i] not in inner)

    # a node split in vain, while the best order was not known yet, is no node of the tree
    tree = growing.tree(chosen, lambda path: {"value": growing.value(path)})
    values = np.zeros(len(number))
    for path, i in number.items():
        if path not in inner:
            values[i] = growing.value(leaf_of(path))
    return tree, values, last


def _boost(rows: together.Rows, settings: LeafSettings, categories: set[int], start: float) -> dict:
    """All trees and the errors after each; the same in all tasks."""
    trees, history, values, last = [], [], None, None
    rows.start(start)
    while True:
        sums, wrong, _ = rows.begin(values, last)
        for split, ((mae, n), (mse, _)) in zip(SPLITS, wrong.tolist()):
            if trees and n:
                history.append((split, len(trees), mae / SCALE / n, (mse / SCALE / n) ** 0.5))
        errors = [(h[2], h[3]) for h in history if h[0] == "val"]
        if len(trees) >= settings.rounds or stop_round(errors, settings.patience) is not None:
            break
        grown = _grow(rows, sums, settings, categories)
        if grown is None:
            break
        tree, values, last = grown
        trees.append(tree)
    return {"trees": trees, "history": history}


def fit(
    framed: DataFrame,
    settings: LeafSettings = LeafSettings(),
    spec: FeatureSpec = DEFAULT_SPEC,
) -> LeafModel:
    """Boost on the train rows of ``training_frame``; keep the trees up to the best val round.

    Rows without a target and other splits are left out. Without train rows there are no trees and
    the change is 0; without val rows all rounds are kept. When an executor is lost, the fit begins
    anew.
    """
    columns = D.model_columns(spec)
    rows = framed.where(F.col("split").isin(*SPLITS) & F.col(DELTA).isNotNull()).select(
        (F.col("split") == "val").alias("is_val"),
        F.col(DELTA).cast("double").alias("y"),
        *[F.col(c).cast("double").alias(c) for c in columns],
    )
    start, last_code = rows.agg(F.expr("avg(y) FILTER (WHERE NOT is_val)"), F.max(CODE)).first()
    bounds = bin_bounds(rows.where("NOT is_val"), columns, settings.bins)
    model = LeafModel(columns, bounds, float(start or 0.0))
    if start is None:
        return model
    categories = {i for i, c in enumerate(columns) if c == CODE}
    codes = 0 if last_code is None else int(last_code) + 1
    layout = together.Layout.of([1 + (codes if b is None else max(1, len(b))) for b in bounds])

    def bins_of(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [_binned(_numbers(c), b) for c, b in zip(batch.columns[2:], bounds)]

    def work(own: together.Rows) -> str:
        return json.dumps(_boost(own, settings, categories, model.start))

    found = json.loads(together.run(together.blocks(rows, layout, bins_of), layout, work))
    model.trees.extend(found["trees"])
    model.history.extend(tuple(row) for row in found["history"])
    val_errors = [(h[2], h[3]) for h in model.history if h[0] == "val"]
    stop = stop_round(val_errors, settings.patience)
    if stop is None and val_errors:
        stop = min(range(len(val_errors)), key=lambda i: val_errors[i][0]) + 1
    del model.trees[stop if stop is not None else len(model.trees):]
    return model


def round_history(model: LeafModel, df: DataFrame) -> DataFrame:
    """Error after every round on the train and val rows, measured while training."""
    return df.sparkSession.createDataFrame(sorted(model.history), HISTORY_DDL)
