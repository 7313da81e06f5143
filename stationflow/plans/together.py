"""Rows of a boosted fit held by tasks that run at the same time and add up sums of gradients.

Every task of a barrier stage keeps its share of the rows, binned, in files on its own disk, for the
whole fit. A tree grows by passes over them: open leaves pass their rows on to two children, the
smaller child is counted, its sibling is the parent less it, and the tasks add up their sums through
small files on the shared folder. All tasks then know the same whole numbers and grow the same tree,
so that no job has to be started for a level, and no row is read, written or moved again.
"""

from __future__ import annotations

import base64
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.session import scratch_folder
from stationflow.sources import storage

CELLS = 2048  # of features counted side by side as one column, at most
CHUNK = 1 << 15  # rows of a pass at a time
VISIBLE_AFTER = 120.0  # seconds, at most, until a file of one task is seen by another
AT_ONCE = 1 << 22  # bytes of all tasks' sums that each of them reads whole
BLOCK_DDL = "is_val boolean, n int, y binary, cells binary"
TRAIN, VAL = 0, 1
ONE = 1 << 16  # an error of one vehicle, as a whole number
# by node: a feature, which of its bins go left, and the numbers of the children
Splits = dict[int, tuple[int, np.ndarray, int, int]]


# --- how features become columns ---------------------------------------------------


@dataclass(frozen=True)
class Layout:
    """Features of ``sizes`` bins, several small ones side by side in a column.

    A column's cell is the sum of ``bin * stride`` over its features.
    """

    sizes: list[int]
    columns: list[list[int]]
    strides: list[int]
    widths: list[int]

    @classmethod
    def of(cls, sizes: list[int]) -> Layout:
        columns, widths, strides = [], [], [1] * len(sizes)
        for f in sorted(range(len(sizes)), key=lambda f: -sizes[f]):
            for c, width in enumerate(widths):
                if width * sizes[f] <= CELLS:
                    strides[f], widths[c] = width, width * sizes[f]
                    columns[c].append(f)
                    break
            else:
                columns.append([f])
                widths.append(sizes[f])
        return cls(list(sizes), columns, strides, widths)

    @property
    def dtype(self) -> type:
        return np.uint16 if max(self.widths) <= 1 << 16 else np.uint32

    @property
    def starts(self) -> np.ndarray:
        """Where each feature's bins begin in an array of all of them."""
        return np.concatenate([[0], np.cumsum(self.sizes)])

    def column_of(self, feature: int) -> int:
        return next(c for c, fs in enumerate(self.columns) if feature in fs)

    def cells(self, bins: list[np.ndarray]) -> np.ndarray:
        found = np.zeros((len(self.columns), len(bins[0])), self.dtype)
        for c, features in enumerate(self.columns):
            for f in features:
                found[c] += (bins[f] * self.strides[f]).astype(self.dtype)
        return found

    def bins(self, feature: int) -> np.ndarray:
        """The feature's bin in each cell of its column."""
        cells = np.arange(self.widths[self.column_of(feature)])
        return cells // self.strides[feature] % self.sizes[feature]

    def by_feature(self, column: int, sums: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """Sums per slot and cell of a column, as sums per slot and bin of its features."""
        shape = [self.sizes[f] for f in reversed(self.columns[column])]
        cube = sums.reshape(len(sums), *shape)
        axes = range(1, cube.ndim)
        return [
            (f, cube.sum(axis=tuple(a for a in axes if a != cube.ndim - 1 - i)))
            for i, f in enumerate(self.columns[column])
        ]


def blocks(rows: DataFrame, layout: Layout, bins_of: Callable) -> DataFrame:
    """Rows ``(is_val, y, ...)`` as blocks of cells; ``bins_of(batch)`` gives a bin per feature."""

    def packed(batches):
        for batch in batches:
            y = batch.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            if np.isnan(y).any():
                raise ValueError("a row of the fit has no target")
            is_val = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            cells = layout.cells(bins_of(batch))
            found = []
            for val in (False, True):
                own = is_val == val
                if own.any():
                    found.append((val, int(own.sum()), y[own].tobytes(), cells[:, own].tobytes()))
            kinds = (pa.bool_(), pa.int32(), pa.binary(), pa.binary())
            arrays = [pa.array([b[i] for b in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["is_val", "n", "y", "cells"])

    return rows.mapInArrow(packed, BLOCK_DDL)


# --- tasks that add up ---------------------------------------------------------------


class Peers:
    """The tasks of a stage, adding up arrays of whole numbers through files in a shared folder.

    Where the folder is not a folder for Python, sums go by way of the driver: right, but slow.
    """

    def __init__(self, folder: str | None, size: int):
        self.size, self.step = size, 0
        if size == 1:
            self.rank = 0
            return
        self.context = BarrierTaskContext.get()
        self.rank, self.folder = self.context.partitionId(), None
        if folder is not None:
            # tasks of another attempt have another name
            name = self.context.allGather(uuid.uuid4().hex)[0]
            self.folder = f"{folder}/{name}"
            os.makedirs(self.folder, exist_ok=True)
            self._put("here", b"")
            for r in range(size):
                self._get("here", r, patience=VISIBLE_AFTER)

    def _put(self, name: str, content: bytes) -> None:
        path = f"{self.folder}/{name}-{self.rank}"
        with open(path + ".part", "wb") as file:
            file.write(content)
        os.replace(path + ".part", path)

    def _get(
        self, name: str, rank: int, start: int = 0, size: int = -1, patience: float = np.inf
    ) -> np.ndarray:
        path, pause = f"{self.folder}/{name}-{rank}", 0.0002
        end = time.monotonic() + patience
        # a stage whose task fails is ended whole, waiting tasks with it
        while not os.path.exists(path):
            if time.monotonic() > end:
                raise ValueError(f"not every executor sees {self.folder}: name a shared folder")
            time.sleep(pause)
            pause = min(2 * pause, 0.005)
        with open(path, "rb") as file:
            file.seek(start)
            return np.frombuffer(file.read(size), np.int64)

    def sum(self, own: np.ndarray) -> np.ndarray:
        """The sum of every task's array, equal in all of them."""
        if self.size == 1:
            return own
        everyone = range(self.size)
        if self.folder is None:
            sent = self.context.allGather(base64.b64encode(own.tobytes()).decode())
            return np.sum([np.frombuffer(base64.b64decode(s), np.int64) for s in sent], axis=0)
        now = f"sum{self.step}"
        self._put(now, own.tobytes())
        if own.nbytes * self.size <= AT_ONCE:
            total = np.sum([self._get(now, r) for r in everyone], axis=0)
        else:  # each adds up a part and passes it on
            cuts = [len(own) * r // self.size for r in range(self.size + 1)]
            at, end = cuts[self.rank], cuts[self.rank + 1]
            part = np.zeros(end - at, np.int64)
            for r in everyone:
                part += self._get(now, r, 8 * at, 8 * (end - at))
            self._put(now + "part", part.tobytes())
            total = np.concatenate([self._get(now + "part", r) for r in everyone])
        # whoever has put this step's file has read those of the step before
        for name in (f"sum{self.step - 1}", f"sum{self.step - 1}part"):
            if os.path.exists(f"{self.folder}/{name}-{self.rank}"):
                os.remove(f"{self.folder}/{name}-{self.rank}")
        self.step += 1
        return total


def slots(spark: SparkSession) -> int:
    """How many tasks of a fit may run at the same time; one where executors come and go."""
    if spark.conf.get("spark.dynamicAllocation.enabled", "false") == "true":
        return 1
    context = spark.sparkContext._jsc.sc()
    profile = context.resourceProfileManager().defaultResourceProfile()
    return max(1, min(context.defaultParallelism(), context.maxNumConcurrentTasks(profile)))


def run(packed: DataFrame, layout: Layout, work: Callable[[Rows], str]) -> str:
    """What ``work`` returns, which every task runs on its share of the ``blocks``."""
    spark = packed.sparkSession
    size, shared = slots(spark), scratch_folder(spark)
    scheme, _, path = shared.partition(":")
    local = shared if shared.startswith("/") else "/" + path.lstrip("/") if scheme == "file" else None

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peers = Peers(local, size)
        result = work(Rows(batches, layout, peers))
        if peers.rank == 0:
            yield pa.RecordBatch.from_pydict({"result": [result]})

    dealt = packed.repartition(size)
    try:
        found = dealt.mapInArrow(together, "result string", barrier=size > 1)
        # one row; Spark tries a barrier stage again only if another follows it
        return found.repartition(1).collect()[0].result
    finally:
        storage.delete(spark, shared)


# --- a task's rows -------------------------------------------------------------------


def _on_disk(file, shape: tuple[int, ...], dtype) -> np.ndarray:
    """An array in a file that goes with the process; memory holds what is in use."""
    size = int(np.prod(shape)) * np.dtype(dtype).itemsize
    if not size:
        return np.zeros(shape, dtype)
    file.truncate(size)
    return np.memmap(file, dtype, "r+", shape=shape)


def _scratch():
    folder = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    return tempfile.TemporaryFile(dir=folder if os.path.isdir(folder) else None)


class _Part:
    """Train or val rows: cells by chunk, target, score, gradient and leaf."""

    def __init__(self, n: int, cells, y, layout: Layout):
        self.n, width = n, len(layout.columns)
        self.cells = _on_disk(cells, (width * n,), layout.dtype)
        self.y = _on_disk(y, (n,), np.float64)
        self.score = _on_disk(_scratch(), (n,), np.float64)
        self.g = _on_disk(_scratch(), (n,), np.float64)
        self.node = _on_disk(_scratch(), (n,), np.int32)
        self.width = width

    def chunks(self) -> Iterator[tuple[slice, np.ndarray]]:
        for start in range(0, self.n, CHUNK):
            end = min(self.n, start + CHUNK)
            at = self.cells[self.width * start : self.width * end]
            yield slice(start, end), np.asarray(at).reshape(self.width, end - start)


class Rows:
    """A task's share of the rows, and the sums of all tasks."""

    def __init__(self, batches: Iterator[pa.RecordBatch], layout: Layout, peers: Peers):
        self.layout, self.peers = layout, peers
        files = [(_scratch(), _scratch()) for _ in range(2)]
        counts, held = [0, 0], [[], []]

        def write(val: int, rows: int) -> None:
            """The first rows of those held, one chunk."""
            y = np.concatenate([h[0] for h in held[val]])
            cells = np.concatenate([h[1] for h in held[val]], axis=1)
            files[val][0].write(np.ascontiguousarray(cells[:, :rows]).tobytes())
            files[val][1].write(y[:rows].tobytes())
            counts[val] += rows
            held[val] = [(y[rows:], cells[:, rows:])]

        for batch in batches:
            for is_val, n, y, cells in zip(*[batch.column(i).to_pylist() for i in range(4)]):
                val = VAL if is_val else TRAIN
                found = np.frombuffer(cells, layout.dtype).reshape(len(layout.columns), n)
                held[val].append((np.frombuffer(y), found))
                while sum(len(h[0]) for h in held[val]) >= CHUNK:
                    write(val, CHUNK)
        for val in (TRAIN, VAL):
            left = sum(len(h[0]) for h in held[val])
            if left:
                write(val, left)
            for file in files[val]:
                file.flush()
        self.parts = [_Part(counts[val], *files[val], layout) for val in (TRAIN, VAL)]
        self.scale = ONE  # of the gradients

    def start(self, score: float) -> None:
        for part in self.parts:
            part.score[:] = score

    def begin(
        self, values: np.ndarray | None, splits: Splits | None = None
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Add the last tree's value per node to the scores and put all rows back in node 0.

        Its last splits, which nothing was counted for, come first. Gives the sums of gradients
        and rows per bin; per split and measure (absolute and squared error) the error and its
        rows; and the squares of the train rows' old errors per node.
        """
        wrong = np.zeros((2, 2, 2), np.int64)
        squares = np.zeros(0 if values is None else len(values), np.int64)
        sums, route = self._zeros(1), self._route(splits)
        for s, part in enumerate(self.parts):
            for at, cells in part.chunks():
                node = np.asarray(part.node[at])
                if route:
                    route(node, cells)
                if values is not None:
                    if s == TRAIN:
                        off = (part.score[at] - part.y[at]) ** 2
                        by_node = np.bincount(node, weights=off, minlength=len(values))
                        squares += np.rint(by_node * ONE).astype(np.int64)
                    part.score[at] += values[node]
                off = part.score[at] - part.y[at]
                for m, error in enumerate((np.abs(off), off**2)):
                    wrong[s, m] += (int(np.rint(error * ONE).sum()), len(off))
                node[:] = 0
                if s == TRAIN:
                    part.g[at] = g = np.rint(off * self.scale)
                    self._add(sums, np.zeros(len(g), np.int64), cells, g)
        total = self.peers.sum(np.concatenate([wrong.ravel(), squares, self._flat(sums)]))
        wrong, squares, total = np.split(total, [8, 8 + len(squares)])
        return total.reshape(2, -1), wrong.reshape(2, 2, 2), squares

    def grow(self, splits: Splits, counted: list[int]) -> np.ndarray:
        """Pass the rows of nodes on to two children each; sums per bin of the nodes ``counted``."""
        route, sums = self._route(splits), self._zeros(len(counted))
        slot_of = np.full(max(max(s[2:]) for s in splits.values()) + 1, -1)
        slot_of[counted] = np.arange(len(counted))
        for s, part in enumerate(self.parts):
            for at, cells in part.chunks():
                node = np.asarray(part.node[at])
                moved = route(node, cells)
                if s == TRAIN:
                    slot = slot_of.take(node.take(moved))
                    used = np.flatnonzero(slot >= 0)
                    rows = moved.take(used)
                    g = np.asarray(part.g[at]).take(rows)
                    self._add(sums, slot.take(used), cells.take(rows, axis=1), g)
        return self.peers.sum(self._flat(sums)).reshape(2, len(counted), -1)

    def _route(self, splits: Splits | None) -> Callable | None:
        """A function that passes a chunk's rows on, in place, and tells which have moved."""
        if not splits:
            return None
        top = max(max(s[2:]) for s in splits.values()) + 1
        column, offset, tables, size = np.full(top, -1), np.zeros(top, np.int64), [], 0
        for node, (feature, left, to_left, to_right) in splits.items():
            column[node], offset[node] = self.layout.column_of(feature), size
            tables.append(np.where(left[self.layout.bins(feature)], to_left, to_right))
            size += len(tables[-1])
        table = np.concatenate(tables).astype(np.int32)

        def route(node: np.ndarray, cells: np.ndarray) -> np.ndarray:
            own, n = column.take(node), len(node)
            if own.min(initial=0) >= 0:
                moved, before = np.arange(n), node
            else:
                moved = np.flatnonzero(own >= 0)
                own, before = own.take(moved), node.take(moved)
            cell = cells.reshape(-1).take(own * n + moved)
            after = table.take(offset.take(before) + cell)
            if len(after) == n:
                node[:] = after
            else:
                node[moved] = after
            return moved

        return route

    def _zeros(self, n: int) -> list[np.ndarray]:
        return [np.zeros((2, n, width), np.int64) for width in self.layout.widths]

    def _add(self, sums: list[np.ndarray], slot: np.ndarray, cells: np.ndarray, g: np.ndarray) -> None:
        for total, column, width in zip(sums, cells, self.layout.widths):
            key, shape = slot * width + column, total.shape[1:]
            size = total[0].size
            # a chunk's sum of whole numbers is exact in a double
            total[0] += np.bincount(key, weights=g, minlength=size).astype(np.int64).reshape(shape)
            total[1] += np.bincount(key, minlength=size).reshape(shape)

    def _flat(self, sums: list[np.ndarray]) -> np.ndarray:
        """Sums of gradients and of rows by slot and bin, the features one after the other."""
        found = []
        for kind in range(2):
            per: dict[int, np.ndarray] = {}
            for c, total in enumerate(sums):
                per |= dict(self.layout.by_feature(c, total[kind]))
            found.append(np.concatenate([per[f] for f in range(len(self.layout.sizes))], axis=1))
        return np.stack(found).ravel()
