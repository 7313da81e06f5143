"""Benchmark decontamination by suffix arrays of the training text.

Documents are cut into shards of whole texts. A shard's words become numbers of the items' lexicon
(0 for every other word), and its suffixes are sorted by prefix doubling as far as the longest item
goes. Every suffix of every item is then looked up by binary search, one word deeper at a time: the
interval that is left after a window's length holds all places of that window, and the depth at which
it becomes empty is the suffix's longest verbatim match in the shard.

Stretches of known words that are shorter than the shortest window hold no match and are not sorted.
Documents are never shuffled; the items travel in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.lexicon import BLOCK_BYTES, Lexicon, Words, item_blocks, stretches
from stationflow.llm.text import documents

#: Words of a window; an item of fewer words is one window.
WINDOW_WORDS = 10
#: Bytes of text whose suffixes are sorted together; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20


class Items:
    """A block of items: their words as numbers, their suffixes, and their distinct windows."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW_WORDS):
        texts = pa.array([text for _, text in rows], pa.large_string())
        self.names = ["" if name is None else str(name) for name, _ in rows]
        self.ids = [name for name, _ in rows]
        self.lexicon = Lexicon(texts)
        self.codes = np.append(self.lexicon.codes, 0)
        starts = self.lexicon.starts
        counts = np.diff(starts)
        need = np.minimum(counts, window)
        self.least = int(need[need > 0].min()) if (need > 0).any() else 0
        self.longest = int(counts.max()) if len(counts) else 0
        # suffixes with room for a window
        suffixes = np.where(counts > 0, counts - need + 1, 0)
        self.item = np.repeat(np.arange(len(rows)), suffixes)
        self.place = np.arange(len(self.item)) - (np.cumsum(suffixes) - suffixes)[self.item]
        self.at = starts[self.item] + self.place
        self.need = need[self.item]
        self.room = counts[self.item] - self.place
        # windows of equal words are one; each knows its items
        seen: dict[tuple[int, bytes], int] = {}
        self.window = np.zeros(len(self.at), np.int64)
        owners: list[set[int]] = []
        for i, (at, n, item) in enumerate(
            zip(self.at.tolist(), self.need.tolist(), self.item.tolist())
        ):
            number = seen.setdefault((n, self.codes[at : at + n].tobytes()), len(seen))
            if number == len(owners):
                owners.append(set())
            owners[number].add(item)
            self.window[i] = number
        self.owners = [sorted(o) for o in owners]
        self.first = np.unique(self.window, return_index=True)[1]


class SuffixArray:
    """Suffixes of a sequence of numbers, sorted by their first ``depth`` places; 0 ends a stretch."""

    def __init__(self, codes: np.ndarray, depth: int):
        self.codes = np.append(codes, 0).astype(np.int64)
        rank, reach = self.codes, 1
        while reach < depth:
            later = np.zeros_like(rank)
            later[:-reach] = rank[reach:]
            values, rank = np.unique(rank * (int(rank.max()) + 1) + later, return_inverse=True)
            reach *= 2
            if len(values) == len(rank):
                break
        order = np.argsort(rank, kind="stable")
        self.order = order[self.codes[order] > 0]

    def _bound(self, low, high, depth: int, word: np.ndarray, after: bool) -> np.ndarray:
        low, high = low.copy(), high.copy()
        open_ = np.flatnonzero(low < high)
        while len(open_):
            middle = (low[open_] + high[open_]) >> 1
            found = self.codes[self.order[middle] + depth]
            up = found <= word[open_] if after else found < word[open_]
            low[open_[up]] = middle[up] + 1
            high[open_[~up]] = middle[~up]
            open_ = open_[low[open_] < high[open_]]
        return low

    def search(
        self, codes: np.ndarray, at: np.ndarray, need: np.ndarray, room: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For every test suffix: its places (an interval of ``order``) at depth ``need``, the length
        of its longest match, and one place of that.
        """
        n = len(at)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order), np.int64)
        found_low, found_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
        length, example = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        active, depth = np.arange(n), 0
        while len(active):
            word = codes[at[active] + depth]
            lower = self._bound(low[active], high[active], depth, word, False)
            upper = self._bound(lower, high[active], depth, word, True)
            depth += 1
            hit = lower < upper
            active, lower, upper = active[hit], lower[hit], upper[hit]
            low[active], high[active] = lower, upper
            length[active], example[active] = depth, self.order[lower]
            whole = need[active] == depth
            found_low[active[whole]], found_high[active[whole]] = lower[whole], upper[whole]
            active = active[room[active] > depth]
        return found_low, found_high, length, example


class Shard:
    """Texts against a block of items."""

    def __init__(self, texts: pa.Array, items: Items):
        self.items = items
        self.words = Words(texts)
        self.counts = np.diff(self.words.starts)
        codes = items.lexicon.look_up(self.words)
        while True:
            self._match(codes)
            wrong = [
                i for i in np.flatnonzero(self.hit).tolist()
                if not items.lexicon.is_word(self.words, i, int(codes[i]))
            ]
            if not wrong:
                break
            codes[wrong] = 0  # another word of the same hash

    def _match(self, codes: np.ndarray) -> None:
        items, n = self.items, len(codes)
        text = np.repeat(np.arange(len(self.counts)), self.counts)
        # every text between zeros; stretches of known words too short for a window left out
        flat = np.zeros(n + len(self.counts) + 1, np.int32)
        flat[np.arange(n) + text + 1] = codes
        breaks = np.flatnonzero(flat == 0)
        lengths = np.diff(breaks)
        long_enough = lengths > max(items.least, 1)
        kept = np.zeros(len(flat), bool)
        kept[breaks[0] + 1 :] = np.repeat(long_enough, lengths)
        places = np.flatnonzero(kept)
        array = SuffixArray(flat[places], items.longest)
        low, high, self.length, example = array.search(items.codes, items.at, items.need, items.room)
        # places of the distinct windows
        first = items.first
        low, sizes = low[first], high[first] - low[first]
        window = np.repeat(np.arange(len(first)), sizes)
        offsets = np.arange(len(window)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        spot = places[array.order[np.repeat(low, sizes) + offsets]]
        owner = np.searchsorted(self.words.starts + np.arange(len(self.counts) + 1) + 1, spot, "right") - 1
        start = spot - owner - 1
        change = np.zeros(n + 1, np.int32)
        np.add.at(change, start, 1)
        np.add.at(change, start + items.need[first][window], -1)
        self.hit = np.cumsum(change[:-1]) > 0
        self.pairs = np.unique(owner * max(len(first), 1) + window)
        # the place of each suffix's longest match
        known = example >= 0
        where = places[example[known]]
        self.matched = np.flatnonzero(known)
        self.text = np.searchsorted(
            self.words.starts + np.arange(len(self.counts) + 1) + 1, where, "right") - 1
        self.start = where - self.text - 1 - self.words.starts[self.text]

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one hit word of every stretch of hits, and how many each text has."""
        starts = self.words.starts
        edge = np.zeros(len(self.hit) + 1, bool)
        edge[1:-1] = self.hit[1:] != self.hit[:-1]
        edge[starts] = True
        edge[0] = edge[-1] = True
        places = np.flatnonzero(edge)
        inside = self.hit[places[:-1]] if len(places) > 1 else np.zeros(0, bool)
        first, last = places[:-1][inside], places[1:][inside]
        text = np.searchsorted(starts, first, "right") - 1
        flat = np.stack([first - starts[text], last - starts[text]], 1).reshape(-1)
        return flat, 2 * np.bincount(text, minlength=len(self.counts))

    def found_items(self) -> list[list[str]]:
        """Names of the items with a window in each text."""
        found: dict[int, set[int]] = {}
        for pair in self.pairs.tolist():
            text, window = divmod(pair, max(len(self.items.first), 1))
            found.setdefault(text, set()).update(self.items.owners[window])
        names = self.items.names
        return [
            sorted({names[i] for i in found[t]}) if t in found else [] for t in range(len(self.counts))
        ]


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``n_words``, ``spans`` (first word, words) inside windows of items, ``items``.

    One row per input row. A null or empty text has no words; a null id stays null; repeated rows
    are searched each; other columns are not read. Repeated items count once; an item without words
    has no window; a null item id is named by the empty string. No items: nothing is hit.
    """
    rows = docs.select(F.col(id_column).alias("row"), F.col(text_column).alias("text"))
    found = _pass_blocks(rows, items, item_id, item_text, window, block_bytes)
    return found.withColumnRenamed("row", id_column)


def _pass_blocks(rows, items, item_id, item_text, window, block_bytes) -> DataFrame:
    """The rows through every block of items; blocks follow each other in one stage."""
    context = rows.sparkSession.sparkContext
    found = rows.select(
        "row", "text", F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<bigint>").alias("ends"), F.array().cast("array<string>").alias("items"),
    )
    blocks = item_blocks(items, item_id, item_text, block_bytes)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        shared = context.broadcast(Items(block, window))
        found = _one_block(found, shared, keep_text=following is not None)
        block = following
    spans = F.transform(
        F.when(F.size("ends") > 0, F.sequence(F.lit(0), F.size("ends") - 1, F.lit(2)))
        .otherwise(F.array().cast("array<int>")),
        lambda i: F.struct(
            F.get("ends", i).alias("first"), (F.get("ends", i + 1) - F.get("ends", i)).alias("words")
        ),
    )
    return found.select("row", "n_words", spans.alias("spans"), "items")


def _merged(old: list[int], new: list[int]) -> list[int]:
    """The union of two lists of spans ``first, end, first, end, ...``."""
    spans = sorted(zip([*old[::2], *new[::2]], [*old[1::2], *new[1::2]]))
    out: list[int] = []
    for first, end in spans:
        if out and first <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [first, end]
    return out


def _one_block(rows: DataFrame, shared, keep_text: bool) -> DataFrame:
    """The rows with what a block of items adds; ``ends`` are first and end of every hit span."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in stretches(whole.column("text"), SHARD_BYTES):
                batch = whole.slice(low, high - low)
                shard = Shard(batch.column("text"), shared.value)
                spans, sizes = shard.spans()
                to = np.cumsum(sizes).tolist()
                ends = [spans[b - n : b].tolist() for b, n in zip(to, sizes.tolist())]
                names = shard.found_items()
                earlier = zip(batch.column("ends").to_pylist(), batch.column("items").to_pylist())
                for i, (old_ends, old_names) in enumerate(earlier):
                    if old_ends:
                        ends[i] = _merged(old_ends, ends[i])
                        names[i] = sorted({*old_names, *names[i]})
                columns = {"row": batch.column("row"), "text": batch.column("text")}
                if not keep_text:
                    del columns["text"]
                columns |= {
                    "n_words": pa.array(shard.counts, pa.int64()),
                    "ends": pa.array(ends, pa.list_(pa.int64())),
                    "items": pa.array(names, pa.list_(pa.string())),
                }
                yield pa.record_batch(list(columns.values()), names=list(columns))

    kept = rows if keep_text else rows.drop("text")
    return rows.mapInArrow(search, kept.schema)


def remove_contaminated(
    docs: DataFrame, items: DataFrame, text_column: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW_WORDS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without any window of any item, with all their columns, whatever their names.

    Rows are judged where they are, so repeated rows, null ids and null texts need no key.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       F.col(text_column).alias("text"))
    found = _pass_blocks(rows, items, item_id, item_text, window, block_bytes)
    return found.where(F.size("items") == 0).select("row.*")


def longest_matches(
    docs: DataFrame,
    items: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Each item's suffix with its longest verbatim match in the documents, and where that is.

    ``item_id, place`` (its first word), ``words`` (length of the match), ``doc`` and ``start`` (one
    of the places it stands at). Suffixes whose match is shorter than a window are left out. A task
    reports one row per suffix and shard; they are reduced before the shuffle.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    name = items.schema[item_id].dataType.simpleString()
    found = None
    for block in item_blocks(items, item_id, item_text, block_bytes):
        shared = rows.sparkSession.sparkContext.broadcast(Items(block, window))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held = shared.value
            for whole in batches:
                for low, high in stretches(whole.column("text"), SHARD_BYTES):
                    batch = whole.slice(low, high - low)
                    shard = Shard(batch.column("text"), held)
                    full = shard.length[shard.matched] >= held.need[shard.matched]
                    suffix, text = shard.matched[full], shard.text[full]
                    ids = whole.schema.field("id").type
                    yield pa.record_batch(
                        [
                            pa.array(suffix, pa.int64()),
                            pa.array(shard.length[suffix], pa.int64()),
                            batch.column("id").take(pa.array(text, pa.int64())).cast(ids),
                            pa.array(shard.start[full], pa.int64()),
                        ],
                        names=["suffix", "words", "doc", "start"],
                    )

        part = rows.mapInArrow(search, f"suffix bigint, words bigint, doc {kind}, start bigint")
        best = part.groupBy("suffix").agg(
            F.max(F.struct("words", "doc", "start")).alias("best")
        )
        held = Items(block, window)
        names = rows.sparkSession.createDataFrame(
            [(i, held.ids[n], p) for i, (n, p) in enumerate(zip(held.item.tolist(), held.place.tolist()))],
            f"suffix bigint, item_id {name}, place bigint",
        )
        own = best.join(names, "suffix").select("item_id", "place", "best.*")
        found = own if found is None else found.unionByName(own)
    return found


def decontamination_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["words"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


DECONTAMINATION_SQL = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), b AS (
    SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), w AS (
    SELECT DISTINCT item, need, array_to_string(words[i : i + need - 1], ' ') AS win
    FROM (SELECT item, words, least(len(words), 10) AS need, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i
          FROM b WHERE len(words) > 0)
), s AS (
    SELECT row, need, i, array_to_string(words[i : i + need - 1], ' ') AS win
    FROM (SELECT row, words, need, unnest(range(1, len(words) - need + 2)) AS i
          FROM d, (SELECT DISTINCT need FROM w) WHERE len(words) >= need)
), f AS (
    SELECT s.row, s.need, s.i, w.item FROM s JOIN w ON s.win = w.win AND s.need = w.need
), h AS (
    SELECT row, count(DISTINCT p) AS n_hit
    FROM (SELECT DISTINCT row, need, unnest(range(i, i + need)) AS p FROM f) GROUP BY row
), n AS (
    SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT row, item FROM f) GROUP BY row
)
SELECT d.doc_id, CAST(len(d.words) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit,
    coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
    coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.row = h.row LEFT JOIN n ON d.row = n.row
"""
