"""Periodic runs of words, by Kruskal's order over the longest common prefixes of suffixes.

The suffixes of each text's words are sorted by prefix doubling, and neighbours in that order are
edges weighted by their longest common prefix (LCP). Edges are taken by falling LCP; union-find keeps
classes of suffixes, each with the ordered set of its positions. When two classes meet at LCP ``l``,
every two positions that become neighbours in the united set share exactly ``l`` words: at a distance
``d`` up to ``l`` the words from the first on repeat with period ``d`` for ``d + l`` words. No other
position of the class lies between them, so ``d`` is the smallest period there, and a run's first
position meets the one a period later in exactly one such union. Seeds that go on to the left are
parts of the run that begins there and are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.lexicon import stretches
from stationflow.llm.text import documents, words_of

#: A run repeats its period so many times, and has so many words, at least.
EXPONENT = 4
RUN_WORDS = 6
#: Bytes of text whose suffixes are sorted together; a longer text is sorted alone.
PART_BYTES = 2 << 20


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words of all texts as numbers, where each text's words begin, and the strings."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, space, " ")
    cut = pc.split_pattern(plain, " ")
    starts = cut.offsets.to_numpy().astype(np.int64)
    words = cut.flatten().dictionary_encode()
    codes = words.indices.to_numpy()
    kept = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)[codes]
    running = np.concatenate([[0], np.cumsum(kept)])
    return codes[kept].astype(np.int64), running[starts - starts[0]], words.dictionary


# --- suffixes ----------------------------------------------------------------


def _neighbours(codes: np.ndarray, starts: np.ndarray, least: int):
    """Suffixes that are neighbours in their text's order and share ``least`` words or more.

    Two arrays of positions and their LCPs. Ranks by the first 1, 2, 4, ... words are refined inside
    groups of equal ones only, and kept: the LCP of two suffixes is read off them from the longest
    down.
    """
    n = len(codes)
    counts = np.diff(starts)
    text = np.repeat(np.arange(len(counts)), counts)
    end = np.repeat(starts[1:], counts)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    active = np.arange(n)
    old = np.zeros(n, np.int64)  # rank by what was compared so far: all words are one group
    levels: list[np.ndarray] = []
    rank = np.zeros(n + 1, np.int32)
    rank[n] = -1
    reach, candidates = 0, active
    while len(active):
        order = np.argsort(key, kind="stable")
        held, group, fine = active[order], old[order], key[order]
        place = np.arange(len(held))
        of_group = np.maximum.accumulate(np.where(np.diff(group, prepend=-1) != 0, place, 0))
        cut = np.diff(fine, prepend=fine[0] - 1) != 0
        of_key = np.maximum.accumulate(np.where(cut, place, 0))
        rank = rank.copy()
        rank[held] = group + of_key - of_group
        levels.append(rank)
        reach = max(2 * reach, 1)  # words that this level compares
        alone = cut & np.append(cut[1:], True)
        active = np.sort(held[~alone])
        if reach <= least:
            candidates = active
        old = rank[active].astype(np.int64)
        later = active + reach
        key = old * (n + 2) + np.where(later < end[active], rank[np.minimum(later, n)] + 1, 0)
    ordered = candidates[np.argsort(rank[candidates], kind="stable")]
    one, other = ordered[:-1], ordered[1:]
    common = np.zeros(len(one), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        a, b = np.minimum(one + common, n), np.minimum(other + common, n)
        common += np.where((levels[level][a] == levels[level][b]) & (a < n) & (b < n), 1 << level, 0)
    deep = common >= least
    return one[deep], other[deep], common[deep]


# --- classes of suffixes -----------------------------------------------------


def _united(large: list[int], small: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
    """The union of two ordered sets, and its neighbours of which each set had one."""
    if small[0] > large[-1]:
        pairs = [(large[-1], small[0])]
        large += small
    elif small[-1] < large[0]:
        pairs = [(small[-1], large[0])]
        large[:0] = small
    elif 8 * len(small) > len(large):
        own = set(small)
        large = sorted(large + small)
        pairs = [(u, v) for u, v in zip(large, large[1:]) if (u in own) != (v in own)]
    else:
        pairs, before = [], None
        for i, x in enumerate(small):
            at = bisect_left(large, x)
            if at and (before is None or before < large[at - 1]):
                pairs.append((large[at - 1], x))
            if at < len(large) and (i + 1 == len(small) or small[i + 1] > large[at]):
                pairs.append((x, large[at]))
            before = x
        for x in small:
            insort(large, x)
    return large, pairs


def _seeds(one: np.ndarray, other: np.ndarray, common: np.ndarray, exponent: int, words: int):
    """``position, period, LCP`` of neighbours near enough to repeat, from unions by falling LCP.

    Positions are kept negated: a run's class grows towards the text's beginning, so most unions
    append.
    """
    nodes, numbers = np.unique(np.concatenate([one, other]), return_inverse=True)
    members = [[-p] for p in nodes.tolist()]
    parent = list(range(len(members)))
    order = np.argsort(-common, kind="stable")
    edges = zip(
        numbers[: len(one)][order].tolist(), numbers[len(one) :][order].tolist(), common[order].tolist()
    )
    seeds = []
    for a, b, shared in edges:
        while parent[a] != a:
            parent[a] = a = parent[parent[a]]
        while parent[b] != b:
            parent[b] = b = parent[parent[b]]
        if len(members[a]) < len(members[b]):
            a, b = b, a
        members[a], pairs = _united(members[a], members[b])
        parent[b], members[b] = a, []
        for u, v in pairs:
            if (v - u) * (exponent - 1) <= shared and v - u + shared >= words:
                seeds.append((-v, v - u, shared))
    return np.array(seeds, np.int64).reshape(-1, 3).T


def find_runs(
    codes: np.ndarray, starts: np.ndarray, exponent: int = EXPONENT, words: int = RUN_WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (of all texts), length and period of every run, by first word and period."""
    if exponent < 2:
        raise ValueError("a run repeats at least twice")
    least = min(max((exponent - 1) * d, words - d) for d in range(1, max(words, 1) + 1))
    one, other, common = _neighbours(codes, starts, max(least, 1))
    at, period, shared = _seeds(one, other, common, exponent, words)
    first = np.zeros(len(codes) + 1, bool)
    first[starts] = True
    begins = first[at] | (codes[at - 1] != codes[at + period - 1])
    at, period, shared = at[begins], period[begins], shared[begins]
    order = np.lexsort((period, at))
    return at[order], (period + shared)[order], period[order]


# --- documents ---------------------------------------------------------------


def _runs_of(rows: DataFrame, exponent: int, words: int) -> DataFrame:
    """``row, n_words, runs, collapsed`` of every row's text."""
    kind = "array<struct<start: bigint, length: bigint, period: bigint>>"

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low, high in stretches(whole.column("text"), PART_BYTES):
                batch = whole.slice(low, high - low)
                codes, starts, strings = coded_words(batch.column("text"))
                at, length, period = find_runs(codes, starts, exponent, words)
                text = np.searchsorted(starts, at, "right") - 1
                runs = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(text, np.arange(len(starts))), pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(x, pa.int64()) for x in (at - starts[text], length, period)],
                        names=["start", "length", "period"],
                    ),
                )
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, at + period, 1)
                np.add.at(change, at + length, -1)
                kept = np.cumsum(change[:-1]) == 0
                before = np.concatenate([[0], np.cumsum(kept)])[starts]
                collapsed = pc.binary_join(
                    pa.ListArray.from_arrays(
                        pa.array(before, pa.int32()), strings.take(pa.array(codes[kept])).cast(pa.string())
                    ),
                    " ",
                )
                yield pa.record_batch(
                    [batch.column("row"), pa.array(np.diff(starts), pa.int64()), runs, collapsed],
                    names=["row", "n_words", "runs", "collapsed"],
                )

    row = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(
        search, f"row {row}, n_words bigint, runs {kind}, collapsed string"
    )


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    exponent: int = EXPONENT,
    words: int = RUN_WORDS,
) -> DataFrame:
    """Per document ``n_words``, ``runs`` (start, length, period) and ``collapsed``.

    A run is a stretch of words with smallest period q, of ``words`` and ``exponent * q`` words at
    least, that no neighbouring word extends; ``collapsed`` are the words that no run holds after its
    first period, joined by single spaces. One row per input row: a null, empty or blank text has no
    words, no runs and an empty ``collapsed``; null ids stay null; repeated rows are searched each;
    other columns are not read. Texts are searched whole and never shuffled.
    """
    rows = docs.select(F.col(id_column).alias("row"), F.col(text_column).alias("text"))
    return _runs_of(rows, exponent, words).withColumnRenamed("row", id_column)


def collapse_runs(
    docs: DataFrame, text_column: str = "text", exponent: int = EXPONENT, words: int = RUN_WORDS
) -> DataFrame:
    """The documents, with every run cut to its first period; texts without runs stay as they are.

    All columns stay, whatever their names; a null text stays null.
    """
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(text_column).alias("text"),
    )
    found = _runs_of(rows, exponent, words)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("row")[text_column])
    return found.withColumn("row", F.col("row").withField(f"`{text_column}`", text)).select("row.*")


def looped_tails(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: a tenth of the documents, by their id's crc32, repeat words to their end."""
    rows = docs.select("doc_id", "text")

    def loop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("doc_id").to_pylist()
            hashed = [1 if k is None else zlib.crc32(str(k).encode()) for k in keys]
            texts = batch.column("text")
            chosen = np.array([h % 10 == 0 for h in hashed], bool)
            looped = []
            for i in np.flatnonzero(chosen).tolist():
                words, g = words_of(texts[i].as_py()), hashed[i] // 10
                if words:
                    a = g % len(words)
                    p = 1 + (len(words) - a) // (3 + g % 8)
                    times = -(-(len(words) - a) // p)
                    words = words[:a] + (words[a : a + p] * times)[: len(words) - a]
                looped.append(" ".join(words))
            if looped:
                texts = pc.replace_with_mask(texts, pa.array(chosen), pa.array(looped, texts.type))
            yield pa.record_batch([batch.column("doc_id"), texts], names=["doc_id", "text"])

    return rows.mapInArrow(loop, rows.schema)


def periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(looped_tails(documents(spark, sf_dir)))

    def before(x, y):
        x_first = x["length"] * y["period"] - y["length"] * x["period"]
        return F.when(x_first > 0, -1).when(x_first < 0, 1).when(x["start"] != y["start"],
            F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(
            F.when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0))

    best = found.withColumn("best", F.get(F.array_sort("runs", before), F.lit(0)))
    lines = F.transform(
        "runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    )
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
