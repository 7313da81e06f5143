"""Words of letters and digits, looked up in the words of a stated set of items.

A word is a maximal run of digits, ASCII letters (A-Z read as a-z) and characters beyond ASCII. All
words of a batch are hashed at once from the bytes of the texts; a hash tells whether a word belongs
to the items. ``Lexicon.is_word`` compares the bytes, for callers that confirm what they found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationflow.llm.shingles import mix

#: Items are searched in blocks of about so many bytes: a block is what a task holds of them.
BLOCK_BYTES = 4 << 20


def _letters() -> np.ndarray:
    """Each byte's letter inside a word, 0 where a byte is no part of one."""
    table = np.arange(256, dtype=np.uint8)
    inside = np.zeros(256, bool)
    inside[ord("0") : ord("9") + 1] = True
    inside[ord("a") : ord("z") + 1] = True
    inside[ord("A") : ord("Z") + 1] = True
    inside[128:] = True
    table[ord("A") : ord("Z") + 1] += 32
    return np.where(inside, table, 0).astype(np.uint8)


_LETTER = _letters()
_VALUE = mix(np.arange(256, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SLICE = 1 << 19


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of a column of texts: where each begins and ends, and where each text's words begin."""

    def __init__(self, texts: pa.Array):
        column = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.zeros(1, np.int64)
        if len(column):
            offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
        buffer = column.buffers()[2]
        data = np.zeros(0, np.uint8) if buffer is None else np.frombuffer(buffer, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        cuts = offsets - offsets[0]
        inside = _LETTER[self.data] != 0
        # a place where a word may begin or end: inside changes, or a text begins
        edge = np.ones(len(inside) + 1, bool)
        edge[1:-1] = inside[1:] != inside[:-1]
        edge[cuts] = True
        places = np.flatnonzero(edge)
        begins = inside[places[:-1]] if len(places) > 1 else np.zeros(0, bool)
        self.first, self.last = places[:-1][begins], places[1:][begins]
        self.starts = np.searchsorted(self.first, cuts)

    def __len__(self) -> int:
        return len(self.first)

    def word(self, i: int) -> bytes:
        return _LETTER[self.data[self.first[i] : self.last[i]]].tobytes()

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word, a slice of the bytes at a time."""
        out = np.empty(len(self), np.uint64)
        at, n = 0, len(self)
        powers = inverse = np.zeros(0, np.uint64)
        while at < n:
            low = int(self.first[at])
            to = max(int(np.searchsorted(self.last, low + _SLICE, "right")), at + 1)
            high = int(self.last[to - 1])
            if high - low > len(powers):
                powers, inverse = (_powers(b, max(high - low, _SLICE)) for b in (_BASE, _INVERSE))
            running = np.zeros(high - low + 1, np.uint64)
            letters = _VALUE[_LETTER[self.data[low:high]]]
            np.cumsum(letters * powers[: high - low], out=running[1:])
            first, last = self.first[at:to] - low, self.last[at:to] - low
            out[at:to] = (running[last] - running[first]) * inverse[first]
            at = to
        return mix(out + (self.last - self.first).astype(np.uint64))


class Lexicon:
    """The distinct words of some texts, numbered from 1; every other word is 0."""

    def __init__(self, texts: pa.Array):
        words = Words(texts)
        self.hashes, at, codes = np.unique(words.hashes(), return_index=True, return_inverse=True)
        self.strings = [words.word(i) for i in at.tolist()]
        self.codes = (codes + 1).astype(np.int32)
        self.starts = words.starts

    def __len__(self) -> int:
        return len(self.hashes)

    def look_up(self, words: Words) -> np.ndarray:
        if not len(self):
            return np.zeros(len(words), np.int32)
        hashes = words.hashes()
        at = np.searchsorted(self.hashes, hashes)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == hashes, at + 1, 0).astype(np.int32)

    def is_word(self, words: Words, i: int, code: int) -> bool:
        return words.word(i) == self.strings[code - 1]


def stretches(texts: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Rows ``low`` to ``high`` of at most ``limit`` bytes each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    low = 0
    while low < len(sizes):
        before = int(ends[low] - sizes[low])
        high = max(int(np.searchsorted(ends, before + limit, "right")), low + 1)
        yield low, high
        low = high


def item_blocks(
    items: DataFrame, id_column: str, text_column: str, block_bytes: int = BLOCK_BYTES
) -> Iterator[list[tuple[object, str | None]]]:
    """The distinct items, a block of about ``block_bytes`` at a time, in a fixed order.

    Items are the stated set of queries. Their total size is measured first and decides the number
    of blocks, so no more than a block (or its longest item) is with the driver or a task.
    """
    rows = items.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).distinct()
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)
    total = rows.agg(F.coalesce(size, F.lit(0)).alias("n")).head()["n"]
    n = total // block_bytes + 1
    for block in range(n):
        own = rows.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == block)
        found = [(row["id"], row["text"]) for row in own.collect()]
        yield sorted(found, key=lambda r: (r[0] is None, "" if r[0] is None else str(r[0]), r[1] or ""))
