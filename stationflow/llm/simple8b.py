"""Simple-8b: word-aligned packing of non-negative integers, vectorised both ways.

A 64-bit word holds a 4-bit selector and as many values as fit its width into 60 bits. Values
of 2**60 and more are escaped: their word only says so, and they follow in a list of their own.
Every ``STEP`` words the number of values before is noted, so any stretch decodes alone.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the code: selector -> values per word, bits per value; selector 0 escapes.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTHS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)
STEP = 128


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, escaped values, and the number of values before every ``STEP``-th word."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    wide = int(values.max())
    held = values.astype(np.uint32) if wide < 1 << 32 else values
    most, span = held, 1  # most[i]: the largest of held[i : i + span]; the end stops nothing
    best = np.zeros(n, np.int8)
    for selector in range(14, 0, -1):
        count, width = int(COUNTS[selector]), int(WIDTHS[selector])
        while span < count:
            step = min(span, count - span)
            wider = most.copy()  # a step past the end meets what it already holds
            np.maximum(most[:-step], most[step:], out=wider[:-step])
            np.maximum(most[-step:], most[-1], out=wider[-step:])
            most, span = wider, span + step
        fits = most <= held.dtype.type(min((1 << width) - 1, np.iinfo(held.dtype).max))
        if not fits.any():
            break  # longer and narrower runs lie inside such a run
        np.copyto(best, np.int8(selector), where=fits)
    # the first words, then as many again by one jump over all of these, and so on
    jump = np.minimum(np.arange(n + 1) + np.append(COUNTS[best], 0), n)
    first = np.zeros(1, np.int64)
    while first[-1] < n:
        first = np.concatenate([first, jump[first]])
        jump = jump[jump]
    first = first[first < n]
    chosen = best[first]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([values, np.zeros(60, np.uint64)])
    for selector in range(1, 15):
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            at, word = first[rows], words[rows]
            for lane in range(int(COUNTS[selector])):
                word |= padded[at + lane] << np.uint64(lane * int(WIDTHS[selector]))
            words[rows] = word
    return words, values[first[chosen == 0]], first[::STEP].astype(np.int64)


def unpack(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of the words."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNTS[selectors]
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    starts = ends - counts
    for selector in range(1, 15):
        rows = np.flatnonzero(selectors == selector)
        if len(rows):
            lanes = np.arange(COUNTS[selector])
            shifts = (lanes * WIDTHS[selector]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTHS[selector])) - 1)
            out[starts[rows][:, None] + lanes] = (words[rows][:, None] >> shifts) & mask
    out[starts[selectors == 0]] = escapes
    return out[:n]


def unpack_range(
    words: np.ndarray, escapes: np.ndarray, offsets: np.ndarray, n: int, low: int, high: int
) -> np.ndarray:
    """Values ``low`` to ``high`` (not included), from the words that hold them only."""
    high = min(high, n)
    if low >= high:
        return np.zeros(0, np.uint64)
    block = int(np.searchsorted(offsets, low, "right")) - 1
    last = int(np.searchsorted(offsets, high, "left"))
    skipped = int((words[: block * STEP] >> np.uint64(60) == 0).sum())
    part = words[block * STEP : last * STEP]
    inside = int((part >> np.uint64(60) == 0).sum())
    base = int(offsets[block])
    return unpack(part, escapes[skipped : skipped + inside], high - base)[low - base :]
