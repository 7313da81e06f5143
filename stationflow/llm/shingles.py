"""Sets of word shingles as sorted 64-bit hashes, for whole batches of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from stationflow.llm.text import lower_az

WORDS_PER_SHINGLE = 5
_STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = values.astype(np.uint64)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts (A-Z in lower case), and where each text's words begin."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, space, " ")
    cut = pc.split_pattern(plain, " ")
    starts = cut.offsets.to_numpy().astype(np.int64)
    words = cut.flatten().dictionary_encode()
    starts -= starts[0]
    codes = words.indices.to_numpy()
    distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
    table = np.fromiter(
        map(xxhash.xxh64_intdigest, map(lower_az, distinct)), np.uint64, len(distinct)
    )
    kept = np.array([w != "" for w in distinct], bool)[codes]
    running = np.concatenate([[0], np.cumsum(kept)])
    return table[codes[kept]], running[starts]


def shingle_sets(texts: pa.Array, size: int = WORDS_PER_SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    A text with fewer words than a shingle has its whole sequence as one; without words, or null,
    it has none.
    """
    if not len(texts):
        return []
    words, starts = word_hashes(texts)
    if len(words) >= size:
        rolled = words[: len(words) - size + 1].copy()
        for place in range(1, size):
            rolled = rolled * _STEP + words[place : len(words) - size + 1 + place]
        rolled = mix(rolled)
    sets = []
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if high - low >= size:
            sets.append(np.unique(rolled[low : high - size + 1]))
        elif high > low:
            value = np.uint64(high - low)
            for word in words[low:high]:
                value = np.uint64((int(value) * int(_STEP) + int(word)) & 0xFFFFFFFFFFFFFFFF)
            sets.append(mix(np.array([value], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets
