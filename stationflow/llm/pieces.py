"""Encoding whole texts with a byte-level BPE of the ``tokenizers`` library, chunk by chunk.

Pre-token patterns of the GPT-2 kind let a space only open a pre-token or stand in a run of
white space. A space after a character that is no white space is therefore always a boundary,
and what lies between two such boundaries (a chunk) gets the same ids alone as in its text.
A batch of texts is cut and made distinct by Arrow, the library sees each new chunk once, and
the ids of the texts are gathered from the table of chunks. Texts in which a space follows
white space, or that hold a special token's string, go to the library whole.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks a Python worker remembers; beyond that it starts anew and the ids stay the same.
REMEMBERED = 700_000
_JOINED = 1 << 18
# White space of either library before a space.
_LATE_SPACE = (
    "[\\x09-\\x0d \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}"
    "\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}] "
)


class Encoder:
    """Token ids, or only their number, of whole texts as the library gives them."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():  # one character of a token stands for one byte
            self.n_bytes[i] = len(token)
        self.remembered = remembered
        self._forget()

    def _forget(self) -> None:
        self.spaced: dict[str, int] = {}  # chunks that follow a space, without it
        self.heads: dict[str, int] = {}  # chunks that open a text
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)
        self.slots = 0

    def _store(self, ids: np.ndarray, lengths: np.ndarray) -> int:
        """Add the ids of ``len(lengths)`` chunks; the first one's slot."""
        if self.used + len(ids) > len(self.ids):
            grown = np.zeros(2 * (self.used + len(ids)), np.uint32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        if self.slots + len(lengths) > len(self.start):
            for name in ("start", "length"):
                grown = np.zeros(2 * (self.slots + len(lengths)), np.int64)
                grown[: self.slots] = getattr(self, name)[: self.slots]
                setattr(self, name, grown)
        first, n = self.slots, len(lengths)
        self.ids[self.used : self.used + len(ids)] = ids
        self.length[first : first + n] = lengths
        self.start[first : first + n] = self.used + np.cumsum(lengths) - lengths
        self.used += len(ids)
        self.slots += n
        return first

    def encode_strings(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number of strings that are encoded each alone."""
        lengths, ids = [], []
        for at in range(0, len(strings), 1024):
            for found in self.library.encode_batch_fast(
                strings[at : at + 1024], add_special_tokens=False
            ):
                ids.append(np.array(found.ids, np.uint32))
                lengths.append(len(ids[-1]))
        joined = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        return joined, np.array(lengths, np.int64)

    def encode_spaced(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces with a space put before each; none may end in white space.

        Their concatenation has a boundary before each, so the library gets long texts and the
        cuts are found again from the bytes that each id stands for.
        """
        sizes = pc.binary_length(pa.array(pieces, pa.large_string()))
        sizes = sizes.to_numpy(zero_copy_only=False).astype(np.int64) + 1
        ends, ids, lengths, at = np.cumsum(sizes), [], [], 0
        while at < len(pieces):
            to = int(np.searchsorted(ends, ends[at] - sizes[at] + _JOINED)) + 1
            text = " " + " ".join(pieces[at:to])
            found = np.array(
                self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32
            )
            cuts = np.searchsorted(np.cumsum(self.n_bytes[found]), np.cumsum(sizes[at:to])) + 1
            ids.append(found)
            lengths.append(np.diff(cuts, prepend=0))
            at = to
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, pieces: list[str]) -> None:
        column = pa.array(pieces, pa.large_string())
        odd = pc.or_(
            pc.equal(column, ""),
            pc.not_equal(
                pc.binary_length(column), pc.binary_length(pc.utf8_rtrim_whitespace(column))
            ),
        )
        whole = column.filter(pc.invert(odd)).to_pylist() if pc.any(odd).as_py() else pieces
        odd = column.filter(odd).to_pylist()
        for part, found in (
            (whole, self.encode_spaced(whole)),
            (odd, self.encode_strings([" " + p for p in odd])),
        ):
            first = self._store(*found)
            self.spaced.update(zip(part, range(first, first + len(part))))

    def _learn_heads(self, heads: list[str]) -> None:
        first = self._store(*self.encode_strings(heads))
        self.heads.update(zip(heads, range(first, first + len(heads))))

    def look_up(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Slots of the chunks of each text, and where each text's slots begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        late = pc.match_substring_regex(texts, _LATE_SPACE)
        for token in self.special:
            late = pc.or_(late, pc.match_substring(texts, token))
        cut = pc.split_pattern(pc.if_else(late, "", texts), " ")
        bounds = cut.offsets.to_numpy().astype(np.int64)
        pieces = cut.flatten().dictionary_encode()
        distinct = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        codes = pieces.indices.to_numpy()
        bounds -= bounds[0]
        opening = bounds[:-1]
        follows = np.zeros(len(distinct), bool)
        body = np.ones(len(codes), bool)
        body[opening] = False
        follows[codes[body]] = True
        following = np.flatnonzero(follows)
        head_codes = codes[opening]
        if len(self.spaced) + len(self.heads) + len(distinct) > self.remembered:
            self._forget()
        needed = [distinct[i] for i in following.tolist()]
        known = list(map(self.spaced.get, needed))
        new = [i for i, slot in enumerate(known) if slot is None]
        if new:
            self._learn([needed[i] for i in new])
            for i in new:
                known[i] = self.spaced[needed[i]]
        heads = [distinct[i] for i in head_codes.tolist()]
        self._learn_heads([h for h in dict.fromkeys(heads) if h not in self.heads])
        table = np.zeros(len(distinct), np.int64)
        table[following] = known
        slots = table[codes]
        slots[opening] = np.fromiter(map(self.heads.__getitem__, heads), np.int64, len(heads))
        odd = np.flatnonzero(late.to_numpy(zero_copy_only=False))
        for i in odd.tolist():
            slots[opening[i]] = self._store(*self.encode_strings([texts[i].as_py()]))
        return slots, bounds

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and their number per text; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        slots, bounds = self.look_up(texts)
        lengths = self.length[slots]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(self.start[slots] - (ends - lengths), lengths) + np.arange(total)
        return self.ids[at], sums_between(lengths, bounds)

    def count(self, texts: pa.Array) -> np.ndarray:
        """The number of tokens per text."""
        if not len(texts):
            return np.zeros(0, np.int64)
        slots, bounds = self.look_up(texts)
        return sums_between(self.length[slots], bounds)


def sums_between(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    running = np.concatenate([[0], np.cumsum(values)])
    return running[bounds[1:]] - running[bounds[:-1]]


_ENCODERS: dict[tuple, Encoder] = {}


def remembered(kind: type, path: str, *more) -> Encoder:
    """The worker's encoder of a vocabulary; later tasks find what earlier ones learnt."""
    key = (kind, path)
    if key not in _ENCODERS:
        _ENCODERS[key] = kind(path, *more)
    return _ENCODERS[key]
