"""Segmentation lattices of chunks of text over a SentencePiece vocabulary."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from stationflow.llm.shingles import mix

MARK = "▁"


#: Bits of a hash that find its bucket among the pieces' beginnings.
BUCKET_BITS = 18
#: Letters below this, and the mark, have a column in the table of steps.
PLAIN = 128
COLUMNS = PLAIN + 2
#: Characters of the chunks whose lattice is built at once, so that it stays in the cache.
BLOCK = 100_000
#: Log of the least and greatest weight of a chunk's ways that is added up as it is.
SAFE = 600.0
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


class Pieces:
    """The vocabulary: ids by string, bytes by id, an automaton that finds all pieces in a text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        if self.library.normalize("Ａ  a") != f"{MARK}Ａ{MARK}{MARK}a":
            raise ValueError("the vocabulary must keep texts as they are")
        strings: dict[str, int] = {}
        self.surface = [b""] * self.size
        self.byte_ids = np.full(256, self.library.unk_id(), np.int64)
        self.usable = np.zeros(self.size, bool)
        for i in range(self.size):
            piece = self.library.id_to_piece(i)
            if self.library.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value], self.surface[i], self.usable[i] = i, bytes([value]), True
            elif not (self.library.is_control(i) or self.library.is_unknown(i)):
                strings[piece] = i
                self.surface[i] = piece.encode()
                self.usable[i] = True
        # a hash of every beginning of a piece, with the piece's id or -1; one column a letter
        self.longest = max(map(len, strings))
        ids = np.fromiter(strings.values(), np.int64, len(strings))
        lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        spread = np.zeros((len(strings), self.longest), np.uint32)
        spread[np.arange(self.longest) < lengths[:, None]] = np.frombuffer(
            "".join(strings).encode("utf-32-le"), "<u4"
        )
        begun, hashed = [], np.zeros(len(strings), np.uint64)
        for place in range(self.longest):
            hashed = self._next(hashed, spread[:, place])
            begun.append(hashed)
        held = [np.flatnonzero(lengths > place) for place in range(self.longest)]
        self.hashes, slots = np.unique(
            np.concatenate([h[rows] for h, rows in zip(begun, held)]), return_inverse=True
        )
        self.found = np.full(len(self.hashes), -1, np.int64)
        whole = [np.where(lengths[rows] == n, ids[rows], -1) for n, rows in enumerate(held, 1)]
        np.maximum.at(self.found, slots, np.concatenate(whole))
        top = self.hashes >> np.uint64(64 - BUCKET_BITS)
        self.bucket = np.searchsorted(top, np.arange((1 << BUCKET_BITS) + 1)).astype(np.int32)
        # what a beginning is with one more plain letter: most places need no hash. Row 0 is that of
        # beginnings which no longer piece has, row 1 that of the empty one, the last column is odd
        slots = np.split(slots, np.cumsum([len(rows) for rows in held])[:-1])
        longer = np.unique(np.concatenate([
            before[lengths[rows] > n] for n, (before, rows) in enumerate(zip(slots, held), 1)
        ]))
        self.inner = np.zeros(len(self.hashes), np.int32)  # where its row begins
        self.inner[longer] = np.arange(2, len(longer) + 2) * COLUMNS
        self.step = np.full((len(longer) + 2) * COLUMNS, -1, np.int32)
        row_of = np.full(len(strings), COLUMNS, np.int32)
        for place, (rows, slot) in enumerate(zip(held, slots)):
            letters = self._letters(spread[rows, place])
            even = letters <= PLAIN
            self.step[row_of[rows[even]] + letters[even]] = slot[even]
            row_of[rows] = self.inner[slot]

    @staticmethod
    def _letters(codes: np.ndarray) -> np.ndarray:
        """Columns of plain letters, of the mark, and of all others."""
        letters = np.minimum(codes, PLAIN + 1).astype(np.int32)
        letters[codes == PLAIN] = PLAIN + 1
        letters[codes == ord(MARK)] = PLAIN
        return letters

    def matches(self, codes: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Places and ids of all pieces in a text, by their length, longest first."""
        letters = self._letters(codes)
        by_length = []
        at, row = np.arange(len(codes)), np.full(len(codes), COLUMNS, np.int32)
        slot = np.zeros(0, np.int32)
        for length in range(1, self.longest + 1):
            last = at + (length - 1)
            if len(last) and last[-1] >= len(codes):
                inside = last < len(codes)
                at, row, last = at[inside], row[inside], last[inside]
                slot = slot[inside] if length > 1 else slot
            own = letters[last]
            grown = self.step[row + own]
            odd = np.flatnonzero(own > PLAIN)
            if len(odd):
                hashed = self.hashes[slot[odd]] if length > 1 else np.zeros(len(odd), np.uint64)
                grown[odd] = self._slots(self._next(hashed, codes[last[odd]]))
            hit = np.flatnonzero(grown >= 0)
            at, slot = at[hit], grown[hit]
            ids = self.found[slot]
            whole = np.flatnonzero(ids >= 0)
            by_length.append((at[whole], ids[whole]))
            row = self.inner[slot]
            more = np.flatnonzero(row)
            at, slot, row = at[more], slot[more], row[more]
            if not len(at):
                break
        return by_length[::-1]

    @staticmethod
    def _next(hashed: np.ndarray, codes: np.ndarray) -> np.ndarray:
        grown = hashed * _FACTOR
        grown += codes
        grown += _ONE
        return mix(grown)

    def _slots(self, hashed: np.ndarray) -> np.ndarray:
        top = (hashed >> np.uint64(64 - BUCKET_BITS)).astype(np.intp)
        slot, until = self.bucket[top], self.bucket[top + 1]
        out = np.full(len(hashed), -1, np.int32)
        open_ = np.flatnonzero(slot < until)
        while len(open_):
            same = self.hashes[slot[open_]] == hashed[open_]
            out[open_[same]] = slot[open_[same]]
            open_ = open_[~same]
            slot[open_] += 1
            open_ = open_[slot[open_] < until[open_]]
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of a sequence of ids."""
        joined = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return joined.replace(MARK, " ").removeprefix(" ")

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """The texts of sequences of ids."""
        if not hasattr(self, "surfaces"):
            self.surfaces = pa.array(self.surface, pa.binary())
        spelled = pa.LargeListArray.from_arrays(
            ids.offsets.cast(pa.int64()), self.surfaces.take(ids.values).cast(pa.large_binary())
        )
        try:
            joined = pc.binary_join(spelled, pa.scalar(b"", pa.large_binary())).cast(pa.large_string())
        except pa.ArrowInvalid:  # bytes that are no text
            return pa.array([self.decode(np.asarray(one)) for one in ids.to_pylist()], pa.large_string())
        joined = pc.replace_substring(joined, MARK, " ")
        return pc.if_else(pc.starts_with(joined, " "), pc.utf8_slice_codeunits(joined, 1), joined)


def chunk_texts(texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct chunks, the chunks of all texts by number, and how many each text has.

    A text is cut as the library sees it, before every mark that follows another character: no
    piece holds a mark after another character, so chunks are segmented independently.
    """
    column = pa.array([t or "" for t in texts], pa.large_string())
    odd = pc.or_(pc.match_substring(column, "  "), pc.match_substring(column, MARK))
    odd = pc.or_(odd, pc.or_(pc.starts_with(column, " "), pc.ends_with(column, " ")))
    odd = odd.to_numpy(zero_copy_only=False)
    cut = pc.split_pattern(column, " ")
    starts = cut.offsets.to_numpy().astype(np.int64)
    found = cut.flatten().dictionary_encode()
    codes = found.indices.to_numpy().astype(np.int64)
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    sizes = np.diff(starts)
    plain = np.array([bool(t) for t in texts], bool) & ~odd
    if plain.all():
        return [MARK + d for d in distinct], codes, sizes
    numbers = {d: i for i, d in enumerate(distinct)}
    parts = []
    for i, text in enumerate(texts):
        if plain[i]:
            parts.append(codes[starts[i] : starts[i + 1]])
        else:
            own = [c[1:] for c in _cut(text)] if text else []
            parts.append(np.array([numbers.setdefault(c, len(numbers)) for c in own], np.int64))
    return [MARK + d for d in numbers], np.concatenate(parts), np.array([len(x) for x in parts])


def _cut(text: str) -> list[str]:
    """The chunks of a text with runs of spaces or marks; each begins with a mark."""
    marked = MARK + text.replace(" ", MARK)
    cuts = [i for i in range(1, len(marked)) if marked[i] == MARK != marked[i - 1]]
    return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)])]


class Lattice:
    """All segmentations of distinct chunks, side by side, weighted by the pieces' scores.

    Nodes are places between characters; chunk ``c`` goes from node ``first[c]`` to ``last[c]``.
    Edges are sorted by the node they leave. An edge's probability given its node is its own weight
    times all ways to go on, over all ways to go on from the node: ``odds``. ``until`` is the node plus
    the probabilities up to the edge, ``total`` the log of all ways to go on.
    """

    def __init__(self, chunks: list[str], pieces: Pieces, scores: np.ndarray):
        self.spelled: list[np.ndarray] = []
        lengths = np.array([len(c) for c in chunks], np.int64)
        self.first = np.cumsum(lengths + 1) - lengths - 1
        self.last = self.first + lengths
        cuts = np.searchsorted(self.last, np.arange(BLOCK, int(lengths.sum()) + len(chunks), BLOCK))
        cuts = sorted({0, *cuts.tolist(), len(chunks)})
        blocks = [
            self._block(chunks[low:high], lengths[low:high], pieces, scores)
            for low, high in zip(cuts, cuts[1:])
        ] or [self._block([], lengths, pieces, scores)]
        nodes = np.cumsum([0, *(len(x["total"]) for x in blocks)]).tolist()
        edges = np.cumsum([0, *(len(x["start"]) for x in blocks)]).tolist()
        for block, node, edge in zip(blocks, nodes, edges):
            block["pointer"] += edge
            block["until"] += node
            block["start"] += node
            block["end"] += node
        for name in blocks[0]:
            setattr(self, name, np.concatenate([x[name] for x in blocks]))
        self.pointer = np.append(self.pointer, edges[-1])

    def _block(
        self, chunks: list[str], lengths: np.ndarray, pieces: Pieces, scores: np.ndarray
    ) -> dict[str, np.ndarray]:
        """The nodes and edges of some chunks, counted from 0."""
        last = np.cumsum(lengths + 1) - 1
        joined = "\0".join(chunks)
        n = int(last[-1]) + 1 if len(chunks) else 0
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        by_length = pieces.matches(codes)
        inside = np.ones(n, bool)
        inside[last] = False
        single = np.zeros(n, bool)
        if by_length:
            single[by_length[-1][0]] = True
        # characters that are no piece go as their bytes; their ids follow the vocabulary's
        bare = np.flatnonzero(inside & ~single)
        lengths_of = range(len(by_length), 0, -1)
        groups = [(at, ids, scores[ids], k) for (at, ids), k in zip(by_length, lengths_of)]
        if len(bare):
            letters, which = np.unique(codes[bare], return_inverse=True)
            known = len(self.spelled)
            for letter in letters.tolist():
                raw = chr(letter).encode("utf-8", "replace")
                self.spelled.append(pieces.byte_ids[np.frombuffer(raw, np.uint8)])
            extra = np.array([scores[s].sum() for s in self.spelled[known:]])[which]
            groups.append((bare, pieces.size + known + which, extra, 1))
        # from a node, the longest pieces first: they are drawn most often
        out = np.zeros(n, np.int32)
        for at, _, _, _ in groups:
            out[at] += 1
        pointer = np.cumsum(out, dtype=np.int64) - out
        total = int(out.sum())
        # places and ids of edges fit 32 bits: a batch of texts is far below 2**31 characters
        start, end, ids_of = (np.zeros(total, np.int32) for _ in range(3))
        weights, filled = np.zeros(total), pointer.copy()
        for at, ids, weight, length in groups:
            place = filled[at]
            filled[at] += 1
            start[place], end[place] = at, at + length
            ids_of[place], weights[place] = ids, weight
        remaining = np.repeat(last, lengths + 1) - np.arange(n)
        if n and int(lengths.max()) < 1 << 16:
            remaining = remaining.astype(np.uint16)  # sorted by counting
        by_rest = np.argsort(remaining, kind="stable")
        total_of, chance = self._ways(
            by_rest, remaining[by_rest], out, pointer, start, end, weights, groups, last
        )
        shares = np.cumsum(chance)
        shares -= np.repeat(np.concatenate([[0.0], shares])[pointer], out)
        np.minimum(shares, 1.0, out=shares)
        shares[(pointer + out - 1)[out > 0]] = 1.0
        shares += start
        return {
            "pointer": pointer, "start": start, "end": end, "ids": ids_of, "odds": chance,
            "total": total_of, "until": shares,
        }

    @staticmethod
    def _ways(by_rest, rests, out, pointer, start, end, weights, groups, last):
        """Log of the weight of all ways from each node to its chunk's end; each edge's chance.

        Nodes are added up by what remains to the end. Weights themselves are added, unless a long
        chunk's would be too small or too large for a double: then all are kept as logarithms.
        """
        n = len(by_rest)
        least = np.zeros(n)
        for at, _, weight, length in groups:
            if length == 1:
                least[at] = weight
        worst = np.add.reduceat(least, np.concatenate([[0], last[:-1] + 1])).min() if n else 0.0
        longest = int(rests[-1]) if n else 0
        plain = worst > -SAFE and longest * (np.log(2) + max(weights.max(initial=0.0), 0.0)) < SAFE
        # edges in the order of their nodes by rest, so that each step is a stretch of them
        sizes = out[by_rest]
        to = np.cumsum(sizes, dtype=np.int64)
        order = np.repeat(pointer[by_rest] - (to - sizes), sizes) + np.arange(int(to[-1]) if n else 0)
        where = np.empty(n, np.int64)
        where[by_rest] = np.arange(n)
        reached = where[end[order]]
        ways = np.exp(weights[order]) if plain else weights[order]
        value = np.ones(n) if plain else np.zeros(n)
        begins = to - sizes
        steps = np.searchsorted(rests, np.arange(1, longest + 2)).tolist()
        for low, high in zip(steps, steps[1:]):
            if low == high:
                continue
            one, two = int(begins[low]), int(to[high - 1])
            onward, runs = value[reached[one:two]], begins[low:high] - one
            if plain:
                onward *= ways[one:two]
                np.add.reduceat(onward, runs, out=value[low:high])
                continue
            onward += ways[one:two]
            top = np.maximum.reduceat(onward, runs)
            sums = np.add.reduceat(np.exp(onward - np.repeat(top, sizes[low:high])), runs)
            value[low:high] = top + np.log(sums)
        if plain:
            own = ways * value[reached]
            own /= np.repeat(value, sizes)
            value = np.log(value)
        else:
            own = np.exp(ways + value[reached] - np.repeat(value, sizes))
        chance, total = np.empty(len(order)), np.empty(n)
        chance[order], total[by_rest] = own, value
        return total, chance

    def chance(self, edges: np.ndarray) -> np.ndarray:
        """Log probability of each edge, given its node."""
        return np.log(self.odds[edges])

    def draw(self, nodes: np.ndarray, uniform: np.ndarray) -> np.ndarray:
        """An edge out of each node, by its probability."""
        edges = self.pointer[nodes]
        wanted = nodes + uniform
        behind = np.flatnonzero(self.until[edges] <= wanted)
        while len(behind):
            edges[behind] += 1
            behind = behind[self.until[edges[behind]] <= wanted[behind]]
        return edges

    def spell(self, edges: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a row of edges, and how many each edge stands for."""
        ids = self.ids[edges]
        if int(ids.max(initial=0)) < size:
            return ids, np.ones(len(ids), np.int64)
        lengths = np.array([len(s) for s in self.spelled])
        starts = np.cumsum(lengths) - lengths
        bare = np.flatnonzero(ids >= size)
        letter = ids[bare] - size
        n = np.ones(len(ids), np.int64)
        n[bare] = lengths[letter]
        ends = np.cumsum(n)
        out = np.repeat(ids, n)
        own = n[bare]
        nth = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        flat = np.concatenate(self.spelled)
        out[np.repeat(ends[bare] - own, own) + nth] = flat[np.repeat(starts[letter], own) + nth]
        return out, n
