"""SentencePiece encoding and decoding with distinct sampled segmentations.

A text's segmentations form a lattice of pieces. Piece scores are log probabilities estimated
here from all documents. ``k`` different segmentations are drawn without replacement by Gumbel
top-k: every segmentation's log probability is perturbed with a Gumbel variable, and a best-first
(A*) search over the lattice returns the largest perturbed values without listing the others. The
bound of a part of the lattice is exact: its maximum is a Gumbel variable at the part's total
weight, truncated at its parent's value.

Along a found segmentation, every step leaves one part behind: all segmentations that agree
before the step and take another piece there. These parts wait in a queue with their maxima; the
largest is opened next, by drawing its piece and going on freely. All random numbers come from the
row's key, the draw and the place in the text, so they do not depend on partitions or order.

The inclusion score of a drawn segmentation is the probability that its perturbed value exceeds
the largest one not returned.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.lexicon import stretches
from stationflow.llm.lattice import MARK, Lattice, Pieces, chunk_texts
from stationflow.llm.shingles import mix
from stationflow.llm.text import documents, small_batches, tables_of

DRAWS = 2
#: Exponent of the piece probabilities: lower is more diverse.
SHARPNESS = 0.5
#: Count that every piece has beforehand.
PRIOR = 0.1
SEED = 2024
#: Texts that are drawn together, and whose lattices are held together.
TOGETHER = 250
HELD_TOGETHER = 1000
#: Characters of them at most, unless a single text has more.
CHARACTERS = 150_000
CHARACTERS_HELD = 600_000
#: Bytes of texts whose words are counted together, and distinct words that the library gets at once.
COUNTED_TOGETHER = 4_000_000
ENCODED_TOGETHER = 20_000


def _pieces(path: str) -> Pieces:
    held = tables_of("segmentations")
    if path not in held:
        held[path] = Pieces(path)
    return held[path]


def piece_scores(docs: DataFrame, vocabulary: str, text_column: str = "text") -> np.ndarray:
    """Log probability of every piece, from its count in the encoding of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        lone_mark = pieces.library.piece_to_id(MARK)
        counts = np.zeros(pieces.size, np.int64)
        for batch in batches:
            for low, high in stretches(batch.column("text"), COUNTED_TOGETHER):
                texts = batch.column("text").slice(low, high - low).to_pylist()
                distinct, chunk, _ = chunk_texts(texts)
                times = np.bincount(chunk, minlength=len(distinct))
                for at in range(0, len(distinct), ENCODED_TOGETHER):
                    own = distinct[at : at + ENCODED_TOGETHER]
                    # the library puts the first mark before what it is given, but not before nothing
                    found = pieces.library.encode([c[1:] for c in own], num_threads=1)
                    found = [f if c != MARK else [lone_mark] for c, f in zip(own, found)]
                    lengths = np.fromiter(map(len, found), np.int64, len(found))
                    ids = np.fromiter(chain.from_iterable(found), np.int64, int(lengths.sum()))
                    weights = np.repeat(times[at : at + ENCODED_TOGETHER], lengths)
                    # a sum of whole numbers, exact in a double
                    counts += np.bincount(ids, weights, minlength=pieces.size).astype(np.int64)
        seen_ids = np.flatnonzero(counts)
        yield pa.record_batch(
            [pa.array(seen_ids, pa.int32()), pa.array(counts[seen_ids], pa.int64())],
            names=["piece", "n"],
        )

    pieces = _pieces(vocabulary)
    counts = np.full(pieces.size, PRIOR)
    rows = docs.select(F.col(text_column).alias("text")).mapInArrow(count, "piece int, n bigint")
    for row in rows.groupBy("piece").agg(F.sum("n").alias("n")).collect():
        counts[row["piece"]] += row["n"]
    counts[~pieces.usable] = PRIOR
    return np.log(counts / counts.sum())


def _stream(key: np.ndarray, draw: int) -> np.ndarray:
    return mix(key + np.uint64(draw * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def _uniform(stream: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that only depend on the row's key and the draw, its stream, and the place."""
    bits = mix(stream + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    out = (bits >> np.uint64(11)).astype(np.float64)
    out += 0.5
    out /= 1 << 53
    return out


def row_key(identity, seed: int = SEED) -> int:
    return xxhash.xxh64_intdigest(f"{seed}:{'' if identity is None else identity}")


class _Paths:
    """Drawn paths of many texts: all edges in a row, text after text."""

    def __init__(self, lattice: Lattice, chunk: np.ndarray, offset: np.ndarray):
        self.lattice, self.chunk, self.offset = lattice, chunk, offset

    def go_on(
        self, chunks: np.ndarray, nodes: np.ndarray, streams: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Draw edges from ``nodes`` to the ends of their chunks: the edges and their number.

        ``chunks`` are places in the list of all chunks; ``streams`` those of their rows.
        """
        lattice = self.lattice
        ends = lattice.last[self.chunk[chunks]]
        offset = self.offset[chunks]
        alive = np.flatnonzero(nodes < ends)
        here, found, owners = nodes[alive], [], []
        counts = np.zeros(len(chunks), np.int64)
        while len(alive):
            edges = lattice.draw(here, _uniform(streams[alive], offset[alive] + here))
            found.append(edges)
            owners.append(alive)
            counts[alive] += 1
            here = lattice.end[edges].astype(np.int64)
            more = here < ends[alive]
            alive, here = alive[more], here[more]
        begins = np.cumsum(counts) - counts
        path = np.zeros(int(counts.sum()), np.int64)
        for step, (edges, owner) in enumerate(zip(found, owners)):
            path[begins[owner] + step] = edges
        return path, counts


def _truncated(location: np.ndarray, bound: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """Gumbel variables at ``location``, conditioned not to exceed ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return location - np.log(np.exp(location - bound) - np.log(uniform))


def sample_texts(
    texts: list[str | None], identities: list, pieces: Pieces, scores: np.ndarray, draws: int,
    seed: int = SEED,
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text up to ``draws`` (ids, log probability, perturbed value, inclusion)."""
    distinct, chunk, sizes = chunk_texts(texts)
    lattice = Lattice(distinct, pieces, scores)
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    lengths = pc.fill_null(pc.utf8_length(pa.array(texts, pa.large_string())), 0).to_numpy()
    found = []
    for low, high in _ranges(lengths, TOGETHER, CHARACTERS):
        found += _sample(
            lattice, chunk[bounds[low] : bounds[high]], sizes[low:high], identities[low:high],
            pieces, draws, seed,
        )
    return found


def _ranges(lengths: np.ndarray, texts: int, characters: int) -> Iterator[tuple[int, int]]:
    """Stretches of so many texts and characters at most; a longer text is alone."""
    through = np.concatenate([[0], np.cumsum(lengths)])
    low = 0
    while low < len(lengths):
        fits = int(np.searchsorted(through, through[low] + characters, "right")) - 1
        high = min(max(fits, low + 1), low + texts, len(lengths))
        yield low, high
        low = high


def _sample(
    lattice: Lattice, chunk: np.ndarray, sizes: np.ndarray, identities: list, pieces: Pieces,
    draws: int, seed: int,
) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """The drawn segmentations of texts whose chunks, by number, are in the lattice."""
    chunk_to = np.cumsum(sizes)
    chunk_from = chunk_to - sizes
    of_text = np.repeat(np.arange(len(sizes)), sizes)
    lengths = (lattice.last - lattice.first)[chunk]
    before = np.concatenate([[0], np.cumsum(lengths)])
    # from a node to its place among the text's characters
    offset = before[:-1] - before[chunk_from[of_text]] - lattice.first[chunk]
    keys = np.array([row_key(i, seed) for i in identities], np.uint64)
    paths = _Paths(lattice, chunk, offset)
    root = -np.log(-np.log(_uniform(_stream(keys, 0), np.zeros(len(sizes), np.int64))))

    everything = np.arange(len(chunk))
    edges, counts = paths.go_on(
        everything, lattice.first[chunk], np.repeat(_stream(keys, 1), sizes)
    )
    step_chunk = np.repeat(everything, counts)
    steps_before = np.concatenate([[0], np.cumsum(counts)])
    steps_of = steps_before[chunk_to] - steps_before[chunk_from]
    step_to = np.cumsum(steps_of)
    bound = np.repeat(root, steps_of)
    log_edges = lattice.chance(edges)
    queue_value, log_before = _parts(
        lattice, edges, log_edges, np.repeat(offset, counts), np.repeat(_stream(keys, 50_001), steps_of), bound,
        step_to - steps_of, steps_of, np.zeros(len(edges)),
    )
    results, states = [], []
    for text in range(len(sizes)):
        low, high = int(step_to[text] - steps_of[text]), int(step_to[text])
        path = (edges[low:high], step_chunk[low:high])
        total = float(log_edges[low:high].sum())
        queue: list = []
        _push(queue, queue_value[low:high], path, log_before[low:high], {}, draws, 0)
        results.append([(path[0], total, float(root[text]))])
        states.append(queue)

    for draw in range(2, draws + 1):
        opened = []
        for text, queue in enumerate(states):
            if not queue or len(results[text]) < draw - 1:
                continue
            value, _, step, path, logs, gone = heapq.heappop(queue)
            opened.append((text, -value, step, path, logs, gone))
        if not opened:
            break
        heads = []
        tops = lattice.start[[o[3][0][o[2]] for o in opened]]
        of_tops = np.array([o[3][1][o[2]] for o in opened])
        where = offset[of_tops] + tops
        own_keys = keys[[o[0] for o in opened]]
        own_streams = _stream(own_keys, draw)
        picks = _uniform(own_streams, where).tolist()
        rests = _uniform(_stream(own_keys, draw + 100_000), where)
        for (text, value, step, path, logs, gone), node, pick in zip(opened, tops.tolist(), picks):
            out = np.arange(lattice.pointer[node], lattice.pointer[node + 1])
            taken = gone.get(step, frozenset()) | {int(path[0][step])}
            left = out[out != path[0][step]] if len(taken) == 1 else out[~np.isin(out, list(taken))]
            chances = np.exp(lattice.chance(left))
            edge = int(left[min(np.searchsorted(np.cumsum(chances), pick * chances.sum()),
                                len(left) - 1)])
            heads.append((edge, taken))
        firsts = np.array([int(o[3][1][o[2]]) for o in opened])
        ranges = [np.arange(f, chunk_to[o[0]]) for f, o in zip(firsts.tolist(), opened)]
        onward = np.concatenate(ranges)
        begins = np.cumsum([0] + [len(r) for r in ranges])[:-1]
        nodes = lattice.first[chunk[onward]]
        nodes[begins] = lattice.end[[e for e, _ in heads]]
        more, counts = paths.go_on(
            onward, nodes, np.repeat(own_streams, [len(r) for r in ranges])
        )
        of_more = np.repeat(onward, counts)
        more_sizes = np.add.reduceat(counts, begins)
        more_to = np.cumsum(more_sizes)
        carried = np.array([float(o[4][o[2]]) for o in opened])
        carried += lattice.chance(np.array([e for e, _ in heads]))
        bounds = np.repeat([o[1] for o in opened], more_sizes)
        log_more = lattice.chance(more)
        values, logs = _parts(
            lattice, more, log_more, np.repeat(offset[onward], counts),
            np.repeat(_stream(own_keys, draw + 50_000), more_sizes), bounds,
            more_to - more_sizes, more_sizes, np.repeat(carried, more_sizes),
        )
        for at, ((text, value, step, path, before_step, gone), (edge, taken)) in enumerate(
            zip(opened, heads)
        ):
            low, high = int(more_to[at] - more_sizes[at]), int(more_to[at])
            grown = (
                np.concatenate([path[0][:step], [edge], more[low:high]]),
                np.concatenate([path[1][: step + 1], of_more[low:high]]),
            )
            logs_of = np.concatenate([before_step[: step + 1], logs[low:high]])
            total = float(carried[at] + log_more[low:high].sum())
            results[text].append((grown[0], total, value))
            # what is left at the opened step, below the value that was just taken
            node = int(lattice.start[edge])
            rest = 1.0 - float(np.exp(lattice.chance(np.array([edge, *taken]))).sum())
            step_values = np.full(len(grown[0]), -np.inf)
            if lattice.pointer[node + 1] - lattice.pointer[node] > len(taken) + 1 and rest > 1e-12:
                step_values[step] = _truncated(
                    np.array([before_step[step] + np.log(rest)]), np.array([value]),
                    rests[at : at + 1],
                )[0]
            step_values[step + 1 :] = values[low:high]
            here = {**{s: g for s, g in gone.items() if s < step}, step: frozenset(taken)}
            _push(states[text], step_values, grown, logs_of, here, draws, draw)

    drawn = [path for found in results for path, _, _ in found]
    spelled, n_ids = lattice.spell(np.concatenate(drawn), pieces.size)
    last = np.cumsum(n_ids) if len(n_ids) else np.zeros(0, np.int64)
    cuts = np.concatenate([[0], last])[np.cumsum([0, *map(len, drawn)])].tolist()
    finished, at = [], 0
    for text, found in enumerate(results):
        queue = states[text]
        threshold = -queue[0][0] if queue else -np.inf
        finished.append([
            (
                spelled[cuts[at + i] : cuts[at + i + 1]],
                total,
                value,
                1.0 if threshold == -np.inf
                else float(-np.expm1(-np.exp(min(total - threshold, 50.0)))),
            )
            for i, (_, total, value) in enumerate(found)
        ])
        at += len(found)
    return finished


def _parts(
    lattice, edges, logs, offset, streams, bound, begins, sizes, carried
) -> tuple[np.ndarray, np.ndarray]:
    """Maxima of the parts that each step leaves behind, and the log probability before it."""
    if not len(edges):
        return np.zeros(0), np.zeros(0)
    running = np.cumsum(logs) - logs
    filled = begins[sizes > 0]
    running = running - np.repeat(running[filled], sizes[sizes > 0]) + carried
    with np.errstate(divide="ignore"):
        # the only edge of a node has odds of exactly 1
        location = running + np.log(1 - np.minimum(lattice.odds[edges], 1.0))
    uniform = _uniform(streams, offset + lattice.start[edges])
    return np.where(
        np.isfinite(location), _truncated(location, bound, uniform), -np.inf
    ), running


def _push(queue, values, path, logs, gone, draws, draw) -> None:
    """Put the path's best parts into the queue; more than ``draws`` are never opened."""
    if len(values) > draws:
        best = np.argpartition(-values, draws)[:draws]
    else:
        best = np.arange(len(values))
    for step in best.tolist():
        if values[step] > -np.inf:
            heapq.heappush(queue, (-float(values[step]), draw * (1 << 32) + step, step, path, logs, gone))


def sample_segmentations(
    docs: DataFrame,
    vocabulary: str,
    scores: np.ndarray,
    draws: int = DRAWS,
    sharpness: float = SHARPNESS,
    seed: int = SEED,
    id_column: str = "doc_id",
    text_column: str = "text",
    decode: bool = False,
) -> DataFrame:
    """``id, draw, ids, log_prob, perturbed, inclusion`` of ``draws`` segmentations per row.

    With ``decode`` also ``decoded``, the text of the ids.

    The draws of a row differ, in descending order of their perturbed value; a text with fewer
    segmentations has fewer rows. Empty and null texts have one, without ids, with certainty.
    Rows of equal key and text get equal draws; a null key counts as empty text. Whole texts are
    segmented; other columns are not read; no shuffle.
    """
    weights = docs.sparkSession.sparkContext.broadcast(scores * sharpness)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "draw", "ids", "log_prob", "perturbed", "inclusion"] + ["decoded"] * decode

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary)
        for batch in batches:
            keys, texts = batch.column("id"), batch.column("text")
            lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
            for low, high in _ranges(lengths, HELD_TOGETHER, CHARACTERS_HELD):
                found = sample_texts(
                    texts.slice(low, high - low).to_pylist(),
                    keys.slice(low, high - low).to_pylist(), pieces, weights.value, draws, seed,
                )
                flat = [(row, draw, *one) for row, of_row in enumerate(found, low)
                        for draw, one in enumerate(of_row, 1)]
                n_ids = np.array([len(f[2]) for f in flat], np.int64)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum(n_ids)]), pa.int32()),
                    pa.array(np.concatenate([f[2] for f in flat]).astype(np.int32)),
                )
                yield pa.record_batch(
                    [
                        keys.take(pa.array([f[0] for f in flat], pa.int64())),
                        pa.array([f[1] for f in flat], pa.int32()),
                        ids,
                        *(pa.array([f[c] for f in flat], pa.float64()) for c in (3, 4, 5)),
                        *([pieces.decode_all(ids).cast(pa.string())] if decode else []),
                    ],
                    names=names,
                )

    found = rows.mapInArrow(
        sample,
        f"id {kind}, draw int, ids array<int>, log_prob double, perturbed double, inclusion double"
        + (", decoded string" if decode else ""),
    )
    return found.withColumnRenamed("id", id_column)


def decode_pieces(rows: DataFrame, vocabulary: str, ids_column: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids; null ids stay null."""

    @F.pandas_udf("string")
    def decoded(ids):
        pieces = _pieces(vocabulary)
        return ids.map(lambda one: None if one is None else pieces.decode(np.asarray(one)))

    return rows.withColumn("decoded", decoded(F.col(ids_column)))


def segmentation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    docs = documents(spark, sf_dir)
    scores = piece_scores(docs, vocabulary)
    return sample_segmentations(docs, vocabulary, scores, decode=True).select(
        "doc_id", "draw",
        F.size("ids").cast("bigint").alias("n_pieces"),
        F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        "log_prob", "perturbed", "inclusion",
    )
