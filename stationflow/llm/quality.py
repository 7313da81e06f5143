"""Quality rules: counts of a text, and a linear-chain CRF that labels its lines.

Each line of a text is content or boilerplate. A conditional random field scores the lines by
their features and neighbouring lines by their pair of labels; Viterbi decoding finds the best
labelling of the whole text. A document is kept if enough of its words stand in content lines.

The field is trained here on labelled documents: lines of good documents count as content, lines
of bad ones as boilerplate. Training takes at most ``TRAINING_DOCUMENTS`` of either kind, chosen
by a hash of the key; everything else reads all documents in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.text import documents, set_aside, tables_of, words_of

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
WINDOW = 3

#: Labelled documents of each kind that the field is fitted on.
TRAINING_DOCUMENTS = 1500
#: The fit follows labels over so many lines at once; longer texts are cut into such stretches.
STRETCH = 400
#: Share of the words that must stand in content lines.
LEAST_CONTENT = 0.5

FEATURES = (
    "always", "one to three words", "over 40 words", "symbols over 2 %",
    "symbols over 8 %", "over half capitals", "over 0.9 capitals", "digits over 10 %",
    "ends a sentence", "earlier line again", "follows itself", "half the words repeat",
    "most words repeat", "a word follows itself often", "mean word over 9", "mean word under 3",
    "other marks over 15 %", "no small letter", "bars",
)
CONTENT, BOILERPLATE = 0, 1


@dataclass(frozen=True)
class Field:
    """Weights of a fitted CRF: features x labels, and label x next label."""

    emission: np.ndarray
    transition: np.ndarray

    @staticmethod
    def empty() -> Field:
        return Field(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))


def repeated_words(words: list[str]) -> int:
    """Words that stand in a window of three that the text holds twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    distinct = dict.fromkeys(words)
    size = len(distinct)
    if size == n:
        return 0
    number = dict(zip(distinct, range(size)))
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    if size < 1 << 20:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:  # three numbers do not fit one: number the pairs first
        _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        windows = pairs[:-1] * size + ids[2:]
    order = np.argsort(windows, kind="stable")
    line = windows[order]
    same = line[1:] == line[:-1]
    if not same.any():
        return 0
    often = np.zeros(n - 2, bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for shift in range(WINDOW):
        covered[shift : n - 2 + shift] |= often
    return int(covered.sum())


def _kinds() -> np.ndarray:
    """Of every code point: 1 capital, 2 small letter, 3 digit, 4 white space, 0 other."""
    held = tables_of("quality")
    if "kinds" not in held:
        of = np.zeros(0x110000, np.uint8)
        for code in range(0x110000):
            mark = chr(code)
            of[code] = (
                1 if mark.isupper() else 2 if mark.islower() or mark.isalpha()
                else 3 if mark.isdigit() else 4 if mark.isspace() else 0
            )
        held["kinds"] = of
    return held["kinds"]


def line_kinds(text: str) -> np.ndarray:
    """Capitals, small letters, digits and white space of each line, one row per line."""
    codes = np.frombuffer(f"{text}\n".encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.concatenate([[0], np.flatnonzero(codes == 10)[:-1] + 1])
    kinds = _kinds()[codes]
    return np.stack([np.add.reduceat(kinds == k, starts, dtype=np.int64) for k in (1, 2, 3, 4)], 1)


def line_features(
    line: str, words: list[str], kinds: list[int], again: bool, follows: bool
) -> list[bool]:
    upper, lower, digits, _ = kinds
    n, size, chars = len(words), max(1, len(line)), sum(map(len, words))
    marks = sum(map(line.count, SYMBOLS))
    letters = upper + lower
    other = chars - letters - digits
    distinct = len(set(words))
    twice = sum(map(str.__eq__, words, words[1:]))
    return [
        True, n <= 3, n > 40, marks > 0.02 * size, marks > 0.08 * size,
        2 * upper > letters > 0, 10 * upper > 9 * letters > 0, digits > 0.1 * size,
        words[-1][-1] in ".!?:\"”", again, follows,
        n > 4 and 2 * distinct <= n, n > 4 and 5 * distinct <= n, n > 4 and 5 * twice >= n,
        chars > 9 * n, chars < 3 * n, other > 0.15 * size, lower == 0, line.count("|") > 2,
    ]


def measure(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Counts of a text, the features of its lines with a word, and these lines' words."""
    words = words_of(text)
    if not words:
        return [0, 0, 0, 0, 0], _NO_LINES, _NO_WORDS
    seen: set[str] = set()
    before, features, sizes, repeats = None, [], [], 0
    for line, kinds in zip(text.split("\n"), line_kinds(text).tolist()):
        of_line = words_of(line)
        if of_line:
            again = line in seen
            features.append(line_features(line, of_line, kinds, again, line == before))
            sizes.append(len(of_line))
            repeats += again
            seen.add(line)
            before = line
    counts = [len(words), sum(map(len, words)), _symbols(text), repeats, repeated_words(words)]
    return counts, np.array(features, bool), np.array(sizes, np.int64)


def _symbols(text: str) -> int:
    return sum(map(text.count, SYMBOLS))


_NO_LINES = np.zeros((0, len(FEATURES)), bool)
_NO_WORDS = np.zeros(0, np.int64)


def base_failed(n_words: int, n_repeated: int) -> bool:
    return n_words < LEAST_WORDS or 100 * n_repeated > 50 * n_words


def _by_length(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines side by side: texts from long to short; where step t's lines begin; the order."""
    lengths = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lengths, kind="stable")
    ends = np.bincount(lengths, minlength=1)  # texts by their number of lines
    active = np.cumsum(ends[::-1])[::-1][1:]
    return order, lengths, active


def viterbi(field: Field, texts: list[np.ndarray]) -> list[np.ndarray]:
    """The best labels of each text's lines; ties go to content."""
    labels = [np.zeros(len(t), np.int8) for t in texts]
    order, lengths, active = _by_length(texts)
    if not len(active):
        return labels
    starts = np.cumsum(lengths) - lengths
    scores = np.concatenate([t for t in texts if len(t)]).astype(np.float64) @ field.emission
    best = np.zeros((len(texts), 2))
    came = []
    for t, n in enumerate(active.tolist()):
        here = scores[starts[order[:n]] + t]
        if t:
            paths = best[:n, :, None] + field.transition[None]
            came.append(paths.argmax(axis=1).astype(np.int8))
            here = here + paths.max(axis=1)
        best[:n] = here
    label = np.zeros(len(texts), np.int64)
    flat = np.zeros(len(scores), np.int8)
    for t in range(len(active) - 1, -1, -1):
        n = int(active[t])
        following = int(active[t + 1]) if t + 1 < len(active) else 0
        rows = np.arange(following)
        label[:following] = came[t][rows, label[:following]] if following else 0
        label[following:n] = best[following:n].argmax(axis=1)
        flat[starts[order[:n]] + t] = label[:n]
    return [flat[s : s + n] for s, n in zip(starts.tolist(), lengths.tolist())]


def fit_field(
    texts: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.1,
    stretch: int = STRETCH,
) -> Field:
    """Maximum likelihood with a small penalty, by Adam on the exact gradient.

    All lines count; between two stretches of a long text no label follows another.
    """
    both = [(t, y) for t, y in zip(texts, labels) if len(t)]
    if len({y for _, y in both}) < 2:
        return Field.empty()
    cut = [(t[s : s + stretch], y, len(t)) for t, y in both for s in range(0, len(t), stretch)]
    texts = [t for t, _, _ in cut]
    order, lengths, active = _by_length(texts)
    starts = np.cumsum(lengths) - lengths
    lines = np.concatenate(texts).astype(np.float64)
    truth = np.repeat([y for _, y, _ in cut], lengths)
    weight = np.repeat([1 / whole for _, _, whole in cut], lengths)  # texts count the same
    rows = [starts[order[:n]] + t for t, n in enumerate(active.tolist())]
    theta = np.zeros((len(FEATURES) + 2, 2))
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    hot = np.eye(2)[truth]
    for step in range(1, rounds + 1):
        emission, transition = theta[:-2], theta[-2:]
        scores = lines @ emission
        forward, backward = np.zeros_like(scores), np.zeros_like(scores)
        for t, at in enumerate(rows):
            forward[at] = scores[at]
            if t:
                prior = forward[at - 1][:, :, None] + transition
                forward[at] += np.logaddexp(prior[:, 0], prior[:, 1])
        for t in range(len(rows) - 1, 0, -1):
            at = rows[t]
            after = (scores[at] + backward[at])[:, None, :] + transition
            backward[at - 1] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        total = forward + backward
        partition = np.logaddexp(total[:, 0], total[:, 1])
        share = np.exp(total - partition[:, None])
        slope = np.zeros_like(theta)
        slope[:-2] = lines.T @ ((hot - share) * weight[:, None])
        for at in rows[1:]:
            pair = (
                forward[at - 1][:, :, None] + transition
                + (scores[at] + backward[at])[:, None, :] - partition[at][:, None, None]
            )
            seen = hot[at - 1][:, :, None] * hot[at][:, None, :]
            slope[-2:] += ((seen - np.exp(pair)) * weight[at][:, None, None]).sum(axis=0)
        slope = slope / len(both) - 0.002 * theta
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (
            np.sqrt(square / (1 - 0.99**step)) + 1e-9
        )
    return Field(theta[:-2], theta[-2:])


def train_field(
    docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS
) -> Field:
    """The field fitted on up to ``most`` labelled documents of each kind, chosen by key hash.

    All their lines count. Of several rows with one id, one counts: that with the least features.
    Labels other than 0 and 1, and null ids, are ignored; without both kinds the field knows
    nothing, and every line is content.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select("doc_id", "quality")
    chosen = None
    for kind in (0, 1):
        part = (
            known.where(F.col("quality") == kind)
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        )
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen.distinct()), "doc_id")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t)[1] for t in batch.column("text").to_pylist()]
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("quality"),
                    pa.array([np.packbits(f, axis=1).tobytes() for f in found], pa.binary()),
                ],
                names=["doc_id", "quality", "lines"],
            )

    kinds = dict(rows.dtypes)
    measured = rows.mapInArrow(
        features, f"doc_id {kinds['doc_id']}, quality {kinds['quality']}, lines binary"
    )
    sample = measured.groupBy("doc_id", "quality").agg(F.min("lines").alias("lines")).collect()
    width = (len(FEATURES) + 7) // 8
    sample.sort(key=lambda r: (r["doc_id"], r["quality"], bytes(r["lines"])))
    texts = [
        np.unpackbits(
            np.frombuffer(bytes(r["lines"]), np.uint8).reshape(-1, width), axis=1
        )[:, : len(FEATURES)].astype(bool)
        for r in sample
    ]
    return fit_field(texts, [BOILERPLATE if r["quality"] == 0 else CONTENT for r in sample])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge_quality(
    docs: DataFrame, field: Field, text_column: str = "text", least: float = LEAST_CONTENT
) -> DataFrame:
    """``docs`` with a struct ``quality``: counts, base_failed, content_share, content, kept.

    ``content`` holds one flag per line with a word. Every whole text is read; a null text has no
    words and fails the base rules, as an empty one does. Rows are judged each for itself, so
    repeated rows get equal verdicts; no rows give none. A column ``quality`` is replaced, other
    columns stay. No shuffle.
    """
    schema = (
        ", ".join(f"{c} bigint" for c in COUNTS)
        + ", base_failed boolean, content_share double, content array<boolean>, kept boolean"
    )

    @F.pandas_udf(schema)
    def judged(texts):
        import pandas as pd

        rows = []
        for start in range(0, len(texts), 500):
            found = [measure(t) for t in texts.iloc[start : start + 500]]
            labels = viterbi(field, [lines for _, lines, _ in found])
            for (counts, _, sizes), label in zip(found, labels):
                content = label == CONTENT
                share = float(sizes[content].sum() / sizes.sum()) if len(sizes) else 0.0
                failed = base_failed(counts[0], counts[4])
                rows.append((*counts, failed, share, content, not failed and share >= least))
        return pd.DataFrame(
            rows, columns=[*COUNTS, "base_failed", "content_share", "content", "kept"]
        )

    return docs.withColumn("quality", judged(F.col(text_column)))


def quality_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    field = train_field(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = judge_quality(docs.select("doc_id", "text"), field)
    return judged.select(
        "doc_id",
        *(f"quality.{c}" for c in COUNTS),
        "quality.base_failed",
        "quality.kept",
        "quality.content_share",
    )


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns, whatever their names."""
    aside = set_aside(docs, "quality")
    judged = judge_quality(docs.withColumnsRenamed(aside), train_field(docs, labels))
    kept = judged.where("quality.kept").drop("quality")
    return kept.withColumnsRenamed({v: k for k, v in aside.items()})
