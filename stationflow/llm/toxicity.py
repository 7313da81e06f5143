"""Toxicity by a classifier chain.

The categories are predicted one after the other by linear models on word counts; every model
also sees the probabilities of the categories before it. In training these probabilities are
out-of-fold: the words, the marked words, the median and the weights behind them come from the other
folds alone, so later links learn from inputs as uncertain as those they meet. Equal texts share a
fold.

Categories, of which only the first is labelled in the data, the others following from the label
and the text: ``toxic``; ``severe``, toxic with a share of marked words at or above the median of
the toxic training texts; ``repeated``, toxic with one marked word twice or more. Marked words are
those that the training texts show to be far more frequent in toxic ones.

Fitting takes at most ``TRAINING_DOCUMENTS`` labelled documents of either kind, chosen by a hash
of the key. Prediction reads every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stationflow.llm.text import documents
from stationflow.session import settle

CATEGORIES = ("toxic", "severe", "repeated")
TRAINING_DOCUMENTS = 4000
#: Words of the models at most, and the least evidence (in standard errors) for one.
VOCABULARY = 400
EVIDENCE = 5.0
#: A marked word is at least so many times as likely in a toxic text.
MARKED_RATIO = 10.0
FOLDS = 5
LEAST_PROBABILITY = 0.5

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Chain:
    """Words, which of them are marked, and one weight row per category (bias last)."""

    words: dict[str, int] = field(default_factory=dict)
    marked: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, inputs: np.ndarray) -> np.ndarray:
        """One column per category; an untrained chain finds nothing toxic."""
        found = np.zeros((len(inputs), len(CATEGORIES)))
        for link, weight in enumerate(self.weights):
            found[:, link] = _sigmoid(_linked(inputs, found[:, :link]) @ weight)
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _linked(inputs: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.hstack([inputs, before, np.ones((len(inputs), 1))])


def _fit(inputs: np.ndarray, truth: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Logistic regression with a small penalty, by accelerated gradient steps."""
    weight = np.zeros(inputs.shape[1])
    moved = weight.copy()
    # both kinds weigh the same, so a rare category is not drowned
    share = truth.mean()
    if share in (0.0, 1.0):
        weight[-1] = 30.0 if share else -30.0
        return weight
    balance = np.where(truth > 0, 0.5 / share, 0.5 / (1 - share)) / len(truth)
    penalty = np.full(inputs.shape[1], 1e-3)
    penalty[-1] = 0
    rate = 4 / ((inputs**2).sum(axis=1) * balance).sum()
    for step in range(rounds):
        slope = inputs.T @ ((_sigmoid(inputs @ moved) - truth) * balance) + penalty * moved
        following = moved - rate * slope
        moved = following + step / (step + 3) * (following - weight)
        weight = following
    return weight


@dataclass(frozen=True)
class Pick:
    """Words chosen for a model: their columns, and which of them are marked."""

    places: np.ndarray
    marked: np.ndarray


def category_truth(
    counts: np.ndarray, sizes: np.ndarray, marked: np.ndarray, toxic: np.ndarray, known: np.ndarray
) -> np.ndarray:
    """One column per category; the median share is that of the toxic texts among ``known``."""
    hits = counts[:, marked]
    share = hits.sum(axis=1) / np.maximum(sizes, 1)
    bad = toxic > 0
    typical = np.median(share[bad & known]) if (bad & known).any() else np.inf
    severe = bad & (share >= typical) & (share > 0)
    return np.stack([bad, severe, bad & (hits.max(axis=1, initial=0) >= 2)], axis=1).astype(float)


def fit_chain(
    words: list[str], picks: list[Pick], counts: np.ndarray, sizes: np.ndarray,
    toxic: np.ndarray, folds: np.ndarray,
) -> Chain:
    """The chain from word counts of the training texts; ``folds`` are 0 to ``FOLDS`` - 1.

    The first of ``picks`` is chosen on all texts, the others each without one fold.
    """
    everyone = np.ones(len(counts), bool)

    def seen_by(pick: Pick, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = counts[:, pick.places].astype(np.float64)
        truth = category_truth(own, sizes, pick.marked, toxic, known)
        return chain_inputs(own, sizes, pick.marked), truth

    outside = np.zeros((len(counts), len(CATEGORIES)))
    for link in range(len(CATEGORIES) - 1):
        for fold, pick in enumerate(picks[1:]):
            out = folds == fold
            if out.any() and not out.all():
                inputs, truth = seen_by(pick, ~out)
                linked = _linked(inputs, outside[:, :link])
                part = _fit(linked[~out], truth[~out, link])
                outside[out, link] = _sigmoid(linked[out] @ part)
    inputs, truth = seen_by(picks[0], everyone)
    weights = [
        _fit(_linked(inputs, outside[:, :link]), truth[:, link]) for link in range(len(CATEGORIES))
    ]
    own = [words[i] for i in picks[0].places]
    return Chain({w: i for i, w in enumerate(own)}, picks[0].marked, weights)


def chain_inputs(counts: np.ndarray, sizes: np.ndarray, marked: np.ndarray) -> np.ndarray:
    hits = counts[:, marked]
    share = hits.sum(axis=1) / np.maximum(sizes, 1)
    return np.hstack([
        np.log1p(counts),
        np.log1p(1000 * share)[:, None],
        np.log1p(hits.max(axis=1, initial=0))[:, None],
        (hits.sum(axis=1) > 0)[:, None],
    ])


def word_counts(texts: pa.Array, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the model's words (runs of letters, lower case) and of all words, per text."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    for space in "\t\n\x0b\x0c\r":
        plain = pc.replace_substring(plain, space, " ")
    cut = pc.split_pattern(plain, " ")
    starts = cut.offsets.to_numpy().astype(np.int64)
    starts -= starts[0]
    found = cut.flatten().dictionary_encode()
    codes = found.indices.to_numpy()
    distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()
    filled = np.array([w != "" for w in distinct], bool)
    counts = np.zeros((len(texts), len(words)), np.float64)
    hits = [
        [words[t] for t in _LETTERS.findall(w.lower()) if t in words] for w in distinct
    ]
    special = np.array([bool(h) for h in hits], bool)
    of_text = np.repeat(np.arange(len(texts)), np.diff(starts))
    for at in np.flatnonzero(special[codes]).tolist():
        for word in hits[codes[at]]:
            counts[of_text[at], word] += 1
    running = np.concatenate([[0], np.cumsum(filled[codes])])
    return counts, running[starts[1:]] - running[starts[:-1]]


def _words_per_text(rows: DataFrame) -> DataFrame:
    """Each distinct word (letters, lower case) of each training text, with its label and fold."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = (batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))
            for text, label, fold in zip(*of):
                words = sorted({w.lower() for w in _LETTERS.findall(text or "")})
                yield pa.record_batch(
                    [pa.array(words, pa.string()), pa.array([label] * len(words), pa.int32()),
                     pa.array([fold] * len(words), pa.int32())],
                    names=["word", "toxic", "fold"],
                )

    return rows.select("text", "toxic", "fold").mapInArrow(cut, "word string, toxic int, fold int")


def fold_of(text: Column) -> Column:
    """The fold of a training text; equal texts are in one."""
    return F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int")


def chosen_words(rows: DataFrame, sizes: dict[tuple[int, int], int]) -> DataFrame:
    """``pick, word, marked``: the words with most evidence, on all texts and without each fold.

    Pick 0 counts all texts, pick k + 1 all but those of fold k; ``sizes`` are texts by label and
    fold. At most ``VOCABULARY`` words a pick; equal evidence goes by word.
    """
    in_fold_of = [
        F.count_if((F.col("toxic") == kind) & (F.col("fold") == fold)).alias(f"n{kind}_{fold}")
        for kind in (0, 1) for fold in range(FOLDS)
    ]
    picks = []
    for pick in range(FOLDS + 1):
        kept = [fold for fold in range(FOLDS) if fold != pick - 1]
        n1, n0 = (sum(sizes.get((kind, f), 0) for f in kept) for kind in (1, 0))
        if not n1 or not n0:
            continue
        p, q = (
            (sum((F.col(f"n{kind}_{f}") for f in kept), F.lit(0)) + 0.5) / (n + 1)
            for kind, n in ((1, n1), (0, n0))
        )
        evidence = (p - q) / F.sqrt(p * (1 - p) / n1 + q * (1 - q) / n0)
        picks.append(F.struct(
            F.lit(pick).alias("pick"), evidence.alias("evidence"),
            ((evidence > 0) & (p >= MARKED_RATIO * q)).alias("marked"),
        ))
    found = (
        _words_per_text(rows).groupBy("word").agg(*in_fold_of)
        .select("word", F.inline(F.array(*picks)))
        .where(F.abs("evidence") >= EVIDENCE)
    )
    order = Window.partitionBy("pick").orderBy(F.abs("evidence").desc(), "word")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= VOCABULARY).select("pick", "word", "marked")


def train_chain(
    docs: DataFrame, labels: DataFrame, most: int = TRAINING_DOCUMENTS
) -> Chain:
    """The chain fitted on up to ``most`` labelled documents of each kind.

    Of several rows with one id, one counts: that with the least text. Labels other than 0 and 1,
    and null ids, are ignored; without both kinds the chain is untrained.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").select(
        "doc_id", F.col("toxic").cast("int").alias("toxic")
    ).distinct()
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*by_hash).limit(most).unionByName(
        known.where("toxic = 0").orderBy(*by_hash).limit(most)
    )
    rows = settle(
        docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
        .withColumn("fold", fold_of(F.col("text")))
    )
    sizes = {
        (r["toxic"], r["fold"]): r["count"] for r in rows.groupBy("toxic", "fold").count().collect()
    }
    if len({kind for kind, _ in sizes}) < 2:
        return Chain()
    found = chosen_words(rows, sizes).collect()
    if not any(r["pick"] == 0 for r in found):
        return Chain()
    words = sorted({r["word"] for r in found})
    places = {w: i for i, w in enumerate(words)}
    picks = []
    for pick in range(FOLDS + 1):
        own = sorted((places[r["word"]], r["marked"]) for r in found if r["pick"] == pick)
        picks.append(Pick(np.array([i for i, _ in own], int), np.array([m for _, m in own], bool)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                counts, of_text = word_counts(batch.column("text"), places)
                hits = [np.flatnonzero(c) for c in counts]
                yield pa.record_batch(
                    [
                        batch.column("doc_id").cast(pa.string()), batch.column("toxic"),
                        batch.column("fold"), pa.array(of_text, pa.int64()),
                        pa.array([h.astype(np.int32) for h in hits], pa.list_(pa.int32())),
                        pa.array([c[h].astype(np.int32) for c, h in zip(counts, hits)],
                                 pa.list_(pa.int32())),
                    ],
                    names=["id", "toxic", "fold", "n", "places", "counts"],
                )

    schema = "id string, toxic int, fold int, n bigint, places array<int>, counts array<int>"
    sample = sorted(rows.mapInArrow(count, schema).collect(), key=lambda r: (r["id"], r["toxic"]))
    counts = np.zeros((len(sample), len(words)), np.float32)
    for row, r in zip(counts, sample):
        row[r["places"]] = r["counts"]
    return fit_chain(
        words, picks, counts,
        np.array([r["n"] for r in sample], np.float64),
        np.array([r["toxic"] for r in sample]),
        np.array([r["fold"] for r in sample]),
    )


def predict_toxicity(
    docs: DataFrame, chain: Chain, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``id, p_toxic, p_severe, p_repeated`` and one flag per category, for every whole text.

    A null text counts as empty, a null id stays null. A later category is flagged only where the
    first is. Repeated rows get equal rows, no rows give none; other columns are not read, whatever
    their names; no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                if model.weights:
                    counts, sizes = word_counts(batch.column("text"), model.words)
                    found = model.probabilities(chain_inputs(counts, sizes, model.marked))
                else:
                    found = np.zeros((batch.num_rows, len(CATEGORIES)))
                flags = found >= LEAST_PROBABILITY
                flags &= flags[:, :1]
                yield pa.record_batch(
                    [batch.column("id"), *map(pa.array, found.T.copy()), *map(pa.array, flags.T.copy())],
                    names=["id", *(f"p_{c}" for c in CATEGORIES), *CATEGORIES],
                )

    columns = [f"p_{c} double" for c in CATEGORIES] + [f"{c} boolean" for c in CATEGORIES]
    found = rows.mapInArrow(predict, ", ".join([f"id {kind}", *columns]))
    return found.withColumnRenamed("id", id_column)


def toxicity_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predict_toxicity(docs, train_chain(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
