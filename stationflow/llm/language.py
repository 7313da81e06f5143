"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A letter trigram binds
the vectors of its letters, each rotated by its place, into one vector; a text bundles (sums) the
vectors of its trigrams. A language's prototype bundles all its training texts. The prediction is
the prototype with the largest cosine to the text's vector.

Bundling is linear: each task bundles its texts, and Spark adds up one vector per task and language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.text import documents, in_fold, set_aside, spare_name, tables_of
from stationflow.session import settle

UNKNOWN = "und"
SEED = 20240607
#: Length of the vectors.
WIDTH = 512
#: A text is in no learnt language below this share of the labelled texts' median score, each left
#: out of its own prototype; five standard deviations of the cosine of unrelated vectors at least.
LEAST_SHARE = 1 / 3
CHANCE_SCORE = 5 / WIDTH**0.5
#: Code points take 21 bits, so that three make one number.
BITS = 21
#: A task adds up so many trigrams of a language before it binds their vectors.
HELD = 200_000


def symbol_table() -> np.ndarray:
    """The symbol of every code point: the letter in lower case, 0 for all that is no letter."""
    held = tables_of("language")
    if "symbols" not in held:
        table = np.zeros(0x110000, np.int32)
        for code in range(0x110000):
            letter = chr(code)
            if letter.isalpha():
                table[code] = ord(letter.lower()[0])
        held["symbols"] = table
    return held["symbols"]


def letter_vectors(symbols: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The random vector of every symbol, one row each."""
    held = tables_of("language").setdefault(("letters", width, seed), {})
    for symbol in symbols.tolist():
        if symbol not in held:
            draw = np.random.default_rng([seed, symbol])
            held[symbol] = (2 * draw.integers(0, 2, width) - 1).astype(np.int8)
    return np.array([held[s] for s in symbols.tolist()], np.int8).reshape(-1, width)


def trigram_vectors(found: np.ndarray, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """The bound vector of every trigram number, one row each."""
    places = [found >> 2 * BITS, found >> BITS & (1 << BITS) - 1, found & (1 << BITS) - 1]
    symbols, at = np.unique(np.stack(places), return_inverse=True)
    first, second, third = at.reshape(3, -1)
    letters = letter_vectors(symbols, width, seed)
    bound = np.roll(letters, 2, axis=1)[first]
    bound *= np.roll(letters, 1, axis=1)[second]
    bound *= letters[third]
    return bound


def trigrams(text: str | None) -> np.ndarray | None:
    """Trigram numbers of a text in order; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    symbols = symbol_table()[codes]
    letters = symbols > 0
    if not letters.any():
        return None
    kept = letters.copy()
    kept[1:] |= letters[:-1]  # of a run without letters, only the place after a letter stays
    found = symbols[kept]
    line = np.zeros(len(found) + (2 if found[-1] else 1), np.int64)
    line[1 : 1 + len(found)] = found  # a gap opens and closes every text
    return line[:-2] << 2 * BITS | line[1:-1] << BITS | line[2:]


def weights_of(counts: np.ndarray) -> np.ndarray:
    """What trigrams of a text weigh: the root of their count, in eighths, as whole numbers.

    A text that repeats itself does not take over a language's prototype.
    """
    return np.rint(8 * np.sqrt(counts)).astype(np.int64)


def _bundled(
    seen: np.ndarray, weights: np.ndarray, width: int, seed: int, kind: type
) -> np.ndarray:
    """The weighted sum of the trigrams' vectors."""
    vector = np.zeros(width, kind)
    for start in range(0, len(seen), 2048):
        part = slice(start, start + 2048)
        vector += weights[part].astype(kind) @ trigram_vectors(seen[part], width, seed).astype(kind)
    return vector


class _Bundle:
    """A language's vector so far, and trigrams that are still to be bound.

    Equal trigrams are added up first, so that each is bound once for many texts. The sums are whole
    numbers, so their order does not matter.
    """

    def __init__(self, width: int, seed: int):
        self.width, self.seed = width, seed
        self.vector = np.zeros(width)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, seen: np.ndarray, weights: np.ndarray) -> None:
        self.waiting.append((seen, weights))
        self.size += len(seen)
        if self.size > HELD:
            self._join()
            if self.size > HELD // 2:
                self._bind()

    def _join(self) -> None:
        seen, at = np.unique(np.concatenate([s for s, _ in self.waiting]), return_inverse=True)
        weights = np.bincount(at, weights=np.concatenate([w for _, w in self.waiting]))
        self.waiting, self.size = [(seen, weights)], len(seen)

    def _bind(self) -> None:
        for seen, weights in self.waiting:
            self.vector += _bundled(seen, weights, self.width, self.seed, np.float64)
        self.waiting, self.size = [], 0

    def total(self) -> np.ndarray:
        if self.waiting:
            self._join()
            self._bind()
        return np.rint(self.vector).astype(np.int64)


def learn_prototypes(training: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """One row per language of ``training`` (lang, text): its prototype as 64-bit floats.

    All texts count in full. Rows without language, text or letters teach nothing.
    """
    rows = training.select("lang", "text").where("lang is not null and text is not null")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles: dict[str, _Bundle] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                found = trigrams(text)
                if found is None:
                    continue
                seen, times = np.unique(found, return_counts=True)
                bundles.setdefault(lang, _Bundle(width, seed)).add(seen, weights_of(times))
        for lang, of_lang in bundles.items():
            yield pa.record_batch(
                [
                    pa.array([lang] * width, pa.string()),
                    pa.array(np.arange(width), pa.int32()),
                    pa.array(of_lang.total()),
                ],
                names=["lang", "place", "n"],
            )

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        total = group.sort_values("place")["n"].to_numpy(np.float64)
        return pd.DataFrame({"lang": [group["lang"].iloc[0]], "prototype": [total.tobytes()]})

    # as many rows per task and language as a vector is long, added up before they meet
    sums = rows.mapInArrow(bundle, "lang string, place int, n bigint")
    places = sums.groupBy("lang", "place").agg(F.sum("n").alias("n"))
    return places.groupBy("lang").applyInPandas(joined, "lang string, prototype binary")


def text_vector(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray | None:
    """The bundled vector of a text; None if it has no letter."""
    found = trigrams(text)
    if found is None:
        return None
    seen, times = np.unique(found, return_counts=True)
    return _bundled(seen, weights_of(times), width, seed, np.float32)


def predict_languages(
    docs: DataFrame,
    prototypes: DataFrame,
    text_column: str = "text",
    width: int = WIDTH,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the cosine to that prototype (0 to 1).

    The prediction reads the text alone. Without text, letters or prototypes it is ``und`` with
    score 0; equal cosines go to the first language by name. Prototypes are one vector per learnt
    language and go to every task; columns named ``lang_pred`` or ``score`` are replaced.
    """
    learnt = sorted((r["lang"], bytes(r["prototype"])) for r in prototypes.collect())
    names = [lang for lang, _ in learnt]
    matrix = np.array([np.frombuffer(v) for _, v in learnt]).reshape(len(names), width)
    matrix = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    matrix = matrix.astype(np.float32)
    rest = docs.drop("lang_pred", "score")

    def of_text(text: str | None) -> tuple[str, float]:
        vector = text_vector(text, width, seed) if names else None
        if vector is None:
            return UNKNOWN, 0.0
        cosines = matrix @ vector / max(float(np.linalg.norm(vector)), 1e-30)
        best = int(np.argmax(cosines))
        return names[best], min(1.0, max(0.0, float(cosines[best])))

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of_text(t) for t in texts], columns=["lang_pred", "score"])

    name = spare_name(rest, "_language")
    found = rest.withColumn(name, predicted(F.col(text_column)))
    return found.select(*(F.col(f"`{c}`") for c in rest.columns), f"{name}.*")


def language_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    outside = in_fold(F.col("doc_id"), 3, 1)
    prototypes = learn_prototypes(docs.where(~outside))
    rows = docs.select("doc_id", outside.alias("held_out"), "text")
    return predict_languages(rows, prototypes).drop("text")


def least_score(training: DataFrame, prototypes: DataFrame) -> float:
    """The score that a text in a learnt language reaches, from all of ``training`` (lang, text).

    A text is measured against its language's prototype without its own vector, as a new text
    would be. A language's only text has nothing to be measured against.
    """
    learnt = {r["lang"]: np.frombuffer(bytes(r["prototype"])) for r in prototypes.collect()}

    def left_out(lang: str | None, text: str | None) -> float | None:
        vector = text_vector(text) if lang in learnt else None
        if vector is None:
            return None
        rest = learnt[lang] - vector
        norms = float(np.linalg.norm(rest)) * float(np.linalg.norm(vector))
        return float(rest @ vector) / norms if norms else None

    @F.pandas_udf("double")
    def measured(langs: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([left_out(a, b) for a, b in zip(langs, texts)], dtype="float64")

    scores = training.where("lang is not null and text is not null").select(
        measured("lang", "text").alias("score")
    )
    median = scores.where("not isnan(score)").agg(F.percentile_approx("score", 0.5, 10_000)).head()[0]
    return max(CHANCE_SCORE, LEAST_SHARE * (median or 0.0))


def keep_known_languages(docs: DataFrame) -> DataFrame:
    """The documents in a learnt language; prototypes come from all labelled ones among them.

    Documents without text or letters go. The columns of ``docs`` stay, whatever their names; no
    rows give none.
    """
    prototypes = settle(learn_prototypes(docs))
    least = least_score(docs, prototypes)
    aside = set_aside(docs, "lang_pred", "score")
    kept = predict_languages(docs.withColumnsRenamed(aside), prototypes).where(
        (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    )
    return kept.drop("lang_pred", "score").withColumnsRenamed({v: k for k, v in aside.items()})
