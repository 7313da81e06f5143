"""Token counts with the whole-token shortcut.

A vocabulary string that its library encodes alone as its own single id is proven *whole*: the
merges of a byte-level BPE stay inside a pre-token, so every pre-token equal to it counts one
token. The proof runs once, offline, over the vocabulary (whose size bounds the table that goes
to the tasks). Only pre-tokens that are not whole are merged, by the library, once per worker.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm.pieces import Encoder, remembered
from stationflow.llm.text import documents

# Fixed value: the split before the merges, which byte-level vocabularies of this kind use.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LIMIT = 1024


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and encode alone as their own id."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content for t in library.get_added_tokens_decoder().values()}
    ids = sorted(library.get_vocab(with_added_tokens=False).values())
    strings = [library.decode([i], skip_special_tokens=False) for i in ids]
    found = library.encode_batch_fast(strings, add_special_tokens=False)
    return frozenset(
        s
        for i, s, e in zip(ids, strings, found)
        if e.ids == [i]
        and s not in special
        and len(library.pre_tokenizer.pre_tokenize_str(s)) == 1
    )


class Counter(Encoder):
    """An encoder that keeps only the number of tokens of each chunk."""

    def __init__(self, path: str, whole: frozenset[str], **limits):
        import regex

        super().__init__(path, **limits)
        self.cut = regex.compile(PRE_TOKENS).findall
        self.whole = whole

    def _counts(self, chunks: list[str]) -> np.ndarray:
        whole = self.whole
        rest = {c: self.cut(c) for c in chunks if c not in whole}
        to_merge = {p for cut in rest.values() for p in cut if p not in whole}
        spaced = [p[1:] for p in to_merge if p[0] == " " and not p[-1].isspace()]
        other = [p for p in to_merge if p[0] != " " or p[-1].isspace()]
        merged = dict(zip([" " + p for p in spaced], self.encode_spaced(spaced)[1].tolist()))
        merged.update(zip(other, self.encode_strings(other)[1].tolist()))
        return np.array(
            [1 if c in whole else sum(merged.get(p, 1) for p in rest[c]) for c in chunks], np.int64
        )

    def _store_counts(self, chunks: list[str]) -> range:
        counts = self._counts(chunks)
        first = self._store(np.zeros(0, np.uint32), np.zeros(len(counts), np.int64))
        self.length[first : first + len(counts)] = counts
        return range(first, first + len(counts))

    def _learn(self, pieces: list[str]) -> None:
        self.spaced.update(zip(pieces, self._store_counts([" " + p for p in pieces])))

    def _learn_heads(self, heads: list[str]) -> None:
        self.heads.update(zip(heads, self._store_counts(heads)))


def token_counts(
    docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text, one row per input row, without a shuffle.

    ``path`` is the vocabulary's place on every executor. A null text counts as empty (0, 0); a
    null id stays null; repeated rows are counted each; other columns are not read; no rows give
    no rows. A special token's string in a text is that one token, as by the library's default.
    """
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = remembered(Counter, path, whole.value)
        for batch in batches:
            texts = batch.column("text")
            yield pa.record_batch(
                [
                    batch.column("id"),
                    pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                    pa.array(counter.count(texts), pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens"],
            )

    counted = rows.mapInArrow(count, f"id {kind}, n_bytes bigint, n_tokens bigint")
    return counted.withColumnRenamed("id", id_column)


def token_counts_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counted = token_counts(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
