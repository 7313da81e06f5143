"""From raw documents to sampled training ids: five stages, each written before the next reads.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. All but the last keep the columns
of ``documents``; the last returns the sampled segmentations of what is left.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stationflow.llm.language import keep_known_languages
from stationflow.llm.mixing import mixed_documents
from stationflow.llm.near_duplicates import keep_one_of_each
from stationflow.llm.quality import keep_quality
from stationflow.llm.segmentations import piece_scores, sample_segmentations
from stationflow.llm.text import small_batches
from stationflow.session import settle


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and have enough words in content lines."""
    small_batches(spark)
    return keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach."""
    small_batches(spark)
    return keep_known_languages(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest id."""
    small_batches(spark)
    return keep_one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixed_documents(docs)


def segmentation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each document."""
    small_batches(spark)
    import public_tokenizers

    vocabulary = public_tokenizers.path("piece_bpe_32k.model")
    return sample_segmentations(docs, vocabulary, piece_scores(docs, vocabulary))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("segmentation", segmentation),
]

# Line labelling, learnt prototypes and sampling by key hashes are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in their order; each one's rows are written, and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
