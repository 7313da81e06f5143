"""Token ids as files: documents in key order, ids packed with Simple-8b.

A file set is a folder of Parquet parts. Each part is one shard, a range of keys; each row is a
block of whole documents:

``shard, block``   place in the order; ``first``: ids of the shard before this block
``n_ids``          ids of the block, end ids included
``words``          little-endian 64-bit Simple-8b words; ``escapes``: values too wide for them
``offsets``        little-endian 64-bit: ids before every 128th word, to decode a stretch alone
``keys, lengths``  the block's documents and their number of ids
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import simple8b
from stationflow.llm.pieces import Encoder, remembered
from stationflow.llm.text import documents
from stationflow.session import scratch_folder

#: A block is closed by the document that brings it to so many ids.
BLOCK_IDS = 1 << 16


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    folder: str,
    end_id: int = 0,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> None:
    """Encode every whole text and write the ids in ascending key order.

    The texts are range-partitioned by key and sorted inside a partition; null keys come first, equal
    keys are ordered by a hash of their text and then the text, so that a key with very many rows is
    spread over ranges too. A null text holds its end id only. Other columns are not read. No rows
    give a folder without blocks.
    """
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    ordered = (
        rows.withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(F.col("id").asc_nulls_first(), "hash")
        .sortWithinPartitions(F.col("id").asc_nulls_first(), "hash", F.col("text").asc_nulls_first())
        .drop("hash")
        .withColumn("shard", F.spark_partition_id())
    )

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = remembered(Encoder, vocabulary)
        first = block = 0
        for batch in batches:
            ids, lengths = encoder.encode(batch.column("text"))
            ends = np.cumsum(lengths)
            with_end = np.insert(ids, ends, end_id).astype(np.uint64)
            lengths = lengths + 1
            ends = np.cumsum(lengths)
            at = 0
            while at < len(lengths):
                before = int(ends[at] - lengths[at])
                to = min(int(np.searchsorted(ends, before + BLOCK_IDS)) + 1, len(lengths))
                held = with_end[before : int(ends[to - 1])]
                words, escapes, offsets = simple8b.pack(held)
                yield pa.record_batch(
                    [
                        batch.column("shard").slice(at, 1),
                        pa.array([block], pa.int64()),
                        pa.array([first], pa.int64()),
                        pa.array([len(held)], pa.int64()),
                        pa.array([words.astype("<u8").tobytes()], pa.binary()),
                        pa.array([escapes.astype("<u8").tobytes()], pa.binary()),
                        pa.array([offsets.astype("<i8").tobytes()], pa.binary()),
                        pa.ListArray.from_arrays(
                            pa.array([0, to - at], pa.int32()), batch.column("id").slice(at, to - at)
                        ),
                        pa.array([lengths[at:to].tolist()], pa.list_(pa.int64())),
                    ],
                    names=["shard", "block", "first", "n_ids", "words", "escapes", "offsets",
                           "keys", "lengths"],
                )
                first, block, at = first + len(held), block + 1, to

    ordered.mapInArrow(
        blocks,
        "shard int, block bigint, first bigint, n_ids bigint, words binary, escapes binary, "
        f"offsets binary, keys array<{kind}>, lengths array<bigint>",
    ).write.option("compression", "none").parquet(folder)


def read_token_files(
    spark: SparkSession, folder: str, id_column: str = "doc_id"
) -> DataFrame:
    """Every document of a file set: key, ``start`` (ids of all documents before it), ``ids``.

    ``ids`` are little-endian unsigned 32-bit integers, the end id included. Blocks decode
    independently; only one total per shard passes through the driver.
    """
    blocks = spark.read.parquet(folder)
    kind = blocks.schema["keys"].dataType.elementType.simpleString()
    totals = sorted(
        (row["shard"], row["n"])
        for row in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()
    )
    before, seen = {}, 0
    for shard, n in totals:
        before[shard], seen = seen, seen + n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in
                       ("shard", "first", "n_ids", "words", "escapes")}
                lengths = batch.column("lengths")[i].values.to_numpy()
                ids = simple8b.unpack(
                    np.frombuffer(row["words"].as_buffer(), "<u8"),
                    np.frombuffer(row["escapes"].as_buffer(), "<u8"),
                    row["n_ids"].as_py(),
                ).astype("<u4")
                ends = np.cumsum(lengths)
                start = before[row["shard"].as_py()] + row["first"].as_py() + ends - lengths
                offsets = pa.py_buffer((4 * np.concatenate([[0], ends])).astype(np.int32))
                yield pa.record_batch(
                    [
                        batch.column("keys")[i].values,
                        pa.array(start, pa.int64()),
                        pa.Array.from_buffers(
                            pa.binary(), len(lengths), [None, offsets, pa.py_buffer(ids)]
                        ),
                    ],
                    names=["id", "start", "ids"],
                )

    parts = blocks.select("shard", "first", "n_ids", "words", "escapes", "keys", "lengths")
    found = parts.mapInArrow(decode, f"id {kind}, start bigint, ids binary")
    return found.withColumnRenamed("id", id_column)


def token_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = f"{scratch_folder(spark)}/token-files"
    write_token_files(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), folder
    )
    return read_token_files(spark, folder).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )
