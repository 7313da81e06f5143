import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stationflow.llm import simple8b
from stationflow.llm.pieces import Encoder
from stationflow.llm.token_counts import Counter, token_counts, whole_tokens
from stationflow.llm.token_files import read_token_files, write_token_files


@pytest.fixture(scope="module")
def library(bpe):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe)


def awkward(n=3000):
    rng = random.Random(1)
    alphabet = "ab '1½\n\t  \x1c\x85é日́_-s٣\U0001f600"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(n)]
    texts += [f"a{chr(c)} b{chr(c)}{chr(c)}1 {chr(c)}" for c in range(0x3100)]
    return [None, "", " ", "a <|endoftext|> b", "ends  ", *texts]


def test_ids_and_counts_are_the_librarys(bpe, library):
    texts = awkward()
    ids, lengths = Encoder(bpe).encode(pa.array(texts, pa.string()))
    counts = Counter(bpe, whole_tokens(bpe)).count(pa.array(texts, pa.string()))
    wanted = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert lengths.tolist() == counts.tolist() == [len(w) for w in wanted]
    assert ids.tolist() == [i for w in wanted for i in w]


def test_encoder_that_forgets_gives_the_same(bpe):
    texts = pa.array(awkward(300), pa.string())
    small, large = Encoder(bpe, remembered=50), Encoder(bpe)
    for part in (texts, texts.slice(7), texts.slice(0, 0)):
        assert [x.tolist() for x in small.encode(part)] == [x.tolist() for x in large.encode(part)]


def test_whole_tokens_encode_alone(bpe, library):
    whole = whole_tokens(bpe)
    assert len(whole) > 40_000
    for token in random.Random(2).sample(sorted(whole), 200):
        assert len(library.encode(token, add_special_tokens=False).ids) == 1


def test_token_counts(odd_docs, corpus, no_docs, bpe, library):
    found = token_counts(odd_docs, bpe)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens"]
    wanted = sorted(
        (str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids))
        for i, t, *_ in corpus
    )
    assert sorted((str(a), b, c) for a, b, c in found.collect()) == wanted
    assert token_counts(no_docs, bpe).count() == 0


@pytest.mark.parametrize("values", [
    [], [0] * 500, [2**64 - 1, 0, 1], list(range(1000)), [2**59, 2**60, 2**60 - 1] * 40,
])
def test_simple8b_round_trip(values):
    words, escapes, offsets = simple8b.pack(np.array(values, np.uint64))
    assert simple8b.unpack(words, escapes, len(values)).tolist() == values
    for low in range(0, len(values) + 1, 37):
        part = simple8b.unpack_range(words, escapes, offsets, len(values), low, low + 50)
        assert part.tolist() == values[low : low + 50]


def test_simple8b_random():
    rng = np.random.default_rng(0)
    for bits in (1, 5, 16, 33, 63):
        values = rng.integers(0, 1 << bits, 5000).astype(np.uint64) >> rng.integers(0, bits, 5000).astype(np.uint64)
        words, escapes, _ = simple8b.pack(values)
        assert (simple8b.unpack(words, escapes, 5000) == values).all()


def test_token_files(spark, odd_docs, corpus, no_docs, bpe, library, tmp_path):
    write_token_files(odd_docs, bpe, str(tmp_path / "ids"))
    rows = read_token_files(spark, str(tmp_path / "ids")).orderBy("start").collect()
    start = 0
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r["doc_id"] for r in rows] == [r[0] for r in order]
    for row, (_, text, *_) in zip(rows, order):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        raw = np.array(ids, "<u4").tobytes()
        assert row["start"] == start and zlib.crc32(bytes(row["ids"])) == zlib.crc32(raw)
        start += len(ids)
    write_token_files(no_docs, bpe, str(tmp_path / "none"))
    assert read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_a_hot_key_is_spread_over_shards(spark, bpe, library, tmp_path):
    texts = [f"text number {i} of one key" for i in range(200)]
    docs = spark.createDataFrame([(7, t) for t in texts] + [(None, "x")], "doc_id bigint, text string")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # so few rows would share one range
    spark.conf.set(key, "false")
    write_token_files(docs.repartition(4), bpe, str(tmp_path / "hot"))
    spark.conf.set(key, "true")
    assert spark.read.parquet(str(tmp_path / "hot")).select("shard").distinct().count() > 1
    rows = read_token_files(spark, str(tmp_path / "hot")).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None] + [7] * 200
    held = sorted(bytes(r["ids"]) for r in rows[1:])
    assert held == sorted(
        np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes() for t in texts
    )
