"""Ranked search against scores of all pairs, and the trie's bounds."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stationflow.llm import ranked_search as R
from stationflow.llm.lexicon import Lexicon
from stationflow.llm.text import lower_az

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEM = "item_id bigint, text string"


def terms(text):
    return TERM.findall(lower_az(text or ""))


def brute(docs, items):
    """Every item's best documents, from the formula."""
    bags = [(key, Counter(terms(text))) for key, text in docs]
    bags = [(key, bag) for key, bag in bags if bag]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, bag in bags for t in bag)
    out = set()
    for item, text in items:
        scored = []
        for key, bag in bags:
            m = 100 - 90 + (90 * sum(bag.values()) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in set(terms(text)) if bag[t]
            )
            if score > 0:
                scored.append((-score, key is None, key or 0))
        for rank, (score, none, key) in enumerate(sorted(scored)[:10], 1):
            out.add((item, rank, None if none else key, -score))
    return out


def corpus_of(seed, n=300):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(40)] + ["Été", "日本", "the", "THE"]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([3, 20, 60])))) for i in range(n)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(30)]  # copies: ties by id
    docs += [(2000 + i, docs[4][1] + f" own{i}") for i in range(30)]
    docs += [(None, docs[0][1]), (3000, None), (3001, ""), (3002, "-- !"), (5, docs[5][1])]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 4, 12])))) for i in range(12)]
    items += [(20, None), (21, "unseen"), (22, "own3"), (23, "the THE t1")]
    return docs, items


@pytest.mark.parametrize("seed, block_bytes, leaf", [(1, 1 << 20, 32), (2, 1 << 20, 2), (3, 300, 4)])
def test_ranks_by_brute_force(spark, monkeypatch, seed, block_bytes, leaf):
    docs, items = corpus_of(seed)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    found = R.ranked_search(frame, spark.createDataFrame(items, ITEM), block_bytes=block_bytes)
    assert set(map(tuple, found.collect())) == brute(docs, items)


@pytest.mark.parametrize("leaf", [1, 3, 32])
def test_bounds_hold_and_prune(monkeypatch, leaf):
    monkeypatch.setattr(R, "LEAF_VECTORS", leaf)
    docs, items = corpus_of(9)
    docs = [(k, t) for k, t in docs if terms(t) and k is not None]
    lexicon = Lexicon(pa.array([t for _, t in items], pa.large_string()))
    number = {s.decode(): i + 1 for i, s in enumerate(lexicon.strings)}
    bags = [Counter(terms(t)) for _, t in docs]
    vectors = [sorted((number[t], c) for t, c in bag.items() if t in number) for bag in bags]
    df = Counter(t for v in vectors for t, _ in v)
    queries = R.Queries(lexicon, df, len(docs), sum(sum(b.values()) for b in bags))
    trie = R.Trie(
        [k for k, _ in docs], np.array([sum(b.values()) for b in bags]),
        np.array([len(v) for v in vectors]), np.array([t for v in vectors for t, _ in v]),
        np.array([c for v in vectors for _, c in v]), queries,
    )
    # leaves hold every vector once, parents what their children hold
    leaves = [(a, b) for a, b, inner in zip(trie.first, trie.last, trie.inner) if not inner]
    assert sorted(i for a, b in leaves for i in range(a, b)) == list(range(len(trie.paths)))
    for node, inner in enumerate(trie.inner):
        if inner:
            assert sorted((trie.first[c], trie.last[c]) for c in inner)[0][0] == trie.first[node]
            assert (trie.most[:, node] == trie.most[:, inner].max(axis=1)).all()
            assert trie.least[node] == trie.least[inner].min()
    visited = []
    score = R.Trie._score
    monkeypatch.setattr(R.Trie, "_score", lambda s, node, *a: visited.append(node) or score(s, node, *a))
    expected = brute(docs, items)
    for (item, _), wanted in zip(items, queries.terms):
        best = trie.search(wanted, queries, [])
        got = {(item, rank, key, -neg) for rank, (neg, key) in enumerate(best, 1)}
        assert got == {row for row in expected if row[0] == item}
    if leaf == 1:
        assert len(visited) < len(items) * len(leaves) / 2


def test_shards_hold_all_rows(monkeypatch):
    monkeypatch.setattr(R, "SHARD_TERMS", 7)
    monkeypatch.setattr(R, "SHARD_DOCUMENTS", 3)
    rows = [[1] * k for k in (0, 3, 9, 2, 2, 2, 0, 0, 0, 0, 20)]
    batch = pa.record_batch(
        [pa.array(range(len(rows))), pa.array(rows, pa.list_(pa.int32()))], names=["id", "terms"]
    )
    shards = [[i for b in held for i in b.column("id").to_pylist()] for held in R._shards(iter([batch, batch]))]
    assert [i for s in shards for i in s] == 2 * list(range(len(rows)))
    assert all(len(s) <= 3 and (len(s) == 1 or sum(len(rows[i]) for i in s) <= 7) for s in shards)


def test_no_rows_and_other_types(spark, no_docs):
    bench = spark.createDataFrame([(1, "a b")], ITEM)
    assert R.ranked_search(no_docs, bench).count() == 0
    some = spark.createDataFrame([("x", "a", 1, 2), ("w", "a", 3, 4), ("v", "c", 3, 4)],
                                 "doc_id string, text string, id int, score int")
    assert R.ranked_search(some, bench.where("false")).count() == 0
    found = R.ranked_search(some, bench).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in found] == [(1, "w"), (2, "x")]


def test_query_equals_sql_on_given_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    ours = R.ranked_search_query(spark, folder)
    theirs = con.execute(R.RANKED_SEARCH_SQL).fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs) and len(theirs) > 50
    assert ours.columns == [c[0] for c in con.description]
