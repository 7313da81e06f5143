"""Words of a lexicon, suffix arrays, and benchmark passages in documents."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationflow.llm import decontamination as D
from stationflow.llm.lexicon import Lexicon, Words, item_blocks, stretches
from stationflow.llm.text import lower_az

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "item_id bigint, text string"


def words(text):
    return WORD.findall(lower_az(text or ""))


def brute(docs, items, window=10):
    """Per document: words, hit places, names of items."""
    wanted = []
    for name, text in items:
        own = words(text)
        need = min(window, len(own))
        if need:
            wanted += [(name, tuple(own[i : i + need])) for i in range(len(own) - need + 1)]
    out = []
    for text in docs:
        own, hit, names = words(text), set(), set()
        for name, win in wanted:
            for i in range(len(own) - len(win) + 1):
                if tuple(own[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    names.add("" if name is None else str(name))
        out.append((len(own), sorted(hit), sorted(names)))
    return out


def test_words_are_those_of_the_pattern():
    texts = ["A-b c_d9", None, "", "Ünï·x\x7fY", "日本 \U0001f600z", "end", "x" * 70_000 + " y" * 300_000]
    found = Words(pa.array(["skipped"] + texts).slice(1))
    per_text = [[found.word(i).decode() for i in range(a, b)] for a, b in zip(found.starts, found.starts[1:])]
    assert per_text == [words(t) for t in texts]
    hashes = found.hashes()
    flat = [w for t in per_text for w in t]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))
    lexicon = Lexicon(pa.array(["B y", "none"]))
    codes = lexicon.look_up(found)
    assert {flat[i] for i in np.flatnonzero(codes)} == {"b", "y"}
    assert len(Words(pa.array([], pa.string()))) == 0


def test_stretches_hold_whole_rows():
    texts = pa.array(["a" * 10, None, "b" * 50, "c", "d"])
    assert list(stretches(texts, 12)) == [(0, 2), (2, 3), (3, 5)]
    assert list(stretches(pa.array([], pa.string()), 5)) == []


def test_suffixes_are_sorted_and_found():
    rng = random.Random(1)
    codes = np.array([rng.choice([0, 1, 1, 2, 3]) for _ in range(400)], np.int32)
    array = D.SuffixArray(codes, 40)
    text = codes.tolist()
    ends = [text.index(0, i) if 0 in text[i:] else len(text) for i in range(len(text))]
    listed = [tuple(text[i : ends[i]]) for i in array.order.tolist()]
    assert [x[:40] for x in listed] == sorted(x[:40] for x in listed)
    tests = np.array([1, 1, 2, 3, 1, 1, 1, 2, 9, 0])
    at, room = np.arange(9), 9 - np.arange(9)
    low, high, length, example = array.search(tests, at, np.minimum(2, room), room)
    for i in range(9):
        longest = max(n for n in range(10 - i) if n == 0 or tuple(tests[i : i + n]) in
                      {tuple(s[:n]) for s in listed})
        assert length[i] == longest
        need = min(2, 9 - i)
        places = [p for p in range(400) if text[p : p + need] == tests[i : i + need].tolist()]
        assert sorted(array.order[low[i] : high[i]].tolist()) == places
        if longest:
            assert text[example[i] : example[i] + longest] == tests[i : i + longest].tolist()


def fixture(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "Dé", "9", "f"]
    text = lambda n: rng.choice([" ", "-", "\n"]).join(rng.choices(vocabulary, k=n))
    items = [(i, text(rng.choice([1 if seed == 2 else 11, 12, 15, 25]))) for i in range(6)]
    items += [(7, ""), (8, None), (None, text(14)), (10, items[0][1])]
    docs = [text(rng.randint(0, 60)) for _ in range(30)]
    docs += [f"{text(5)} {items[rng.randrange(6)][1]} {text(9)}" for _ in range(20)]
    docs += [None, "", items[1][1].upper(), items[0][1] + " " + items[2][1] + " " + items[0][1]]
    return docs, items


@pytest.mark.parametrize("seed, block_bytes", [(1, 1 << 20), (2, 1 << 20), (3, 200)])
def test_contamination_by_brute_force(spark, seed, block_bytes):
    docs, items = fixture(seed)
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    bench = spark.createDataFrame(items, ITEM)
    if block_bytes == 200:
        assert len(list(item_blocks(bench, "item_id", "text", block_bytes))) > 2
    found = {r.doc_id: r for r in D.contamination(frame, bench, block_bytes=block_bytes).collect()}
    for i, (n, hit, names) in enumerate(brute(docs, items)):
        places = [p for s in found[i].spans for p in range(s["first"], s["first"] + s["words"])]
        assert (found[i].n_words, places, sorted(found[i]["items"])) == (n, hit, names)


def test_clean_documents_stay_with_all_columns(spark):
    docs, items = fixture(1)
    rows = [(i % 7 or None, t, 1, 2, 3, 4) for i, t in enumerate(docs)]
    frame = spark.createDataFrame(rows, "doc_id int, text string, row int, items int, n_words int, ends int")
    kept = D.remove_contaminated(frame, spark.createDataFrame(items, ITEM))
    assert kept.columns == frame.columns
    clean = [r for r, (_, hit, _) in zip(rows, brute(docs, items)) if not hit]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)


def test_longest_matches(spark):
    docs = ["x y z " + " ".join(f"w{i}" for i in range(5, 30)) + " q", "w3 w4 w5", None]
    items = [(1, " ".join(f"w{i}" for i in range(40))), (2, "w8 w9")]
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    found = D.longest_matches(frame, spark.createDataFrame(items, ITEM)).collect()
    best = {(r.item_id, r.place): (r.words, r.doc, r.start) for r in found}
    assert best == {(1, p): (30 - p, 0, 3 + p - 5) for p in range(5, 21)} | {(2, 0): (2, 0, 6)}


def test_no_rows(spark, no_docs, docs):
    bench = spark.createDataFrame([(1, "a b")], ITEM)
    assert D.contamination(no_docs, bench).count() == 0
    none = D.contamination(docs, bench.where("false"))
    assert none.where(F.size("items") > 0).count() == 0 and none.count() == docs.count()
    assert D.remove_contaminated(docs, bench.where("false")).count() == docs.count()


def test_query_equals_sql_on_given_tables(spark):
    duckdb = pytest.importorskip("duckdb")
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    ours = D.decontamination_query(spark, folder)
    theirs = con.execute(D.DECONTAMINATION_SQL).fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)
    assert any(r[5] for r in theirs) and ours.columns == [c[0] for c in con.description]
