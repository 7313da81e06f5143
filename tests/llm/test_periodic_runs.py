"""Runs of words against their definition."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest

from stationflow.llm import periodic_runs as P

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def has_period(words, q):
    return all(words[i] == words[i + q] for i in range(len(words) - q))


def brute(words, exponent=4, least=6):
    """All runs, period by period."""
    runs = []
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(least, exponent * q) and not any(has_period(part, s) for s in range(1, q)):
                runs.append((start, length, q))
    return sorted(runs, key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def texts_of(seed, n=120):
    rng = random.Random(seed)
    out = [None, "", " \n", "a", "a " * 5, "a " * 6, "a b " * 3 + "a", "a b " * 4, "é 日 " * 9]
    out.append("a a a a a a b b b b b b " * 6)  # runs inside a run
    for _ in range(n):
        words = []
        while len(words) < rng.randint(1, 150):
            part = rng.choices("ab" if rng.random() < 0.5 else "abcdef", k=rng.randint(1, 6))
            words += part * rng.choice([1, 1, 2, 4, 5, 9])
        out.append(rng.choice([" ", "\t", "\n "]).join(words))
    out += out[-3:]
    return out


def found(texts, **limits):
    codes, starts, _ = P.coded_words(pa.array(texts, pa.string()))
    at, length, period = P.find_runs(codes, starts, **limits)
    text = np.searchsorted(starts, at, "right") - 1
    out = [[] for _ in texts]
    for t, *run in zip(text.tolist(), (at - starts[text]).tolist(), length.tolist(), period.tolist()):
        out[t].append(tuple(run))
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("exponent, words", [(4, 6), (2, 2), (3, 20)])
def test_runs_by_brute_force(seed, exponent, words):
    texts = texts_of(seed)
    expected = [brute(WORD.findall(t or ""), exponent, words) for t in texts]
    assert found(texts, exponent=exponent, words=words) == expected
    assert sum(map(len, expected)) > 20


def test_neighbours_share_what_is_said():
    text = " ".join(random.Random(4).choices("ab", k=300))
    codes, starts, _ = P.coded_words(pa.array([text, text], pa.string()))
    for a, b, n in zip(*(x.tolist() for x in P._neighbours(codes, starts, 5))):
        assert (a < 300) == (b < 300)
        end = 300 if a < 300 else 600
        common = next((k for k in range(end) if max(a, b) + k == end or codes[a + k] != codes[b + k]), 0)
        assert common == n >= 5


def test_ordered_sets_unite():
    rng = random.Random(2)
    for _ in range(300):
        both = rng.sample(range(60), rng.randint(2, 40))
        cut = rng.randint(1, len(both) - 1)
        one, two = sorted(both[:cut]), sorted(both[cut:])
        if len(one) < len(two):
            one, two = two, one
        expected = [(u, v) for u, v in zip(sorted(both), sorted(both)[1:]) if (u in two) != (v in two)]
        united, pairs = P._united(list(one), list(two))
        assert united == sorted(both) and sorted(pairs) == expected


def test_long_texts_in_time():
    began = time.monotonic()
    texts = ["word " * 200_000, "a b c " * 50_000 + "d", " ".join(map(str, range(200_000)))]
    assert found(texts) == [[(0, 200_000, 1)], [(0, 150_000, 3)], []]
    assert time.monotonic() - began < 60


def test_documents_and_their_columns(spark):
    texts = texts_of(11)
    rows = [(i % 50 or None, t, 1, 2, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, runs int, n_words int, collapsed string")
    got = sorted((str(r.doc_id), r.n_words, str([tuple(x) for x in r.runs]), r.collapsed)
                 for r in P.periodic_runs(docs.repartition(3)).collect())
    want = []
    for key, text, *_ in rows:
        words = WORD.findall(text or "")
        want.append((str(key), len(words), str(brute(words)), collapsed(words, brute(words))))
    assert got == sorted(want)
    kept = P.collapse_runs(docs)
    assert kept.columns == docs.columns
    cut = [(k, collapsed(WORD.findall(t or ""), brute(WORD.findall(t or ""))) if brute(WORD.findall(t or "")) else t, *r)
           for k, t, *r in rows]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(cut, key=str)


def test_no_rows(no_docs):
    assert P.periodic_runs(no_docs).count() == 0 and P.collapse_runs(no_docs).count() == 0


def test_query_by_brute_force(spark, tmp_path):
    texts = [t for s in range(3) for t in texts_of(s, 60)]
    rows = [(i * 7919, t) for i, t in enumerate(texts)] + [(5, "x y " * 30), (5, "x y " * 30)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, P.periodic_runs_query(spark, str(tmp_path)).collect()))
    want = []
    for key, text in rows:
        words = WORD.findall(text or "")
        h, n = zlib.crc32(str(key).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else w for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want.append((
            key, len(runs), *(best or (None, None, None)), best and 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(collapsed(words, runs).encode()).hexdigest(),
        ))
    assert got == sorted(want, key=lambda r: (r[0], str(r)))


def test_looped_tails_leave_others_as_they_are(spark, docs):
    before = docs.select("doc_id", "text").collect()
    after = P.looped_tails(docs).collect()
    assert [r.doc_id for r in after] == [r.doc_id for r in before]
    for old, new in zip(before, after):
        if old.doc_id is None or zlib.crc32(str(old.doc_id).encode()) % 10:
            assert old.text == new.text
        else:
            assert len(WORD.findall(new.text or "")) == len(WORD.findall(old.text or ""))
