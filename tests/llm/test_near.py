"""Fingerprints, near duplicates, shingles and components."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationflow.llm import fingerprints as P
from stationflow.llm import near_duplicates as N
from stationflow.llm.components import components
from stationflow.llm.shingles import shingle_sets
from stationflow.llm.text import WORDS, lower_az


def shingles(text):
    words = WORDS.findall(lower_az(text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def groups(texts, percent):
    """Smallest place that links reach, by brute force."""
    sets = [shingles(t) for t in texts]
    home = list(range(len(texts)))
    changed = True
    links = [
        (i, j) for i in range(len(texts)) for j in range(i)
        if sets[i] and sets[j]
        and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
    ]
    while changed:
        changed = False
        for i, j in links:
            low = min(home[i], home[j])
            changed |= home[i] != low or home[j] != low
            home[i] = home[j] = low
    return home


def test_shingle_sets_have_the_right_sizes(corpus):
    texts = [t for _, t, *_ in corpus] + ["A b\x0bc D e f", "a B c d E F", "Ünï A", "a\x85b c"]
    sets = shingle_sets(pa.array(texts, pa.string()))
    assert [len(s) for s in sets] == [len(shingles(t)) for t in texts]
    assert np.array_equal(sets[-4], sets[-3]) and shingle_sets(pa.array([], pa.string())) == []


def family(seed, n):
    """Near copies of one text, each with its own few changed words, some linked only by others."""
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(120)]
    texts = []
    for _ in range(n):
        words = list(base if not texts or rng.random() < 0.5 else rng.choice(texts).split())
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = f"n{rng.randint(0, 10**6)}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("percent", [80, 85])
def test_near_duplicates_against_brute_force(spark, monkeypatch, percent):
    # small pieces, so that regions of this family are cut and both passes have work
    monkeypatch.setattr(N, "PIECE", 24)
    texts = [t for seed, n in ((1, 90), (2, 30), (3, 3)) for t in family(seed, n)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = sorted(N.near_duplicates(docs, percent=percent).collect())
    assert [r["component_id"] for r in rows] == groups(texts, percent)
    assert [r["n_shingles"] for r in rows] == [len(shingles(t)) for t in texts]


def test_links_across_the_cuts_of_a_large_region(spark, monkeypatch):
    """Twins in one region of more classes than a piece holds, alike in pairs only."""
    monkeypatch.setattr(N, "TREES", 1)
    monkeypatch.setattr(N, "PREFIX", 1)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for at in range(450):
        words = list(base)
        for place in rng.sample(range(5, 115), 3):
            words[place] = f"n{at}x{place}"
        texts.append(" ".join(words))
        words[rng.randrange(5, 115)] = f"t{at}"
        texts.append(" ".join(words))
    least = [N._minima(s, *N._functions())[0] for s in shingle_sets(pa.array(texts))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    home = {r["doc_id"]: r["component_id"] for r in N.near_duplicates(docs, percent=85).collect()}
    same_region = [i for i in range(0, len(texts), 2) if least[i] == least[i + 1]]
    alike = [i for i in same_region if groups(texts[i : i + 2], 85) == [0, 0]]
    apart = [i for i in alike if home[i] != home[i + 1]]
    assert max(least.count(v) for v in set(least)) > N.PIECE and len(alike) > 300
    assert not apart, f"{len(apart)} of {len(alike)} twins are apart"


def test_a_family_below_the_limit_makes_few_rows(spark, monkeypatch):
    """All pairs resemble each other at 78 %: each is compared, but none becomes a row."""
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base[:60] + [f"n{at}x{i}" for i in range(10)] + base[70:]) for at in range(200)]
    texts += [f"{t} more" for t in texts[:5]]
    made = []

    def settle(frame, *folder):
        stored = plain(frame, *folder)
        if stored.columns == ["u", "v"]:
            made.append(stored.count())
        return stored

    plain = N.settle
    monkeypatch.setattr(N, "settle", settle)
    monkeypatch.setattr(N, "PIECE", 24)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted(N.near_duplicates(docs, percent=80).collect())
    assert [r["component_id"] for r in found] == groups(texts, 80)
    assert max(made) <= 2 * N.TREES * len(texts) and max(made[1:]) <= len(texts)


def test_near_duplicates_of_awkward_rows(odd_docs, corpus, no_docs):
    found = N.near_duplicates(odd_docs)
    rows = {(r["doc_id"], r["n_shingles"]): r for r in found.collect()}
    assert found.count() == len(corpus)
    assert rows[(100, rows_of(corpus, 100))]["component_id"] == 5
    assert rows[(101, rows_of(corpus, 101))]["component_id"] == 7
    assert rows[(106, 1)]["component_id"] == 105 and rows[(105, 1)]["kept"]
    assert all(rows[(i, 0)]["component_id"] == i and rows[(i, 0)]["kept"] for i in (102, 103, 104))
    assert rows[(None, 1)]["component_id"] is None and rows[(None, 1)]["kept"]
    kept = N.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {r["doc_id"] for r in kept.collect()}.isdisjoint({100, 101, 106})
    assert N.near_duplicates(no_docs).count() == 0 and N.keep_one_of_each(no_docs).count() == 0


def rows_of(corpus, key):
    return next(len(shingles(t)) for i, t, *_ in corpus if i == key)


def test_pieces_cover_neighbours_of_a_region():
    deep = np.sort(np.random.default_rng(0).integers(0, 3, (4000, 4)).astype(np.uint8), axis=0)
    order = np.lexsort(deep.T[::-1])
    pieces = N._pieces(deep[order], 0, 4000)
    assert all(high - low <= N.PIECE for low, high in pieces)
    same = N._pieces(np.zeros((5000, 4), np.uint8), 0, 5000)
    assert same[0][0] == 0 and same[-1][1] == 5000
    assert all(b[0] < a[1] for a, b in zip(same, same[1:]))


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)]
    links += [(i, i + 1) for i in range(100, 160)] + [(200, 200), (300, 301), (300, 301)]
    found = dict(components(spark.createDataFrame(links, "u int, v int")).collect())
    home = {n: n for pair in links for n in pair}
    for _ in range(len(home)):
        for a, b in links:
            home[a] = home[b] = min(home[a], home[b])
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert found == {n: home[n] for n in linked}


def test_no_links(spark):
    assert components(spark.createDataFrame([], "u int, v int")).count() == 0


def simhash(text):
    words = WORDS.findall(text)
    votes = [0] * P.BITS
    for one, two in zip(words, [*words[1:], None]):
        term = one if two is None else f"{one} {two}"
        value = int(hashlib.md5(term.encode()).hexdigest()[: P.DIGITS], 16)
        weight = min(3, 1 + len(term) // 6)
        for bit in range(P.BITS):
            votes[bit] += weight if value >> bit & 1 else -weight
    return sum(1 << bit for bit in range(P.BITS) if votes[bit] > 0)


def test_fingerprints_against_brute_force(odd_docs, corpus, no_docs):
    rows = P.fingerprint_edits(odd_docs).collect()
    order = sorted(corpus, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    wanted = []
    for at, (key, text, *_) in enumerate(order):
        text, following = text or "", order[(at + 1) % len(order)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        own, changed, after = simhash(text), simhash(edited), simhash(following)
        wanted.append((
            str(key), len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{own:015x}",
            f"{changed:015x}", round(1 - (own ^ changed).bit_count() / P.BITS, 9),
            round(1 - (own ^ after).bit_count() / P.BITS, 9),
        ))
    found = [(str(r[0]), *r[1:5], round(r[5], 9), round(r[6], 9)) for r in rows]
    assert sorted(found) == sorted(wanted)
    assert P.fingerprint_edits(no_docs).count() == 0


def test_neighbours_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET_ROWS", 3)
    keys = random.Random(1).sample(range(-10**12, 10**12), 200)
    docs = spark.createDataFrame([(k, f"text of {k}") for k in keys], "doc_id bigint, text string")
    rows = P.with_next(docs, "doc_id", "text").where("not ghost").collect()
    order = sorted(keys)
    following = dict(zip(order, order[1:] + order[:1]))
    assert {r["id"]: r["next_text"] for r in rows} == {k: f"text of {n}" for k, n in following.items()}


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_near_fingerprints_against_brute_force(spark, radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(P.BITS) for _ in range(30)]
    for value in values[:30]:
        changed = value
        for bit in rng.sample(range(P.BITS), rng.randint(0, 5)):
            changed ^= 1 << bit
        values.append(changed)
    frame = spark.createDataFrame([(f"{v:015x}",) for v in values * 2], "fingerprint string")
    found = P.near_fingerprints(frame, frame, radius).collect()
    wanted = {(f"{a:015x}", f"{b:015x}", (a ^ b).bit_count()) for a in values for b in values
              if (a ^ b).bit_count() <= radius}
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_documents_within(spark):
    docs = spark.createDataFrame(
        [(0, "00000000000000f"), (1, "00000000000000f"), (50, "000000000000000"),
         (51, "000000000000007"), (None, "00000000000000f")],
        "doc_id bigint, fingerprint string",
    )
    rows = {r["doc_id"]: r["n_within"] for r in P.documents_within(docs, "doc_id").collect()}
    assert rows == {0: 3, 1: None, 50: 1, 51: None, None: None}
