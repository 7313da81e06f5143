"""Quality rules, language identification and toxicity."""

import itertools
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from stationflow.llm import language as L
from stationflow.llm import quality as Q
from stationflow.llm import toxicity as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + d for i, w in enumerate(zip(words, words[1:], words[2:]))
               if windows[w] > 1 for d in range(3)}
    lines = [line for line in (text or "").split("\n") if WORD.search(line)]
    again = sum(line in lines[:i] for i, line in enumerate(lines))
    symbols = sum((text or "").count(c) for c in "#*$%&|<>")
    return [len(words), sum(map(len, words)), symbols, again, len(covered)]


def test_counts_against_brute_force(corpus):
    texts = [t for _, t, *_ in corpus] + ["a b c a b c", "x\n\nx\n x\nx", "a\x85b a\x1cb\xa0c", "#|<"]
    for text in texts:
        counts = Q.measure(text)[0]
        wanted = brute_counts(text)
        if counts[0] == 0:
            wanted[2] = counts[2] = 0
        assert counts == wanted, text


def test_viterbi_against_all_labellings():
    rng = np.random.default_rng(4)
    field = Q.Field(rng.normal(size=(len(Q.FEATURES), 2)), rng.normal(size=(2, 2)))
    texts = [rng.random((n, len(Q.FEATURES))) < 0.4 for n in (0, 1, 2, 7, 3, 7, 1)]

    def score(lines, labels):
        own = sum((line @ field.emission)[y] for line, y in zip(lines, labels))
        return own + sum(field.transition[a, b] for a, b in zip(labels, labels[1:]))

    for lines, found in zip(texts, Q.viterbi(field, texts)):
        best = max(itertools.product((0, 1), repeat=len(lines)), key=lambda y: score(lines, y))
        assert np.isclose(score(lines, found.tolist()), score(lines, best))


def test_field_learns_and_gradient_is_exact_enough():
    rng = np.random.default_rng(5)
    texts, labels = [], []
    for i in range(60):
        bad = i % 2
        lines = rng.random((4, len(Q.FEATURES))) < 0.1
        lines[:, 0], lines[:, 4] = True, bool(bad)
        texts.append(lines)
        labels.append(bad)
    field = Q.fit_field(texts, labels)
    assert all((y == want).all() for y, want in zip(Q.viterbi(field, texts), labels))
    assert not Q.fit_field(texts, [1] * 60).emission.any()


def test_quality_of_documents(odd_docs, labels, no_docs, corpus):
    judged = Q.judge_quality(odd_docs.drop("quality"), Q.train_field(odd_docs, labels))
    rows = {(r["doc_id"], r["text"]): r["quality"] for r in judged.collect()}
    assert len(rows) == len({(i, t) for i, t, *_ in corpus})
    for (_, text), verdict in rows.items():
        counts = brute_counts(text)
        assert verdict["base_failed"] == (counts[0] < 50 or 2 * counts[4] > counts[0])
        assert not (verdict["base_failed"] and verdict["kept"])
    assert rows[(20, corpus[20][1])]["kept"] and not rows[(110, corpus[-2][1])]["kept"]
    kept = Q.keep_quality(odd_docs, labels)
    assert kept.columns == odd_docs.columns and 0 < kept.count() < odd_docs.count()
    assert Q.keep_quality(no_docs, labels).count() == 0
    nothing_known = Q.train_field(odd_docs, labels.where("false"))
    assert not nothing_known.emission.any()


def bundle(text, width=64):
    """The bundled vector, letter by letter."""
    def letter(symbol):
        return 2 * np.random.default_rng([L.SEED, symbol]).integers(0, 2, width) - 1

    symbols = [0]
    for mark in text:
        symbol = ord(mark.lower()[0]) if mark.isalpha() else 0
        if symbol or symbols[-1]:
            symbols.append(symbol)
    symbols = symbols if symbols[-1] == 0 else [*symbols, 0]
    found = {}
    for a, b, c in zip(symbols, symbols[1:], symbols[2:]):
        bound = np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c)
        found.setdefault((a, b, c), []).append(bound)
    return sum(round(8 * len(v) ** 0.5) * v[0] for v in found.values())


TONGUES = ["Hello, wörld 12 ok", "a", "été... été", "日本 x 日本語", "Привет, мир", "straße û"]


def test_language_vectors_against_letter_by_letter(spark):
    for text in TONGUES:
        assert np.array_equal(L.text_vector(text, 64), bundle(text))
    assert all(L.trigrams(t) is None for t in (None, "", " 12 !"))
    # each letter of any script has a vector of its own
    vectors = L.letter_vectors(np.arange(0x400, 0x4FF))
    assert len({v.tobytes() for v in vectors}) == len(vectors)
    rows = [("xx", t) for t in TONGUES] + [("yy", TONGUES[0]), ("yy", None), (None, "a")]
    learnt = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    found = {r["lang"]: np.frombuffer(bytes(r["prototype"]))
             for r in L.learn_prototypes(learnt, 64).collect()}
    assert np.array_equal(found["xx"], sum(map(bundle, TONGUES)))
    assert np.array_equal(found["yy"], bundle(TONGUES[0])) and set(found) == {"xx", "yy"}


def test_bundles_do_not_depend_on_what_is_held(monkeypatch):
    monkeypatch.setattr(L, "HELD", 5)
    held = L._Bundle(64, L.SEED)
    for text in TONGUES:
        seen, times = np.unique(L.trigrams(text), return_counts=True)
        held.add(seen, L.weights_of(times))
    assert np.array_equal(held.total(), sum(map(bundle, TONGUES)))


def test_languages(odd_docs, no_docs):
    odd_docs = odd_docs.drop("lang_pred", "score")
    learn = odd_docs.where("doc_id % 3 != 1 or doc_id is null")
    found = L.predict_languages(odd_docs, L.learn_prototypes(learn))
    rows = found.where("doc_id < 60").select("lang", "lang_pred", "score").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 for r in found.collect())
    none = {r["doc_id"]: r["lang_pred"] for r in found.where("doc_id between 102 and 104").collect()}
    assert set(none.values()) == {"und"}
    untaught = L.predict_languages(odd_docs, L.learn_prototypes(no_docs))
    assert {r["lang_pred"] for r in untaught.collect()} == {"und"}
    assert L.keep_known_languages(no_docs).count() == 0
    kept = L.keep_known_languages(odd_docs)
    assert kept.columns == odd_docs.columns
    assert {102, 103, 104}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_unlearnt_languages_go_and_clean_documents_stay(docs):
    spark, rng = docs.sparkSession, random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    noise = [" ".join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(n))
             for n in (20, 60, 300)]
    other = [
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni "
        "obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on "
        "annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    ]
    odd = [(1000 + i, text, None, "src0", 0) for i, text in enumerate([*noise, *other])]
    kept = L.keep_known_languages(docs.unionByName(spark.createDataFrame(odd, docs.schema)))
    ids = {r["doc_id"] for r in kept.collect()}
    assert set(range(60)) <= ids and not {i for i in ids if i is not None and i >= 1000}


def test_toxicity(spark, odd_docs, no_docs, labels):
    bad = odd_docs.where("doc_id < 60").withColumn(
        "text", F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit(" You vermin! rotter vermin.")))
        .otherwise(F.col("text")),
    )
    marks = spark.createDataFrame(
        [(i, int(i % 5 == 0)) for i in range(50)] + [(51, None), (52, 7)], "doc_id bigint, toxic int"
    )
    chain = T.train_chain(bad, marks)
    assert "vermin" in chain.words and chain.marked[chain.words["vermin"]]
    rows = {r["doc_id"]: r for r in T.predict_toxicity(bad, chain).collect()}
    assert {i for i, r in rows.items() if r["toxic"]} == set(range(0, 60, 5))
    assert all(r["repeated"] <= r["toxic"] and r["severe"] <= r["toxic"] for r in rows.values())
    assert T.predict_toxicity(odd_docs, chain).count() == odd_docs.count()
    assert T.predict_toxicity(no_docs, chain).count() == 0
    untrained = T.train_chain(bad, marks.where("toxic = 0"))
    assert not any(r["toxic"] for r in T.predict_toxicity(odd_docs, untrained).collect())


def test_words_of_the_chain_are_counted_in_whole_texts():
    import pyarrow as pa

    texts = ["Bad, bad-worse\nBAD", None, "", "x " * 4000 + "worse"]
    counts, sizes = T.word_counts(pa.array(texts, pa.string()), {"bad": 0, "worse": 1})
    assert counts.tolist() == [[3, 1], [0, 0], [0, 0], [0, 1]]
    assert sizes.tolist() == [3, 0, 0, 4001]


def loss(weight, inputs, truth):
    """What the links minimise: both kinds weigh the same, the bias goes free."""
    share = truth.mean()
    balance = np.where(truth > 0, 0.5 / share, 0.5 / (1 - share)) / len(truth)
    x = inputs @ weight
    own = balance @ (np.logaddexp(0, x) - truth * x)
    return own + 0.5e-3 * (weight[:-1] ** 2).sum()


def test_links_reach_the_least_loss():
    rng = np.random.default_rng(2)
    inputs = np.hstack([rng.normal(size=(200, 3)), np.ones((200, 1))])
    truth = (inputs @ [1.5, -2, 0, 0.5] + rng.normal(size=200) > 0).astype(float)
    found = T._fit(inputs, truth, rounds=3000)
    for axis in range(4):
        for step in (-0.05, 0.05):
            moved = found.copy()
            moved[axis] += step
            assert loss(found, inputs, truth) < loss(moved, inputs, truth)


def test_chain_against_plain_folds():
    """Every out-of-fold probability from a model that is built without that fold's rows."""
    rng = np.random.default_rng(7)
    words = ["bad", "worse", "mild", "other", "plain"]
    toxic = rng.integers(0, 2, 80)
    counts = rng.poisson(np.where(toxic[:, None] > 0, [1, 1, 0.5, 1, 1], [0.1, 0, 0.4, 1, 1]))
    sizes, folds = rng.integers(20, 60, 80).astype(float), rng.integers(0, T.FOLDS, 80)
    everything = T.Pick(np.array([0, 1, 3]), np.array([True, True, False]))
    without = [T.Pick(np.array(p), np.array(m)) for p, m in (
        ([0, 1, 3], [True, True, False]), ([0, 2], [True, False]), ([1, 4], [True, False]),
        ([], []), ([0, 1, 2], [True, True, False]))]
    without[3] = T.Pick(np.zeros(0, int), np.zeros(0, bool))

    def plain_truth(pick, known):
        marked = [p for p, m in zip(pick.places, pick.marked) if m]
        share = [sum(c[p] for p in marked) / s for c, s in zip(counts, sizes)]
        typical = np.median([s for s, t, k in zip(share, toxic, known) if t and k])
        return np.array([
            (t, t and s >= typical and s > 0, t and max((c[p] for p in marked), default=0) >= 2)
            for c, s, t in zip(counts, share, toxic)
        ], float)

    outside = np.zeros((80, 3))
    for link in range(3):
        for fold, pick in enumerate(without):
            known = folds != fold
            inputs = T.chain_inputs(counts[:, pick.places].astype(float), sizes, pick.marked)
            linked = np.hstack([inputs, outside[:, :link], np.ones((80, 1))])
            model = T._fit(linked[known], plain_truth(pick, known)[known, link])
            outside[~known, link] = 1 / (1 + np.exp(-linked[~known] @ model))
    chain = T.fit_chain(words, [everything, *without], counts, sizes, toxic, folds)
    assert list(chain.words) == ["bad", "worse", "other"]
    inputs = T.chain_inputs(counts[:, everything.places].astype(float), sizes, everything.marked)
    truth = plain_truth(everything, folds >= 0)
    for link in range(3):
        linked = np.hstack([inputs, outside[:, :link], np.ones((80, 1))])
        assert np.allclose(chain.weights[link], T._fit(linked, truth[:, link]))


def test_words_are_chosen_without_the_fold(spark):
    rows = [(i, int(i % 2), "vermin here" if i % 2 else "fine here", i % T.FOLDS) for i in range(400)]
    # a word of one fold only: all texts and the other picks see it, that fold's pick does not
    rows = [(i, t, f"{x} secret" if t and f == 2 else x, f) for i, t, x, f in rows]
    frame = spark.createDataFrame(rows, "doc_id int, toxic int, text string, fold int")
    sizes = {(k, f): 40 for k in (0, 1) for f in range(T.FOLDS)}
    found = {}
    for r in T.chosen_words(frame, sizes).collect():
        found.setdefault(r["pick"], {})[r["word"]] = r["marked"]
    assert all(words["vermin"] and not words["fine"] for words in found.values())
    assert "secret" in found[0] and "secret" not in found[3] and "here" not in found[0]
    same = frame.select(T.fold_of(F.lit("same text")).alias("f")).distinct().collect()
    assert len(same) == 1 and 0 <= same[0]["f"] < T.FOLDS


def test_one_id_with_many_rows(spark, odd_docs, labels):
    """A labelled id that many rows share gives the fits one row."""
    many = odd_docs.where("doc_id = 3").select(
        "doc_id", "text", F.explode(F.sequence(F.lit(1), F.lit(300)))
    ).drop("col")
    docs = odd_docs.select("doc_id", "text").unionByName(many)
    once = Q.train_field(odd_docs.select("doc_id", "text"), labels)
    again = Q.train_field(docs, labels)
    assert np.allclose(once.emission, again.emission) and np.allclose(once.transition, again.transition)


def test_all_lines_of_a_long_text_count():
    rng = np.random.default_rng(6)

    def lines(n, feature):
        made = rng.random((n, len(Q.FEATURES))) < 0.1
        made[:, 0], made[:, 4] = True, feature
        return made

    texts, labels = [lines(9, bool(i % 2)) for i in range(40)], [i % 2 for i in range(40)]
    apart = Q.fit_field([*texts, np.vstack([lines(12, True), lines(300, False)])], [*labels, 1], stretch=12)
    whole = Q.fit_field([*texts, lines(12, True)], [*labels, 1], stretch=12)
    assert not np.allclose(apart.emission, whole.emission)  # the later stretches are read
    assert all(np.array_equal(Q.fit_field(texts, labels, stretch=s).emission,
                              Q.fit_field(texts, labels).emission) for s in (9, 50))


def test_a_text_of_very_many_lines():
    text = "\n".join(f"a line of some {i} words" for i in range(20_000))
    counts, lines, sizes = Q.measure(text)
    assert counts[0] == 120_000 and len(lines) == len(sizes) == 20_000
    (labels,) = Q.viterbi(Q.Field.empty(), [lines])
    assert labels.tolist() == [Q.CONTENT] * 20_000
