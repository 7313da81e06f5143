"""Mixing, segmentations and language-model scores."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stationflow.llm import attention as A
from stationflow.llm import lm_scoring as S
from stationflow.llm import mixing as M
from stationflow.llm import segmentations as G
from stationflow.llm.lattice import Lattice
from stationflow.llm.text import WORDS, held_out, lower_az


def shares(total, caps, weights):
    """Fill by weight, resharing what is above a cap until nobody is."""
    got = dict.fromkeys(caps, 0.0)
    capped = set()
    while True:
        rest = total - sum(caps[s] for s in capped)
        over = sum(weights[s] for s in caps if s not in capped)
        got = {s: caps[s] if s in capped else rest * weights[s] / over for s in caps}
        more = {s for s in caps if got[s] > caps[s]}
        if not more:
            return got
        capped |= more


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(8)
    rows = []
    for i in range(1500):
        source = rng.choice(["hot"] * 6 + ["a", "B", "é", None, "z9"])
        rows.append((i, " ".join(["w"] * int(rng.lognormvariate(3, 1))), source))
    rows += [(2000, None, "empty"), (2001, "", "empty"), (2002, "w w", "tiny")]
    return rows


def test_mixture_targets_and_words(spark, many):
    docs = spark.createDataFrame(many, "doc_id bigint, text string, source string")
    rows = M.mix_sources(docs).collect()
    sizes = defaultdict(int)
    for _, text, source in many:
        sizes[source] += len(WORDS.findall(text or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    wanted = shares(1.5 * sum(sizes.values()), {s: 2 * n for s, n in sizes.items()}, weights)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 2
        assert math.isclose(r["target"], wanted[r["source"]], abs_tol=1e-6)
        taken[r["source"]] += r["size"] * r["copies"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for source in sizes:
        assert abs(taken[source] - wanted[source]) <= largest[source] / 2 + 1e-6
    assert len(rows) == len(many)
    again = M.mix_sources(docs.repartition(7)).collect()
    assert {(r["id"], r["copies"]) for r in rows} == {(r["id"], r["copies"]) for r in again}


def test_pareto_order_follows_the_odds(spark):
    places = spark.range(1).select(
        M._place(F.lit(0.2), F.lit(0.5)).alias("low"), M._place(F.lit(0.2), F.lit(0.9)).alias("likely"),
        M._place(F.lit(0.2), F.lit(0.0)).alias("never"),
    ).head()
    assert places["likely"] < places["low"] and places["never"] is None
    assert math.isclose(places["low"], (0.25 / 1) / (1 + 0.25 / 1))


def test_mixed_documents(odd_docs, no_docs):
    mixed = M.mixed_documents(odd_docs)
    assert mixed.columns == odd_docs.columns
    copies = Counter(r["doc_id"] for r in mixed.collect())
    plan = {(r["id"], r["copies"]) for r in M.mix_sources(odd_docs).collect()}
    assert all(copies[i] == n * (2 if i == 3 else 1) for i, n in plan)
    assert M.mixed_documents(no_docs).count() == 0 and M.mix_sources(no_docs).count() == 0


@pytest.fixture(scope="module")
def pieces(sp_model):
    return G._pieces(sp_model)


@pytest.fixture(scope="module")
def scores(pieces):
    values = np.log(0.2 + np.random.default_rng(0).random(pieces.size))
    return 0.2 * (values - np.log(np.exp(values).sum()))


def segmentations(text, pieces):
    """All ways to write a marked text in pieces."""
    if not text:
        return [()]
    found = []
    for n in range(1, len(text) + 1):
        i = pieces.library.piece_to_id(text[:n])
        if i != pieces.library.unk_id() and pieces.usable[i]:
            found += [(i, *rest) for rest in segmentations(text[n:], pieces)]
    return found


def test_lattice_weights_are_those_of_all_segmentations(pieces, scores):
    chunks = ["▁the", "▁tions", "▁", "▁on"]
    lattice = Lattice(chunks, pieces, scores)
    for at, chunk in enumerate(chunks):
        ways = [sum(scores[i] for i in s) for s in segmentations(chunk, pieces)]
        assert math.isclose(lattice.total[lattice.first[at]], np.logaddexp.reduce(ways))


def test_lattice_in_blocks_and_by_logarithms(pieces, scores, monkeypatch):
    """Blocks, and weights that are added up as they are, change nothing but the time."""
    from stationflow.llm import lattice as module

    chunks = ["▁the", "▁" + "tion" * 40, "▁naïve", "▁日本語", "▁", "▁x\U0001f600y", "▁on"]
    whole = Lattice(chunks, pieces, scores)
    monkeypatch.setattr(module, "BLOCK", 5)
    cut = Lattice(chunks, pieces, scores)
    monkeypatch.setattr(module, "SAFE", 0.0)
    logs = Lattice(chunks, pieces, scores)
    for other in (cut, logs):
        assert np.array_equal(other.start, whole.start) and np.array_equal(other.end, whole.end)
        assert np.allclose(other.total, whole.total) and np.allclose(other.odds, whole.odds)
        assert np.allclose(other.until, whole.until)
        edges = np.flatnonzero(np.isin(other.start, whole.first))
        same = [np.concatenate(x.spell(edges, pieces.size)) for x in (other, whole)]
        assert np.array_equal(*same)
    sums = np.add.reduceat(whole.odds, np.unique(whole.pointer[whole.start]))
    assert np.allclose(sums, 1) and (whole.odds[np.diff(whole.pointer)[whole.start] == 1] == 1).all()


def test_texts_share_one_lattice(pieces, scores, monkeypatch):
    """A word is cut once for all texts held together, however few are drawn together."""
    made = []
    monkeypatch.setattr(G, "Lattice", lambda *args: made.append(args[0]) or Lattice(*args))
    monkeypatch.setattr(G, "TOGETHER", 3)
    texts = ["the ration", None, "on the nation", "", "the ration the"] * 4
    found = G.sample_texts(texts, list(range(20)), pieces, scores, 2)
    assert len(made) == 1 and sorted(made[0]) == ["▁", "▁nation", "▁on", "▁ration", "▁the"]
    for at, of_text in enumerate(found):
        alone = G.sample_texts(texts[at : at + 1], [at], pieces, scores, 2)[0]
        assert [x[0].tolist() for x in of_text] == [x[0].tolist() for x in alone]
        assert np.allclose([x[1:] for x in of_text], [x[1:] for x in alone])


def test_draws_without_replacement_have_the_right_distribution(pieces, scores):
    text, n = "tin is", 20_000
    all_ways = segmentations("▁tin▁is", pieces)
    weights = np.array([sum(scores[i] for i in s) for s in all_ways])
    chance = np.exp(weights - np.logaddexp.reduce(weights))
    place = {s: i for i, s in enumerate(all_ways)}
    first, second = np.zeros(len(chance)), np.zeros(len(chance))
    weighted = np.zeros(len(chance))
    for found in G.sample_texts([text] * n, list(range(n)), pieces, scores, 3):
        ways = [place[tuple(ids.tolist())] for ids, *_ in found]
        assert len(set(ways)) == 3
        assert found[0][2] >= found[1][2] >= found[2][2]
        first[ways[0]] += 1
        second[ways[1]] += 1
        for way, (_, log_prob, _, inclusion) in zip(ways, found):
            assert math.isclose(log_prob, math.log(chance[way]), abs_tol=1e-9)
            weighted[way] += chance[way] / inclusion
    noise = 4.5 * np.sqrt(chance * (1 - chance) / n) + 1e-4
    assert (abs(first / n - chance) < noise).all()
    after = np.array([
        sum(chance[j] * chance[i] / (1 - chance[j]) for j in range(len(chance)) if j != i)
        for i in range(len(chance))
    ])
    assert (abs(second / n - after) < 4.5 * np.sqrt(after / n) + 1e-4).all()
    # weighting by one over the inclusion score makes every draw count for its probability
    assert abs(weighted.sum() / n - 1) < 0.02


def test_every_segmentation_is_drawn_once_if_all_are_asked_for(pieces, scores):
    ways = segmentations("▁the", pieces)
    (found,) = G.sample_texts(["the"], ["k"], pieces, scores, len(ways) + 5)
    assert sorted(tuple(ids.tolist()) for ids, *_ in found) == sorted(ways)
    assert all(inclusion == 1.0 for *_, inclusion in found)


def test_segmentations_of_documents(odd_docs, corpus, no_docs, sp_model):
    learnt = G.piece_scores(odd_docs, sp_model)
    assert math.isclose(np.exp(learnt).sum(), 1, rel_tol=1e-9)
    drawn = G.decode_pieces(G.sample_segmentations(odd_docs, sp_model, learnt), sp_model)
    by_row = defaultdict(list)
    texts = {(i, t) for i, t, *_ in corpus}
    for r in drawn.collect():
        by_row[(r["doc_id"], r["decoded"])].append((r["draw"], tuple(r["ids"])))
    wanted = {(i, (t or "").replace("▁", " ")) for i, t in texts}
    assert set(by_row) == wanted
    assert all(len(set(v)) in (1, 2) for v in by_row.values())
    assert G.sample_segmentations(no_docs, sp_model, learnt).count() == 0
    again = G.sample_segmentations(odd_docs.repartition(5), sp_model, learnt)
    key = lambda r: (str(r["doc_id"]), r["draw"], tuple(r["ids"]))
    assert sorted(map(key, again.collect())) == sorted(
        map(key, drawn.select("doc_id", "draw", "ids").collect())
    )


def test_piece_counts_are_the_librarys(docs, corpus, sp_model, pieces):
    counts = np.full(pieces.size, G.PRIOR)
    for _, text, *_ in corpus:
        for i in pieces.library.encode((text or "").replace("▁", "_").replace("  ", " ")):
            counts[i] += 1
    plain = docs.withColumn("text", F.regexp_replace(F.replace("text", F.lit("▁"), F.lit("_")), "  ", " "))
    found = G.piece_scores(plain, sp_model)
    counts[~pieces.usable] = G.PRIOR
    seen = counts > 20
    assert np.allclose(found[seen], np.log(counts / counts.sum())[seen], atol=0.05)


def test_piece_counts_of_unaltered_texts(spark, docs, corpus, sp_model, pieces):
    odd = ["def f():\n    if x:\n        return 1", " a  b   c ", "▁a ▁ b", " ", "▁", "a ", "\t  |  |"]
    texts = [t for _, t, *_ in corpus] + odd * 30
    counts = np.full(pieces.size, G.PRIOR)
    for text in texts:
        for i in pieces.library.encode(text or ""):
            counts[i] += 1
    counts[~pieces.usable] = G.PRIOR
    found = G.piece_scores(spark.createDataFrame([(t,) for t in texts], "text string"), sp_model)
    assert np.allclose(found, np.log(counts / counts.sum()))


def test_texts_are_decoded_together(pieces):
    """As one by one, whatever their bytes; a slice of a list column too."""
    texts = ["the  nation", "", "  x", "naïve 日本 \U0001f600", "▁a"]
    ids = [pieces.library.encode(t) for t in texts] + [[int(pieces.byte_ids[0xE6])]]
    for part in (ids[:-1], ids):
        held = pa.array([[1], *part], pa.list_(pa.int32())).slice(1)
        assert pieces.decode_all(held).to_pylist() == [pieces.decode(np.asarray(i, int)) for i in part]


def test_every_piece_is_found_where_it_stands(pieces):
    """Pieces of plain letters by the table of steps, others by their hashes."""
    text = "▁theories▁naïve\0▁日本語\x80▁▁▁x\U0001f600tions"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    by_length = pieces.matches(codes)[::-1]
    found = {(a, n, i) for n, (at, ids) in enumerate(by_length, 1) for a, i in zip(at.tolist(), ids.tolist())}
    own = {pieces.library.id_to_piece(i): i for i in np.flatnonzero(pieces.usable).tolist()
           if not pieces.library.is_byte(i)}
    spans = [(a, n) for a in range(len(text)) for n in range(1, len(text) - a + 1)]
    assert found == {(a, n, own[text[a : a + n]]) for a, n in spans if text[a : a + n] in own}


def test_attention_gradient():
    rng = np.random.default_rng(0)
    model = A.Parameters.start(50, 3 * A.GROUP)
    model = A.Parameters({k: v.astype(np.float64) for k, v in model.values.items()})
    lengths = np.array([5, 130, A.SCORED, 1])
    rows, exists = A.windows(lengths)
    assert exists[:, A.CONTEXT:].sum() == lengths.sum()
    inputs = np.where(exists, rng.integers(0, 50, lengths.sum())[rows], 0)
    targets = np.where(exists, rng.integers(0, 3 * A.GROUP, lengths.sum())[rows], -1)[:, A.CONTEXT:]
    _, slopes = A.gradient(model, inputs, exists, targets)
    for name in A.NAMES:
        value = model.values[name]
        at = tuple(rng.integers(0, s) for s in value.shape)
        if name == "embed":
            at = (int(inputs[1, 20]), 3)
        kept = value[at]
        value[at] = kept + 1e-4
        up, _ = A.gradient(model, inputs, exists, targets)
        value[at] = kept - 1e-4
        down, _ = A.gradient(model, inputs, exists, targets)
        value[at] = kept
        assert math.isclose((up - down) / 2e-4, slopes[name][at], rel_tol=1e-2, abs_tol=1e-6)


def test_classes_of_a_group_as_row_by_row():
    """Rows side by side by their group, each in its place again; scores of any size."""
    rng = np.random.default_rng(2)
    model = A.Parameters.start(30, 5 * A.GROUP)
    layer = A.group_layer(model)
    group = rng.choice([0, 2, 4], 200)
    assert A.side_by_side(np.array([2, 0, 2, 4]))[1] == [(0, 0, 1), (2, 1, 3), (4, 3, 4)]
    for size in (1, 2000):
        top = (rng.standard_normal((200, A.WIDTH)) * size).astype(np.float32)
        found = A.in_group(layer, top, group)
        wanted = np.stack([t @ layer[0][g] + layer[1][g] for t, g in zip(top, group)]).astype(float)
        wanted = np.exp(wanted - wanted.max(axis=1, keepdims=True))
        assert np.isfinite(found).all() and (found.sum(axis=1) > 0).all()
        shares = found / found.sum(axis=1, keepdims=True)
        assert np.allclose(shares, wanted / wanted.sum(axis=1, keepdims=True), rtol=2e-2, atol=1e-4)
    assert A.in_group(layer, top[:0], group[:0]).shape == (0, A.GROUP)


def plain_odds(model, inputs, place):
    """Class odds at one place of a text, by loops over what it may see."""
    p = {k: v.astype(np.float64) for k, v in model.values.items()}
    window = place // A.SCORED
    begin = window * A.SCORED - A.CONTEXT
    x = {i: p["embed"][inputs[i]] + p["place"][i - begin] for i in range(max(begin, 0), place + 1)}
    query = x[place] @ p["query"]
    weight = {i: math.exp(query @ (v @ p["key"]) / math.sqrt(A.WIDTH)) for i, v in x.items()}
    seen = sum(weight[i] * (x[i] @ p["value"]) for i in x) / sum(weight.values())
    mixed = x[place] + seen @ p["mixed"]
    top = mixed + np.maximum(mixed @ p["grow"], 0) @ p["shrink"]
    return np.exp(top @ p["top"] + p["top_bias"]), top @ p["out"] + p["bias"]


def test_windows_score_every_place_once_as_by_loops():
    rng = np.random.default_rng(1)
    model = A.Parameters.start(40, 2 * A.GROUP)
    lengths = np.array([3, 2 * A.SCORED + 7])
    rows, exists = A.windows(lengths)
    symbols = rng.integers(0, 40, lengths.sum())
    odds, scores = A.forward(model, symbols[rows], exists)
    odds, scores = (v.reshape(len(rows), A.SCORED, -1) for v in (odds, scores))
    begins = np.cumsum(lengths) - lengths
    scored = Counter()
    for row, line in enumerate(rows[:, A.CONTEXT:]):
        for at, place in enumerate(line.tolist()):
            if place >= 0:
                scored[place] += 1
                text = int(place >= begins[1])
                wanted = plain_odds(model, symbols[begins[text]:], place - begins[text])
                assert np.allclose(odds[row, at], wanted[0], rtol=1e-3)
                assert np.allclose(scores[row, at], wanted[1], rtol=1e-3, atol=1e-4)
    assert scored == Counter(range(lengths.sum()))


def test_a_words_probabilities_sum_to_at_most_one(bpe):
    """Every first subword with every way to go on: one word's share of all words."""
    begins = S.begins_word(bpe)
    table = pa.table({"piece": [262, 257, 220, 13, 11], "bucket": [-1] * 5, "n": [9.0, 5.0, 2.0, 3.0, 1.0]})
    learnt = S.classes_of(table, 4, begins)
    by_class = np.bincount(learnt["kind"], np.exp(learnt["share"]), minlength=len(learnt["initial"]))
    assert np.allclose(by_class[by_class > 0], 1)
    assert (learnt["initial"][learnt["kind"]] == begins).all()


def test_all_words_train_the_model(spark, bpe, monkeypatch):
    """Every word and end of every training text is a target of the second fit."""
    words = [37, 1000, 0, 9000]
    texts = [(i, " ".join(["the"] * n)) for i, n in enumerate(words)] + [(9, None)]
    training = spark.createDataFrame(texts, "id int, text string").coalesce(1)
    seen = []

    class Rows:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            batch = pa.record_batch([pa.array([t for _, t in texts], pa.string())], names=["text"])
            seen.extend(x["seen"][0].as_py() for x in f(iter([batch])))
            return training.where("false").selectExpr("1L as seen", "array(0D) as weights")

    counts = S.settle(S.word_counts(training))
    monkeypatch.setattr(S, "PASSES", 1)
    found = {}
    monkeypatch.setattr(S, "_refined", lambda _, model, __: found.setdefault("m", model).weights)
    S.learn_model(training, counts, len(texts), bpe)
    monkeypatch.undo()
    S._refined(Rows(), found["m"], bpe)
    assert seen == [sum(words) + len(texts)]


def test_scores_do_not_depend_on_the_tables_size(docs, bpe, monkeypatch):
    """With one fitted model, words beyond the table score as those in it."""
    counts = S.settle(S.word_counts(docs))
    monkeypatch.setattr(S, "PASSES", 1)
    monkeypatch.setattr(S, "_refined", lambda _, model, __: model.weights)
    found, models = [], []
    for size in (1 << 16, 5):
        monkeypatch.setattr(S, "TABLE", size)
        models.append(S.learn_model(docs.select(F.col("doc_id").alias("id"), "text"), counts, docs.count(), bpe))
        rows = S.score_documents(docs, docs, bpe).collect()
        found.append(sorted(((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in rows)))
    assert math.isclose(models[0].mixed, models[1].mixed, rel_tol=1e-6)
    assert len(models[1].table) == 6
    assert all(math.isclose(a[2], b[2], rel_tol=1e-6) for a, b in zip(*found))


def test_scores_of_documents(odd_docs, corpus, no_docs, bpe, monkeypatch):
    monkeypatch.setattr(S, "TABLE", 40)
    monkeypatch.setattr(S, "PASSES", 1)
    train = odd_docs.where(~S.in_fold(F.col("doc_id"), 5, 1))
    rows = S.score_documents(odd_docs, train, bpe).collect()
    counts, tokens = Counter(), 0
    for key, text, *_ in corpus:
        if not held_out(key, 5, 1):
            words = WORDS.findall(lower_az(text or ""))
            counts.update([*words, None])
            tokens += len(words) + 1
    below = tokens + 0.5 * (len(counts) + 1)
    wanted = Counter()
    for key, text, *_ in corpus:
        words = [*WORDS.findall(lower_az(text or "")), None]
        base = sum(math.log10((counts[w] + 0.5) / below) for w in words)
        wanted[(key, len(words), sum(counts[w] > 0 for w in words), tokens, round(base, 4))] += 1
    found = Counter(
        (r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
        for r in rows
    )
    assert found == wanted
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    assert all(r["score"] > -20 * r["n_tokens"] for r in rows if (r["doc_id"] or 0) < 60)
    assert S.score_documents(no_docs, train, bpe).count() == 0
    untaught = S.score_documents(odd_docs, no_docs, bpe).collect()
    assert len(untaught) == len(corpus) and all(r["n_known"] == 0 for r in untaught)
