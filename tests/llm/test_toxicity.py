import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import toxicity as T

BAD = ["idiot", "moron", "scum", "worthless"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    words = ["the", "house", "tree", "of", "and", "water", "stone", "green", "lamp", "river", "idea", "motor"]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.3)
        text = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        for _ in range(rng.randrange(2, 5) if y else 0):
            text.insert(rng.randrange(len(text)), rng.choice(BAD))
        rows.append((i, " ".join(text).capitalize() + ".", y))
    return rows


def brute_decode(hidden, costs):
    """All readings of a token of leet signs and single letters."""
    readings = [("", 0.0)]
    for c in hidden:
        options = [(c, 0.0)] if c.isalpha() else [(x, T.SUBSTITUTE) for x in T.LEET[c]]
        readings = [(w + x, cost + extra) for w, cost in readings for x, extra in options]

    def cost(word):
        kinds = [T.EDGE, T.EDGE, *map(T._kind, word), T.EDGE]
        return sum(costs[a][b][c] for a, b, c in zip(kinds, kinds[1:], kinds[2:], strict=False))

    return min(readings, key=lambda r: r[1] + cost(r[0]))[0]


@pytest.fixture(scope="module")
def costs():
    total = np.zeros(T.KINDS**3, np.int64)
    for _, text, _ in corpus():
        total += np.bincount(T.trigrams(text), minlength=T.KINDS**3)
    return T.character_costs({i: int(n) for i, n in enumerate(total) if n})


def test_costs_are_probabilities(costs):
    assert np.allclose(np.exp(-costs).sum(2), 1)


def test_viterbi_finds_the_best_reading(costs):
    restorer = T.Restorer(costs)
    rng = random.Random(2)
    signs = {"o": "0", "i": "1", "e": "3", "s": "5", "l": "1", "t": "7"}
    for word in [*BAD, "house", "stone", "river", "water", "motor"]:
        for _ in range(5):
            hidden = "".join(signs[c] if c in signs and rng.random() < 0.6 else c for c in word)
            if any(a == b for a, b in zip(hidden, hidden[1:], strict=False)):
                continue  # runs have more readings
            assert restorer.decode(hidden) == [brute_decode(hidden, costs)]


@pytest.mark.parametrize("hidden", ["1d10t", "idiooooot", "IDIOT!!", "m0r0n", "s.c.u.m", "w0rthle$$", "*idiot*", "m-o-r-o-n"])
def test_hidden_words_are_restored(costs, hidden):
    assert set(T.Restorer(costs).words(hidden.lower())) & set(BAD)


def test_spaced_words_are_restored(costs):
    assert "moron" in T.Restorer(costs).spaced("you m o r o n there")
    assert T.Restorer(costs).words("green-house") == ["green", "house"]
    assert T.Restorer(costs).words("12,5") == [] and T.Restorer(costs).words("") == []


@pytest.mark.parametrize("hidden", ["iddiot", "moroon", "mo-ron", "sc'um", "mor~on", "sc/um"])
def test_doubled_letters_and_inner_separators_hide_words(costs, hidden):
    restorer = T.Restorer(costs)
    assert set(restorer.readings(hidden)) & set(BAD)
    assert set(restorer.words(hidden)) <= set(restorer.readings(hidden))
    model = T.Model(costs, {f"={w}": 3.0 for w in BAD}, (-1.0, 1.0, 0.0, 0.0))
    assert model.scorer().score(f"you {hidden} there") > 0.5 > model.scorer().score("green-house letter")


@pytest.mark.parametrize("hidden", ["s c @ m", "m o r $ n", "m ' o ' r ' o ' n", "m / o / r / o / n", "m ~ o ~ r ~ o ~ n", "s c u m"])
def test_spaced_signs_are_decoded(costs, hidden):
    found = T.Restorer(costs).spaced(f"you {hidden} there")
    assert found and found == T.Restorer(costs).decode(hidden)


def test_three_spaced_letters_are_a_word():
    restorer = T.Restorer(T.character_costs({int(c): 100 for c in T.trigrams("fat")}))
    assert restorer.spaced("you f a t one") == restorer.spaced("f a t") == restorer.spaced("f @ t") == ["fat"]
    assert restorer.spaced("you f a one") == []


def test_long_runs_take_linear_time(costs):
    restorer = T.Restorer(costs)
    for token in ("a" + "*" * 200_000 + "b", "=" * 200_000, "$" * 100_000 + "x", "1" * 20_000 + "a"):
        restorer.words(token)
    restorer.spaced("a b " * 5_000 + "ab")


def test_scores(spark):
    rows = corpus(600)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows] + [(1000, None, 0.0, ""), (1001, "", 0.0, ""), (None, "idiot moron scum", 0.0, "")], "doc_id long, text string, score double, predicted string")
    labels = spark.createDataFrame([(i, y, 1) for i, _, y in rows] + [(0, None, 1), (None, 1, 1), (1, rows[1][2], 1)], "doc_id long, toxic int, score int")
    model = T.train(docs, labels)
    got = T.score(docs, model).collect()
    assert len(got) == len(rows) + 3
    by = {r.doc_id: r for r in got}
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r.doc_id for r in got if r.held_out} == set(held) | {i for i in (1000, 1001) if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([by[i].predicted == rows[i][2] for i in held]) > 0.98
    assert by[1000].score == by[1001].score < 0.5 and by[None].predicted == 1
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    kept = T.keep_clean(docs, model)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if not r.predicted)
    for hidden in ("m0r0n 1d10t", "m o r o n and i d i o t", "sccccum wooorthless"):
        assert model.scorer().score(f"The house of water {hidden} and the river.") >= 0.5
    # labels of held-out rows are not used
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(string(doc_id)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    assert T.train(docs, flipped).weights == model.weights


def hide(word, how, rng):
    """The word in leetspeak, spaced out, with repeated letters, or in two of these ways."""
    signs = {"o": "0", "i": "1", "e": "3", "s": "$", "t": "7", "a": "@", "c": "("}
    if "leet" in how:
        word = "".join(signs.get(c, c) for c in word)
    if "repeat" in how:
        k = rng.randrange(1, len(word) - 1)
        word = word[:k] + word[k] * 3 + word[k:]
    return rng.choice([" ", ".", "-"]).join(word) if "space" in how else word


@pytest.mark.parametrize("how", [("leet",), ("space",), ("repeat",), ("leet", "repeat"), ("leet", "space")])
def test_hidden_words_count_in_held_out_documents(spark, how, monkeypatch):
    """Toxic documents, none of them seen in training, whose toxic words are all hidden: found with the decoder, not without it."""
    rows = corpus(900, seed=8)
    rng = random.Random(str(how))
    held = [zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows]
    texts = [" ".join(hide(w, how, rng) if w.lower().strip(".") in BAD else w for w in t.split(" ")) if h else t for (_, t, _), h in zip(rows, held, strict=True)]
    docs = spark.createDataFrame([(i, t) for (i, *_), t in zip(rows, texts, strict=True)], "doc_id long, text string")
    model = T.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    hidden = [t for (_, _, y), t, h in zip(rows, texts, held, strict=True) if h and y]
    clean = [t for (_, _, y), t, h in zip(rows, texts, held, strict=True) if h and not y]
    scorer = model.scorer()
    found = np.mean([scorer.score(t) >= 0.5 for t in hidden])
    plain = T.Model(model.costs, model.weights, model.logistic, "plain")
    plain.name = "plain"
    monkeypatch.setattr(T.Restorer, "readings", lambda self, token: T._WORD.findall(token))
    monkeypatch.setattr(T.Restorer, "spaced", lambda self, text: [])
    without = np.mean([plain.scorer().score(t) >= 0.5 for t in hidden])
    assert found >= 0.95 and without <= 0.1, (found, without)
    monkeypatch.undo()
    assert np.mean([model.scorer().score(t) >= 0.5 for t in clean]) <= 0.02


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in corpus(20)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.predicted for r in T.score(docs, T.train(docs, none)).collect()} == {0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r.predicted for r in T.score(docs, T.train(docs, ones)).collect()} == {1}
    assert T.score(docs.where("false"), T.train(docs.where("false"), ones)).collect() == []


def test_logistic_regression():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [2, -1] + 0.5)))).astype(float)
    assert np.allclose(T.fit_logistic(x, y), [0.5, 2, -1], atol=0.2)
    assert math.isfinite(T.fit_logistic(x, (x[:, 0] > 0).astype(float))[1])


def slow_log_odds(docs, labels):
    """The bounds with sets and counters."""
    n1, n0 = sum(labels), len(labels) - sum(labels)

    def bounds(features):
        k = [Counter(), Counter()]
        for d, y in zip(docs, labels, strict=True):
            k[int(y)].update(set(features(d)))
        out = {}
        for p, k1 in k[1].items():
            cells = (k1 + 0.5, n1 - k1 + 0.5, k[0][p] + 0.5, n0 - k[0][p] + 0.5)
            bound = math.log(cells[0] / cells[1]) - math.log(cells[2] / cells[3]) - T.Z * math.sqrt(sum(1 / c for c in cells))
            if k1 >= T.SUPPORT and bound > 0:
                out[p] = bound
        return out

    own = bounds(lambda d: [f"={w}" for w in d])
    left = [[w for w in d if own.get(f"={w}", 0) < T.MARKED] for d in docs]
    docs = left
    strong = {p: b for p, b in bounds(lambda d: [p for w in d for p in T.parts(w)]).items() if b >= T.STRONG}
    weak = bounds(lambda d: [p for w in d if strong.keys().isdisjoint(T.parts(w)) for p in T.parts(w)])
    return own | weak | strong


def test_bounds_equal_brute_force():
    rng = random.Random(5)
    stems, ends = ["house", "stone", "losen", "veque", "vequa", "grtti"], ["", "ing", "ment", "aire", "uaire", "x"]
    docs, labels = [], []
    for _ in range(300):
        y = rng.random() < 0.4
        words = {rng.choice(stems[:3]) + rng.choice(ends) for _ in range(8)} | ({rng.choice(stems[3:5]) + rng.choice(ends), "idiot"} if y else set())
        docs.append(tuple(sorted(words)))
        labels.append(float(y))
    evidence = T.Evidence(docs, np.array(labels))
    for use in (np.ones(300, bool), np.arange(300) % 3 > 0):
        own, part = evidence.log_odds(use)
        want = slow_log_odds([d for d, u in zip(docs, use, strict=True) if u], [y for y, u in zip(labels, use, strict=True) if u])
        got = evidence.named(own, part)
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
        assert any(k[0] == "<" for k in got) and any(k[0] == "=" for k in got)
        model = T.Model(np.zeros((T.KINDS,) * 3), got)
        assert evidence.word_scores(own, part) == pytest.approx([model.word_score(w) for w in evidence.words])


def test_a_bounded_sample_does_not_shift_the_intercept(spark, monkeypatch):
    assert T.unsampled(0.5, {1: 20, 0: 40}, {1: 20, 0: 40}) == 0.5 == T.unsampled(0.5, {1: 20}, {1: 30})
    assert T.unsampled(0.5, {1: 2000, 0: 4000}, {1: 3000, 0: 60000}) == pytest.approx(0.5 + math.log(3000 / 60000) - math.log(2000 / 4000))
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    own = T.train(docs, labels, sample={1: 40, 0: 10})
    monkeypatch.setattr(T, "unsampled", lambda first, sampled, every: first)
    fitted = T.train(docs, labels, sample={1: 40, 0: 10})
    kept = Counter(y for i, _, y in rows if zlib.crc32(str(i).encode()) % 5)
    assert own.logistic[1:] == fitted.logistic[1:]
    assert own.logistic[0] - fitted.logistic[0] == pytest.approx(math.log(kept[1] / kept[0]) - math.log(40 / 10))
