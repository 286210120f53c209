import math
import random
from collections import Counter

import numpy as np
import pytest

from sievewright.llm import cross_entropy as X


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    good, bad = [f"g{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = []
    for i in range(n):
        y = int(rng.random() < 0.5)
        kinds = (good * 3 + bad) if y else (bad * 3 + good)
        rows.append((i, " ".join(rng.choice(kinds) if rng.random() > 0.05 else f"rare{rng.randrange(9999)}" for _ in range(rng.randrange(1, 80))), y))
    return rows


def slow(rows, target):
    """The same losses with dictionaries: a list in the order of the rows."""
    split = [(i, (t or "").encode().split()) for i, t in rows]
    kinds = len({w for _, ws in split for w in ws})

    def model(docs):
        one, two, starts = Counter(), Counter(), 0
        for ws in docs:
            one.update(ws)
            two.update(zip([None, *ws], ws, strict=False))
            starts += bool(ws)
        n = sum(one.values())
        held = lambda h: starts if h is None else one[h]
        return lambda h, w: -math.log((two[h, w] + X.PRIOR * (one[w] + 1) / (n + kinds + 1)) / (held(h) + X.PRIOR))

    a, b = model([ws for i, ws in split if i in target]), model([ws for _, ws in split])
    out = []
    for i, ws in split:
        pairs, n = list(zip([None, *ws], ws, strict=False)), max(1, len(ws))
        out.append((i, len(ws), sum(a(*p) for p in pairs) / n, sum(b(*p) for p in pairs) / n))
    return out


def compared(got, want):
    key = lambda r: (-1 if r[0] is None else r[0], *(round(x, 9) for x in r[1:4]))
    assert len(got) == len(want)
    for r, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key), strict=True):
        assert r[:2] == w[:2] and r[2:4] == pytest.approx(w[2:]) and r[4] == pytest.approx(w[2] - w[3])


@pytest.mark.parametrize("block, slice_", [(X.BLOCK, X.SLICE), (50, 40), (1, 1)])
def test_losses_equal_brute_force(spark, block, slice_):
    rows = corpus()
    plain = [(i, t) for i, t, _ in rows] + [(500, ""), (501, None), (502, "never seen words"), (7, "a second row of one id g1 g2"), (None, "g1 g2")]
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in plain], "doc_id long, text string, n_words int, block string").repartition(3)
    target = {i for i, _, y in rows if y}
    ids = spark.createDataFrame([(i, 1) for i in [*target, min(target), None]], "doc_id long, text int")
    got = X.score(docs, ids, block=block, slice_=slice_).collect()
    compared(got, slow(plain, target))
    assert sum((r.difference < 0) == (r.doc_id in target) for r in got if r.doc_id is not None and r.doc_id < 500 and r.doc_id != 7) > 0.8 * len(rows)


def test_evidence_of_a_text_stays_in_a_larger_corpus(spark):
    """A document's bigrams are counted however rare they are next to the corpus."""
    rows = [(i, t) for i, t, _ in corpus(3, 2000)] + [(9001, "once upon a quiet time"), (9002, "once upon a quiet time"), (9003, "twice below some loud place")]
    got = {r.doc_id: r for r in X.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(0,)], "doc_id long")).collect()}
    assert got[9001].loss_background == got[9002].loss_background < got[9003].loss_background


def test_probabilities_sum_to_one():
    counts = Counter({"a": 5, "b": 7})
    pairs = Counter({("a", "b"): 3, ("a", "a"): 1, ("b", "a"): 4, ("b", "b"): 2})
    totals = X.Totals(kinds=2, background=12, target=0)
    for h in "ab":
        words = np.array([counts[w] for w in "ab"] + [0.0])  # the last is the unknown word
        p = np.exp(-totals.losses(words, np.full(3, float(counts[h])), np.array([pairs[h, w] for w in "ab"] + [0.0]), 12))
        ends = (counts[h] - sum(pairs[h, w] for w in "ab")) / (counts[h] + X.PRIOR)  # the rest: that the text ends here
        assert p.sum() + ends == pytest.approx(1)


def test_very_long_text(spark, monkeypatch):
    rng = random.Random(5)
    long_ = " ".join(f"w{rng.randrange(3000)}" for _ in range(300_000)) + "\t\n  end"
    assert b"".join(X.pieces_of(long_.encode(), 1000)) == long_.encode()
    assert [p.split()[-1:] for p in X.pieces_of(b"aa bb  cc" + b"d" * 50, 4)][-1] == [b"cc" + b"d" * 50]
    rows = [(1, long_), (2, "w1 w2 end")]
    got = X.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(2,)], "doc_id long"), block=50_000, slice_=10_000).collect()
    compared(got, slow(rows, {2}))


def test_pieces_of_one_text_score_as_the_whole(spark, monkeypatch):
    rows = [(i, t) for i, t, _ in corpus(8, 40)]
    pieces = [p for _, t in rows for p in X.pieces_of(t.encode(), 20)]
    assert len(pieces) > 200
    whole = X.Block.of([t.encode() for _, t in rows], [b""] * len(rows))
    before = []
    for _, t in rows:
        last = b""
        for p in X.pieces_of(t.encode(), 20):
            before.append(last)
            last = p.split()[-1]
    cut = X.Block.of(pieces, before)
    assert np.array_equal(np.sort(whole.entries()), np.sort(cut.entries()))


def test_no_documents_and_no_target(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    assert {round(r.loss_target, 9) for r in X.score(docs, none).collect()} == {round(math.log(3), 9)}
    assert X.score(docs.where("false"), none).collect() == []
    assert [(r.n_tokens, r.difference) for r in X.score(docs.selectExpr("doc_id", "string(null) as text"), none).collect()] == [(0, 0.0)] * 2
