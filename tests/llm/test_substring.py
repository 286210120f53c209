import hashlib
import random

import numpy as np
import pytest

from sievewright.llm import substring


def slow(rows, length):
    least = {}
    for doc, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - length + 1 if doc is not None else 0):
            key = tuple(words[i : i + length])
            least[key] = min(doc, least.get(key, doc))
    out = []
    for doc, text in rows:
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - length + 1 if doc is not None else 0):
            if least[tuple(words[i : i + length])] < doc:
                gone |= set(range(i, i + length))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((doc, len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, length):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "dd", "x\x85y"])
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(length, 3 * length))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [[word() for _ in range(rng.randrange(2 * length))]]
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            parts += [p[rng.randrange(3) :], [word() for _ in range(rng.randrange(length))]]
        texts.append(rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p))
    texts += [texts[3], texts[3], texts[5] + " z", None, "", " ", "a " * 9 * length]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("length", "gram", "heavy"), [(50, 8, 512), (12, 4, 512), (12, 4, 3), (5, 2, 2), (16, 4, 4)])
def test_equals_brute_force(spark, length, gram, heavy):
    rows = corpus(length + heavy, length)
    rows += [rows[4], (rows[5][0], rows[6][1]), (None, rows[2][1])]
    docs = spark.createDataFrame([(d, t, 0, "s") for d, t in rows], "doc_id long, text string, n_words int, spans string").repartition(3)
    got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs, length=length, gram=gram, heavy=heavy).collect()), key=str)
    assert got == slow(rows, length)


def test_empty_table_and_long_text():
    rng = np.random.default_rng(1)
    words = [b"w%d" % i for i in rng.integers(0, 4000, 5000)]
    whole = substring.anchors(words)
    parts = substring.anchors(words, at_once=300)
    for a, b in zip(whole, parts, strict=True):
        assert (a == b).all()
    assert whole[1][0] == 0 and whole[2][-1] == len(words) - 50


def test_empty_table(spark):
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def with_ends(segments):
    """Numbered words of segments, each with an end of its own."""
    flat, starts, top = [], [], 1 + max(w for s in segments for w in s)
    for k, s in enumerate(segments):
        starts += range(len(flat), len(flat) + len(s))
        flat += [*s, top + k]
    return np.array(flat), np.array(starts)


def test_tree_orders_suffixes_and_knows_common_prefixes():
    rng = np.random.default_rng(2)
    segments = [rng.integers(0, 2, n).tolist() for n in (40, 17, 90, 3)]
    words, starts = with_ends(segments)
    tree = substring.SuffixTree(words, starts, 90)
    parts = [tuple(words[s : s + 91]) for s in tree.suffixes]
    assert parts == sorted(parts)
    for a, b, n in zip(parts, parts[1:], tree.common, strict=False):
        assert n == next(i for i in range(91) if a[i] != b[i])


def test_internal_nodes():
    """Each internal node is a right-diverse repeated sequence, with all of its places."""
    rng = np.random.default_rng(4)
    segments = [rng.integers(0, 2, n).tolist() for n in (30, 25, 12)]
    words, starts = with_ends(segments)
    tree = substring.SuffixTree(words, starts, 30)
    want = {}
    for s in starts.tolist():
        for n in range(3, 31):
            if words[s : s + n].max() < 2 and len(words[s : s + n]) == n:
                want.setdefault(tuple(words[s : s + n]), set()).add(s)
    want = {k: v for k, v in want.items() if len({words[s + len(k)] for s in v}) > 1}
    got = {tuple(words[tree.suffixes[a] : tree.suffixes[a] + n]): set(tree.suffixes[a : b + 1].tolist()) for n, a, b in tree.internal_nodes(3)}
    assert got == want


def test_prefixes_lie_in_their_windows_and_depend_on_the_offset_only():
    assert substring.prefix_lengths() == [8, 16, 32, 50]
    for length, gram in ((50, 8), (12, 4), (5, 2), (16, 4), (8, 8)):
        for prefix in substring.prefix_lengths(length, gram):
            for offset in range(length - gram + 1):
                before = substring.words_before(offset, prefix, length)
                assert 0 <= before <= offset and offset - before + prefix <= length


def slow_passages(rows, length):
    """Windows with the smallest doc_id that has them and its first place, joined where both sides go on."""
    split = [(d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, ws in split:
        for i in range(len(ws) - length + 1):
            k = tuple(ws[i : i + length])
            least[k] = min((d, i), least.get(k, (d, i)))
    spans = set()
    for d, ws in split:
        runs = {}
        for i in range(len(ws) - length + 1):
            src, j = least[tuple(ws[i : i + length])]
            if src < d:
                runs.setdefault((src, i - j), []).append(i)
        for (src, shift), at in runs.items():
            start, stop = at[0], at[0] + length
            for i in at[1:]:
                if i > stop:
                    spans.add((d, start, stop, src, start - shift))
                    start = i
                stop = i + length
            spans.add((d, start, stop, src, start - shift))
    return spans


@pytest.mark.parametrize(("length", "gram", "heavy"), [(50, 8, 512), (12, 4, 512), (12, 4, 3), (12, 4, 9), (16, 4, 2)])
def test_maximal_passages(spark, length, gram, heavy):
    """Passages of up to three windows' length, in heavy groups and in light ones."""
    rows = [(d, t) for d, t in corpus(7 + heavy, length) if t is None or not t.startswith("a a a")]  # of a copy's own repeats the whole is told
    seen = set()
    rows = [(d, t) for d, t in rows if (key := tuple((t or "").split())) not in seen and not seen.add(key)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in substring.maximal_passages(docs, length=length, gram=gram, heavy=heavy).collect()]
    want = slow_passages(rows, length)
    assert len(got) == len(set(got)) and any(b - a > length for _, a, b, _, _ in got)
    if heavy == 512:
        assert set(got) == want
    words = {d: (t or "").encode().split() for d, t in rows}
    covered = lambda spans: {(d, i) for d, a, b, _, _ in spans for i in range(a, b)}
    assert covered(got) == covered(want)
    lines = {}
    for d, a, b, src, at in got:
        assert src < d and b - a >= length and words[d][a:b] == words[src][at : at + b - a]
        lines.setdefault((d, src, a - at), []).append((a, b))
    assert all(x[1] < y[0] for spans in map(sorted, lines.values()) for x, y in zip(spans, spans[1:], strict=False))  # none goes on in another


def test_copies_are_one_passage(spark):
    text = " ".join(f"w{i}" for i in range(70))
    docs = spark.createDataFrame([(3, text), (5, text), (9, text.replace(" ", "\n"))], "doc_id long, text string")
    assert sorted(map(tuple, substring.maximal_passages(docs).collect())) == [(5, 0, 70, 3, 0), (9, 0, 70, 3, 0)]


def test_very_long_text_and_clashing_columns(spark):
    rng = random.Random(3)
    long_ = [f"w{rng.randrange(500)}" for _ in range(120_000)]
    rows = [(1, " ".join(long_[50_000:50_200])), (2, " ".join(long_)), (3, "x " + " ".join(long_[:80]))]
    docs = spark.createDataFrame([(d, t, b"", 1, "k") for d, t in rows], "doc_id long, text string, packed binary, first int, key string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.remove_repeats(docs).collect())
    assert got == slow(rows, 50)
