import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.llm import bpe, memo, wordpiece

PATH = P.path("byte_bpe_50k.tiktoken")
MODEL = bpe.ByteBPE.from_file(PATH, P.PATTERN)
TRUE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=MODEL.ranks, special_tokens={})
TEXTS = [None, "", " ", "a", "Hello  world\n\n 12 é漢字🙂", "<|endoftext|> it's", "a" * 3000, "\x00\x85  x", "ab " * 500]


def test_perfect_hash_is_minimal():
    rng = random.Random(1)
    for n in (1, 2, 7, 500, 5000):
        keys = list({rng.randbytes(rng.randrange(1, 9)) for _ in range(n)})
        assert sorted(bpe.PerfectHash(keys).slots(keys).tolist()) == list(range(len(keys)))


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_tiktoken(text):
    assert MODEL.encode_texts([text]) == [TRUE.encode_ordinary(text)]


def test_bytes_need_tokens():
    with pytest.raises(ValueError):
        bpe.ByteBPE({b"a": 0}, ".")


def test_encode_and_decode(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "a b", "x", 1), (1, "", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    encoded = bpe.encode(docs, MODEL)
    for r, (i, t, *_) in zip(encoded.collect(), rows, strict=True):
        assert (r.doc_id, r.ids, bytes(r.decoded)) == (i, TRUE.encode_ordinary(t or ""), (t or "").encode())
    assert [bytes(r.decoded) for r in bpe.decode(encoded, MODEL).collect()] == [(t or "").encode() for _, t, *_ in rows]
    for r, (_, t, *_) in zip(bpe.digests(encoded).collect(), rows, strict=True):
        ids = TRUE.encode_ordinary(t or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((t or "").encode()))
    assert bpe.digests(bpe.encode(docs.where("false"), MODEL)).collect() == []


def test_memory_forgets_but_answers():
    m = memo.Memo(lambda keys: [k * 2 for k in keys], most=10)
    for k in range(0, 200, 7):
        keys = [str(x) for x in range(k, k + 8)] + ["0", "1"]
        assert [m.known(keys)[x] for x in keys] == [2 * x for x in keys]
        assert len(m.young) <= 20 and len(m.old) <= 20


def test_memory_drops_long_keys():
    asked = []
    m = memo.Memo(lambda keys: [asked.append(k) or len(k) for k in keys], most=100, longest=8)
    for n in range(30):
        keys = ["short", "x" * (1000 + n), "y" * 2000]
        known = m.known(keys)
        assert [known[k] for k in keys] == [5, 1000 + n, 2000]
    m.known(["short"])
    assert set(m.young) == {"short"} and asked.count("short") == 1 and asked.count("y" * 2000) == 30


def greedy(word, initial, continuation):
    at = n = 0
    while at < len(word):
        pieces = continuation if n else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.sets(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abcd", min_size=1, max_size=14), max_size=20))
def test_counts_are_greedy(initial, continuation, words):
    a, b = ({x.encode() for x in s} for s in (initial, continuation))
    model = wordpiece.LongestMatch(a, b)
    for w in words:
        assert model.count(w.encode()) == greedy(w.encode(), a, b)


def test_token_counts(spark):
    model = wordpiece.LongestMatch.from_file(PATH)
    tokens = {base64.b64decode(x.split()[0]) for x in open(PATH, "rb")}
    single = {bytes([b]) for b in range(256)}
    a, b = {t[1:] for t in tokens if t[:1] == b" " and len(t) > 1} | single, {t for t in tokens if t[:1] != b" "} | single
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(TEXTS)] + [(None, "x y", 0)], "doc_id long, text string, n_words int")
    for r, t in zip(wordpiece.token_counts(docs, model).collect(), [*TEXTS, "x y"], strict=True):
        words = (t or "").encode().split()
        assert (r.n_words, r.n_unknown, r.n_tokens) == (len(words), 0, sum(greedy(w, a, b) for w in words))
    unknown = wordpiece.LongestMatch([b"x"], [b"y"])
    row = wordpiece.token_counts(spark.createDataFrame([(1, "xy yx x xyyz")], "doc_id long, text string"), unknown).first()
    assert (row.n_words, row.n_unknown, row.n_tokens) == (4, 2, 5)
    assert wordpiece.token_counts(docs.where("false"), unknown).collect() == []


def test_very_long_words_and_repeated_rows(spark):
    model = wordpiece.LongestMatch([b"ab", b"a"], [b"ab", b"b", b"a"])
    docs = spark.createDataFrame([(1, "ab" * 500_000), (1, "ab" * 500_000), (2, "a b a " * 100_000)], "doc_id long, text string")
    got = sorted(tuple(r) for r in wordpiece.token_counts(docs, model).collect())
    assert got == [(1, 1, 0, 500_000)] * 2 + [(2, 300_000, 100_000, 300_000)]


def test_hash_is_of_the_whole_vocabulary():
    slots = MODEL.hash.slots(list(MODEL.ranks))
    assert np.array_equal(np.sort(slots), np.arange(len(MODEL.ranks)))
