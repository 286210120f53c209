import hashlib
import random

import numpy as np
import pytest
import xxhash

from sievewright.llm import sketch as S


def random_words(seed, n, kinds=2000):
    rng = random.Random(seed)
    return [b"w%d" % rng.randrange(kinds) for _ in range(n)]


def plain_hash(shingle):
    """The shingle's hash from its definition, with Python's integers."""
    h = len(shingle)
    for w in shingle:
        h = (h * 0x9E3779B97F4A7C15 % 2**64) ^ (xxhash.xxh64_intdigest(w) * 0xC2B2AE3D27D4EB4F % 2**64)
        h ^= h >> 29
    h = h * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 32


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_sketch(text):
    """Every shingle hash below the bound, as a set."""
    return {h for h in map(plain_hash, shingles((text or "").encode().split())) if h < (2**64 - 1) // S.SCALE}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("n", [0, 1, 3, 4, 5, 6, 20, 300, 60_000])
def test_every_hash_below_the_bound(n):
    words = random_words(n, n, 40)
    assert S.sketch(words).tolist() == sorted(plain_sketch(b" ".join(words).decode()))


def test_estimates_and_containment():
    a = random_words(1, 9000)
    b = a[:6000] + random_words(2, 3000)
    near, held = S.likeness(S.sketch(a), S.sketch(b))
    assert near == pytest.approx(jaccard(shingles(a), shingles(b)), abs=0.05) and held == pytest.approx(2 / 3, abs=0.05)
    part = a[1000:2000]  # unequal lengths
    assert S.likeness(S.sketch(part), S.sketch(a))[1] == 1.0


def test_empty_sketches():
    some = np.array([1], np.uint64)
    none = some[:0]
    assert S.likeness(none, none) == (1.0, 1.0) and S.likeness(some, none) == (0.0, 0.0) and S.likeness(none, some) == (0.0, 1.0)


def test_sketches_merge():
    for n, m in ((10, 3000), (20, 20), (5000, 4000), (0, 40)):
        a, b = random_words(n, n), random_words(m + 1, m)
        whole = np.union1d(S.shingle_hashes(a), S.shingle_hashes(b))
        whole = whole[whole < np.uint64(2**64 - 1) // np.uint64(S.SCALE)]
        assert np.array_equal(S.merge(S.sketch(a), S.sketch(b)), whole)
        assert np.array_equal(S.from_text(S.as_text(whole)), whole)


@pytest.mark.parametrize("n", [0, 1, 2, 40, 300])
def test_against_next(spark, n):
    rng = random.Random(n)
    texts = [" ".join(w.decode() for w in random_words(i, rng.randrange(200))) for i in range(n)]
    texts[:3] = ["é漢 x\ny", "", "é漢 x\ny"][:n]
    ids = rng.sample(range(-500, 500), n)
    rows = [(i, t or None, 5, "f") for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, fingerprint string").repartition(3)
    got = {r.doc_id: r for r in S.against_next(docs).collect()}
    assert len(got) == n
    ordered = sorted(zip(ids, texts, strict=True), reverse=True)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % n][1]
        edited = text[: len(text) - len(text) // 3] + after[: len(text) // 3]
        own, changed, following = map(plain_sketch, (text, edited, after))
        assert (got[i].n_chars, got[i].edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (got[i].fingerprint, got[i].edited_fingerprint) == tuple("".join(f"{h:016x}" for h in sorted(x)) for x in (own, changed))
        assert (got[i].near_edited, got[i].near_next) == pytest.approx((jaccard(own, changed), jaccard(own, following)))
    assert [r.fingerprint for r in S.fingerprints(docs).orderBy("doc_id").collect()] == [got[i].fingerprint for i in sorted(ids)]


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "d"), (None, None)], "doc_id long, text string")
    got = S.against_next(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 1), ("1", 3), ("1", 3), ("None", 0), ("None", 1)]


def test_very_long_text(spark):
    long_ = " ".join(w.decode() for w in random_words(5, 200_000))
    docs = spark.createDataFrame([(2, long_), (1, "a b c d e f")], "doc_id long, text string")
    got = {r.doc_id: r for r in S.against_next(docs).collect()}
    assert got[2].fingerprint == "".join(f"{h:016x}" for h in sorted(plain_sketch(long_))) and got[1].near_next == 0
