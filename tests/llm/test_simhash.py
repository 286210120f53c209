import random

import pytest
import xxhash

from sievewright.llm import simhash
from sievewright.operators.components import connected


def slow_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


TEXTS = [None, "", " \t\n", "One", "one two", "ONE TWO", "é É a B c", "a b c a b c a b c", "x y z\x85w v u", "same text here again", "Same text here again"]


def test_fingerprint_is_that_of_brute_force():
    rng = random.Random(1)
    for text in [*TEXTS, " ".join(rng.choice("abcdé") for _ in range(300))]:
        assert simhash.fingerprint(text) == slow_print(text)
        assert simhash.fingerprint(text, at_once=7) == slow_print(text)


@pytest.mark.parametrize("parts", [2, 4])
@pytest.mark.parametrize("block", [2, 64])
def test_links_lose_none(spark, monkeypatch, parts, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(block)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {s ^ sum({1 << rng.randrange(64) for _ in range(rng.randrange(5))}) for s in seeds for _ in range(12)} | {0, 1, 2**64 - 1}
    signed = lambda n: n - (n >> 63 << 64)
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = simhash.links(frame, parts).collect()
    assert all((a ^ b) & (2**64 - 1) for a, b in got)
    near = [(signed(a), signed(b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3]
    nodes = [signed(f) for f in fps]
    assert slow_components(nodes, got) == slow_components(nodes, near)


def test_near_duplicates_and_keep_one(spark):
    rows = list(enumerate(TEXTS * 2)) + [(3, "One"), (None, "One"), (None, None)]
    docs = spark.createDataFrame([(i, t, "n", 1) for i, t in rows], "doc_id long, text string, fp string, n int")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    prints = {i: slow_print(t) for i, t in rows if i is not None}
    linked = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    roots = slow_components(prints, linked)
    for r in got:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", roots[r.doc_id])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(roots.values())) and ids.count(None) == 2


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == [] and simhash.keep_one(docs).collect() == []


@pytest.mark.parametrize("kind", ["path", "star", "random", "empty"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 50)] + [(70, 71)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)], "empty": [(1, 1)]}[kind]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    want = slow_components(nodes, edges) if nodes else {}
    assert got.keys() == nodes
    assert len({(got[n], want[n]) for n in nodes}) == len(set(got.values())) == len(set(want.values()))


def test_keep_one_with_any_column_names(spark):
    names = ["doc_id", "text", "_row", "_gone", "row", "tie", "place", "fp", "component_id", "a.b"]
    rows = [(5, "one two three four", *range(8)), (3, "one two three four", *range(8)), (9, "something else entirely here", *range(8)), (9, "something else entirely here", *range(8)), (None, "one two three four", *range(8))]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'string' if n == 'text' else 'long'}" for n in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == names and kept.dtypes == docs.dtypes
    assert sorted((tuple(r) for r in kept.collect()), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)
