import random

import numpy as np
import pytest

from sievewright.llm import decontaminate as D

WORDS = [f"{a}{b}" for a in "bcdfgh" for b in ("a", "é", "o3", "un")]


def sentence(rng, n, kinds=WORDS):
    return " ".join(rng.choice(kinds) for _ in range(n))


def corpus(seed):
    rng = random.Random(seed)
    items = []
    for i in range(40):
        n = rng.choice([1, 2, 4, 6, 15, 30, 64, 65, 150])
        shape = rng.choice(["{}? {}", "{}\n{}", "{}. {}.", "{} {}"])
        items.append((i, shape.format(sentence(rng, n), sentence(rng, max(1, n // 3)))))
    texts = [None, "", "...", items[3][1].upper().replace(" ", "  ,")]
    for _ in range(60):
        text = sentence(rng, rng.randrange(400))
        for _ in range(rng.randrange(3)):
            words = rng.choice(items)[1].split(" ")
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = "zz"
            text += " " + " ".join(words) + " " + sentence(rng, rng.randrange(100))
        texts.append(text)
    return items, texts


def slow(items, texts):
    out = []
    for text in texts:
        words = D.normal_words(text)
        found = {}
        for item, item_text in items:
            for part in D.parts_of(item, item_text):
                for k in range(0, max(1, len(words)), D.STEP):
                    shares = D.overlaps(part, words[k : k + D.STEP + D.PART])
                    if words and shares[0] >= D.LEAST and min(shares) >= D.SIDE:
                        found[item] = max(found.get(item, 0), shares[0])
        out.append(found)
    return out


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("free", [0.0, 0.3, 0.9])
def test_retrieval_loses_nothing(seed, free):
    items, texts = corpus(seed)
    index = D.Index([p for i, t in items for p in D.parts_of(i, t)], free=free, block=3)
    want = slow(items, texts)
    assert D.matches(texts, index) == want and any(want)


def test_scores_are_bm25():
    items, _ = corpus(3)
    index = D.Index([p for i, t in items for p in D.parts_of(i, t)])
    rng = random.Random(1)
    for _ in range(20):
        words = {w.encode() for w in rng.sample(WORDS, 20)}
        codes = np.array([index.number[w] for w in words if w in index.number], np.int64)
        want = {}
        for t in codes.tolist():
            for k in range(index.first[t], index.first[t + 1]):
                want[int(index.part[k])] = want.get(int(index.part[k]), 0) + index.score[k]
        got = index.retrieve(np.zeros(len(codes), np.int64), codes)
        assert dict(zip(got[1].tolist(), got[2].round(9).tolist(), strict=True)) == {p: round(s, 9) for p, s in want.items() if s >= 1}


def test_wand_finds_all_and_reads_little(monkeypatch):
    rng = random.Random(4)
    items = [(i, f"{sentence(rng, 12)}? {sentence(rng, 6)}") for i in range(400)]
    index = D.Index([p for i, t in items for p in D.parts_of(i, t)], block=4)
    for bound in (0.5, 1.0, 1.5):
        for _ in range(15):
            codes = sorted({index.number[w.encode()] for w in rng.sample(WORDS, rng.randrange(1, 20)) if w.encode() in index.number})
            want = {}
            for t in codes:
                for k in range(index.first[t], index.first[t + 1]):
                    want[int(index.part[k])] = want.get(int(index.part[k]), 0) + index.score[k]
            got = index.wand(codes, bound)
            assert [p for p, _ in got] == sorted(p for p, s in want.items() if s >= bound)
            assert all(s == pytest.approx(want[p]) for p, s in got)


def by_definition(items, texts):
    """Items of up to 64 words whose shingles, and whose question's and answer's, are in 128 words from a multiple of 64 on."""
    def words(text):
        return "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower()).split(" ")

    def shingle_set(ws):
        ws = [w for w in ws if w]
        return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()

    out = []
    for text in texts:
        own = [w for w in words(text) if w]
        found = set()
        for item, whole in items:
            question, _, answer = whole.rpartition("?")
            sides = [shingle_set(words(question) + words(answer)), shingle_set(words(question)), shingle_set(words(answer))]
            for k in range(0, max(1, len(own)), 64):
                window = own[k : k + 128]
                held = [len([s for s in side if s in {tuple(window[i : i + len(s)]) for i in range(len(window) - len(s) + 1)}]) / len(side) if side else 1.0 for side in sides]
                if held[0] >= 0.8 and min(held[1:]) >= 0.5:
                    found.add(item)
        out.append(found)
    return out


def test_query_by_definition(spark, tmp_path):
    from sievewright.llm import queries

    rng = random.Random(9)
    items = [(i, f"{sentence(rng, rng.choice([6, 15, 30]))}? {sentence(rng, rng.choice([1, 5, 12]))}") for i in range(25)]
    texts = []
    for _ in range(50):
        parts = [sentence(rng, rng.randrange(90))]
        for _ in range(rng.randrange(3)):
            held = rng.choice(items)[1].replace("?", rng.choice(["?", " ,", "..."])).split(" ")
            if rng.random() < 0.4:
                held[rng.randrange(len(held))] = "zz"
            parts += [" ".join(held), sentence(rng, rng.randrange(90))]
        texts.append(" ".join(parts))
    texts += [None, "", texts[0]]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = by_definition(items, texts)
    got = {r.doc_id: {int(x.split(":")[0]) for x in r["items"].split(",") if x} for r in queries.op10_decontamination(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want)) and sum(map(bool, want)) > 15


def test_one_pass_holds_one_index(spark):
    items, texts = corpus(4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    plan = D.contamination(docs, bench, shard_bytes=300)._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan  # shards are done, what is left joins their hits
    assert D.contamination(docs, bench)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


def test_question_and_answer():
    assert D.question_and_answer("What is it? A cat.") == ("What is it?", " A cat.")
    assert D.question_and_answer("one two\nthree\n") == ("one two\n", "three")
    assert D.question_and_answer("One two. Three four. Five.") == ("One two. Three four.", " Five.")
    assert D.question_and_answer("a b c d") == ("a b", "c d")
    assert D.question_and_answer("Why? How? Yes.") == ("Why? How?", " Yes.") and D.question_and_answer("3.14 is pi") == ("3.14", "is pi")
    assert D.question_and_answer("") == ("", "") and D.question_and_answer("Who?") == ("", "Who?")


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_contamination(spark, shard_bytes):
    items, texts = corpus(4)
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[5], (None, texts[6], "x", 1)], "doc_id long, text string, items string, n_items int")
    bench = spark.createDataFrame([*[(i, t, 0) for i, t in items], (3, items[3][1], 1), (99, None, 0), (98, "", 0), (None, texts[7], 0)], "item_id long, text string, doc_id int")
    want = slow(items, texts)
    got = D.contamination(docs, bench, shard_bytes=shard_bytes).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        found = want[6 if r.doc_id is None else r.doc_id]
        assert (r.n_items, r.contaminated) == (len(found), bool(found))
        assert r.items == ",".join(f"{i}:{s:.4f}" for i, s in sorted(found.items()))
    kept = D.keep_clean(docs, bench, shard_bytes=shard_bytes)
    assert kept.columns == docs.columns
    assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if not want[6 if r.doc_id is None else r.doc_id])
    nothing = D.contamination(docs, bench.where("false")).collect()
    assert len(nothing) == len(rows) + 2 and not any(r.contaminated for r in nothing)
    assert D.contamination(docs.where("false"), bench).collect() == []


def test_items_of_many_parts_count_as_a_whole(spark):
    other = [f"x{i}" for i in range(200)]
    items, docs = [], []
    for n in (65, 68, 70, 125, 150, 300):
        words = [f"{n}w{i}" for i in range(n)]
        question, answer = words[: n - 12], words[n - 12 :]
        items.append((n, f"{' '.join(question)}? {' '.join(answer)}"))
        for before in range(0, 130, 13):
            for clean in (words[-5:], answer, words[60:65], question, words[:48]):  # a tail, a side, a part
                docs.append((0, " ".join([*other[:before], *clean, *other])))
            docs.append((n, " ".join([*other[:before], *words, *other])))
            docs.append((n, " ".join([*other[:before], *question, "zz", "answer", "zz", *answer])))
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.contamination(docs, bench).collect()
    assert [r for r in got if r.items != (f"{r.doc_id}:1.0000" if r.doc_id else "")] == []
    assert {r.doc_id for r in D.keep_clean(docs, bench).collect()} == {0}
