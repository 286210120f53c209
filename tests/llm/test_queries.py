"""The queries over small tables with nulls, empty texts and repeats: against SQL where it can say the same, else against plain Python."""

import hashlib
import random
import zlib

import duckdb
import pytest

import test_pii
import test_simhash
import test_sketch
import test_tokens
from sievewright.llm import queries


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    passages = [" ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(70)) for _ in range(4)]
    rows = [(0, None), (1, ""), (2, " \t\n "), (3, "one"), (4, "one é\x85x y z")]
    for i in range(5, 60):
        parts = [" ".join(rng.choice(["the", "of", "é", "ñu", "x y"]) for _ in range(rng.randrange(60))) for _ in range(3)]
        rows.append((i, rng.choice([" ", "\n", "\x0b"]).join([parts[0], rng.choice(passages), parts[1], *rng.sample(passages, rng.randrange(2)), parts[2]])))
    rows += [(60 + k, rows[10 + k][1]) for k in range(5)]
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    labels = [(i, int(i % 3 == 0), 0) for i in range(0, 60, 2)] + [(6, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["op2_substring", "op4_cross_entropy"])
def test_query_equals_sql(spark, folder, name):
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.sql(f"CREATE VIEW {t} AS FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, folder)
    want = db.sql(queries.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    left = sorted(tuple(r) for r in got.select(*names).collect())
    right = sorted(want.project(", ".join(names)).fetchall())
    assert len(left) == len(right) and all(a == pytest.approx(b, abs=2e-6) if isinstance(b, float) else a == b for x, y in zip(left, right, strict=True) for a, b in zip(x, y, strict=True))


@pytest.fixture(scope="module")
def texts(spark, folder):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


def rows_of(spark, folder, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, folder).collect()}


sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_op3(spark, folder, texts):
    got = rows_of(spark, folder, "op3_fingerprints")
    order = sorted(texts, reverse=True)
    listed = lambda s: "".join(f"{h:016x}" for h in sorted(s))
    for k, i in enumerate(order):
        own, after = texts[i] or "", texts[order[(k + 1) % len(order)]] or ""
        edited = own[: len(own) - len(own) // 3] + after[: len(own) // 3]
        prints = [test_sketch.plain_sketch(t) for t in (own, edited, after)]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(own), sha(edited), listed(prints[0]), listed(prints[1]))
        assert (r.near_edited, r.near_next) == pytest.approx((test_sketch.jaccard(*prints[:2]), test_sketch.jaccard(prints[0], prints[2])))


def test_op5(spark, tmp_path):
    import test_toxicity

    rows = test_toxicity.corpus(500, seed=6)
    docs = [(i, t, "en", "s", len(t)) for i, t, _ in rows] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = rows_of(spark, str(tmp_path), "op5_toxicity")
    assert set(got) == {d[0] for d in docs} and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(i, y) for i, _, y in rows if got[i].held_out]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held) and got[900].predicted == got[901].predicted == 0


def test_op6_and_op7(spark, folder, texts):
    got, counts = rows_of(spark, folder, "op6_bpe"), rows_of(spark, folder, "op7_token_counts")
    for i, t in texts.items():
        ids = test_tokens.TRUE.encode_ordinary(t or "")
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
        assert counts[i].n_words == len((t or "").encode().split()) <= counts[i].n_tokens


def test_op8(spark, folder, texts):
    got = rows_of(spark, folder, "op8_pii")
    for i, t in texts.items():
        base = test_pii.slow_base(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert got[i].base_sha256 == sha(listed) and set(listed.split(",")) <= set(got[i].spans.split(",")) | {""}


def test_op9(spark, folder, texts):
    got = rows_of(spark, folder, "op9_simhash")
    prints = {i: test_simhash.slow_print(t) for i, t in texts.items()}
    near = [(a, b) for a in texts for b in texts if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    root = test_simhash.slow_components(texts, near)
    assert {i: (r.fingerprint, r.component_id) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in texts}


def test_every_operator_has_a_query():
    assert [n.partition("_")[0] for n in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
