import hashlib
import random

import pytest

import corpus_pipeline
from sievewright.llm import bpe, pii, queries, simhash
from sievewright.llm.common import written

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in ("lan", "mer", "tos")]
    items = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(6)]
    rows, labels = [], []
    for i in range(300):
        y = int(rng.random() < 0.25)
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for _ in range(3 * y):
            text.insert(rng.randrange(len(text)), rng.choice(["idiot", "moron"]))
        if i % 17 == 0:
            text += items[i % 6].split()
        if i % 11 == 0:
            text.append(rng.choice(["ann@b.org", "+1 (555) 123-4567", "10.0.0.7"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, y))
    rows += [(300 + k, rows[k * 3][1]) for k in range(30)] + [(400, None), (401, ""), (402, " ")]
    at = tmp_path_factory.mktemp("tables")
    docs = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), docs, dict((i, y) for i, _, y in labels), items


def test_stages_take_effect(spark, folder):
    at, docs, toxic, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxic_out", "near_duplicates_out", "contaminated_out", "personal_data_masked", "encoded"]
    frame, steps = spark.read.parquet(f"{at}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        frame = written(stage(spark, frame, at))
        steps.append(sorted(frame.collect(), key=lambda r: r.doc_id))
    assert all(sorted(s[0].asDict()) == sorted(c.split()[0] for c in COLUMNS.split(", ")) for s in steps[:-1])
    texts = {d[0]: d for d in docs}
    clean = {r.doc_id for r in steps[0]}
    marked = {i for i, t, *_ in docs if t and ("idiot" in t or "moron" in t)}
    assert clean == set(texts) - marked
    prints = {i: simhash.fingerprint(texts[i][1]) for i in clean}
    least = dict.fromkeys(clean)
    for i in sorted(clean):  # reached over links
        if least[i] is None:
            todo, least[i] = [i], i
            while todo:
                a = todo.pop()
                for b in clean:
                    if least[b] is None and (prints[a] ^ prints[b]).bit_count() <= 3:
                        least[b] = i
                        todo.append(b)
    assert {r.doc_id for r in steps[1]} == {i for i in clean if least[i] == i}
    dirty = {i for i in clean if any(" ".join(x.split()) in (texts[i][1] or "") for x in items)}
    assert {r.doc_id for r in steps[2]} == {i for i in clean if least[i] == i and i not in dirty} and dirty
    assert all(tuple(r) == texts[r.doc_id] for s in steps[:3] for r in s)
    masked = {r.doc_id: r for r in steps[3]}
    for r in masked.values():
        before = texts[r.doc_id][1]
        (spans,) = pii.all_spans([before or ""], pii.default_model())
        assert r.text == (None if before is None else pii._masked(before, spans[0] + spans[1])) and "@" not in (r.text or "")
        assert r.n_chars == (None if before is None else len(r.text))
    model = bpe.ByteBPE.from_file(*queries.vocabulary())
    assert [r.doc_id for r in steps[4]] == sorted(masked)
    for r in steps[4]:
        text = masked[r.doc_id].text
        assert [r.ids] == model.encode_texts([text]) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    whole = sorted(corpus_pipeline.run(spark, at).collect(), key=lambda r: r.doc_id)
    assert whole == steps[4]


def test_empty_documents(spark, folder):
    at = folder[0]
    frame = spark.read.parquet(f"{at}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, at)
        assert frame.collect() == []


def test_stages_with_any_column_names_nulls_and_repeated_ids(spark, folder):
    """Columns beside the documents' own, of names that operators use inside or that have dots, repeated rows, null ids and a long text."""
    at = folder[0]
    rows = [(i % 40 if i < 60 else None, t, "en", "s", n) for i, (_, t, _, _, n) in enumerate(folder[1][:70])] + [(900, "word " * 60_000, "en", "s", 300_000)]
    extra = ["_row", "row", "tie", "found", "a.b", "score", "text_hash"]
    frame = spark.createDataFrame(rows, COLUMNS).selectExpr("*", *(f"1L AS `{n}`" for n in extra))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, at)
        assert out.columns == frame.columns, name
        out = written(out)
        assert 0 < out.count() <= frame.count() and out.where("doc_id = 900").count() == 1
        frame = out
    assert corpus_pipeline.STAGES[-1][1](spark, frame, at).count() == frame.count()
