import random
from pathlib import Path

import duckdb
import pytest

from sievewright.llm import preferences as P
from sievewright.llm import queries

PAIR = "pair_id long, prompt string, a array<struct<role:string,text:string>>, b array<struct<role:string,text:string>>"


def render(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|{role or 'unknown'}|>\n"
        if role == "assistant":
            spans.append((len(out), len(out) + len(text or "") + len(P.END)))
        out += (text or "") + P.END + "\n"
    return out, spans


def slow(a, b):
    a, b = a or [], b or []
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    (chosen, cs), (rejected, rs) = render(a[n:]), render(b[n:])
    return n, render(a[:n])[0], chosen, rejected, cs, rs


def conversation(rng):
    return [(rng.choice(["user", "assistant", "system", None]), rng.choice(["hi", "é漢🙂", "", None, "a\nb"])) for _ in range(rng.randrange(6))]


def test_format_pairs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(150):
        a = conversation(rng)
        rows.append((i, "x", a, a[: rng.randrange(len(a) + 1)] + conversation(rng)))
    rows += [(900, "x", None, [("user", "q")]), (901, "x", None, None), (902, "x", [], []), (None, "x", rows[3][2], rows[3][2])]
    got = P.format_pairs(spark.createDataFrame(rows, PAIR), chosen_col="a", rejected_col="b").collect()
    assert len(got) == len(rows)
    for r, (i, _, a, b) in zip(got, rows, strict=True):
        spans = lambda x: [(s.start, s.stop) for s in x]
        assert (r.pair_id, r.n_prefix, r.prompt, r.chosen, r.rejected, spans(r.chosen_loss), spans(r.rejected_loss)) == (i, *slow(a, b))
        for text, loss in ((r.chosen, r.chosen_loss), (r.rejected, r.rejected_loss)):
            assert all(text[s.start : s.stop].endswith(P.END) for s in loss)


def test_plan_is_native(spark):
    plan = P.format_pairs(spark.createDataFrame([], PAIR), chosen_col="a", rejected_col="b")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan.replace("ArrowConverters", "")
    assert P.format_pairs(spark.createDataFrame([], PAIR), chosen_col="a", rejected_col="b").collect() == []


def test_swapped_replies(spark):
    turns = [(0, 1, "assistant", "A"), (0, 0, "user", "Q"), (0, 2, "user", "more"), (1, 0, "user", "x"), (1, 1, "assistant", "B"), (2, 0, "user", "alone"), (3, None, "user", "n"), (None, 0, "user", "z"), (1, 1, "assistant", "B")]
    table = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, turns string")
    got = {r.conv_id: ([tuple(x) for x in r.chosen], [tuple(x) for x in r.rejected]) for r in P.swapped_replies(P.assembled(table)).collect()}
    assert got[0] == ([("user", "Q"), ("assistant", "A"), ("user", "more")], [("user", "Q"), ("assistant", "B")])
    assert got[1] == ([("user", "x"), ("assistant", "B"), ("assistant", "B")], [("user", "x"), ("assistant", "B"), ("assistant", "A")])
    assert got[2] == ([("user", "alone")], [("user", "alone")]) and set(got) == {0, 1, 2, 3}


@pytest.mark.parametrize("messy", [False, True])
def test_query_equals_sql(spark, tmp_path, messy):
    """Messy: turns that are null or tied, null roles and texts, repeated rows, and a turn of a million characters."""
    rng = random.Random(messy)
    rows = [(c, t, rng.choice(["user", "assistant"] + ["system", None] * messy), rng.choice(["hi", "é漢🙂", "a\nb"] + ["", None] * messy)) for c in range(60) for t in range(rng.randrange(1, 7)) if c % 7]
    if messy:
        rows += [(c, rng.choice([None, 0, 1, 2]), rng.choice(["user", "assistant", None]), rng.choice(["x", "", None])) for c in range(30) for _ in range(3)]
        rows += rows[5:15] + [(None, 0, "user", "nobody's"), (61, 0, "user", "long " * 200_000), (61, 1, "assistant", "yes")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries.op1_preferences(spark, str(tmp_path))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW conversations AS FROM read_parquet('{Path(tmp_path) / 'conversations.parquet'}/*.parquet')")
    want = db.sql(P.SQL)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.project(", ".join(names)).fetchall())


def test_null_turns_come_last(spark):
    turns = [(0, None, "user", "end"), (0, 3, None, "c"), (0, 3, "user", None), (0, 3, "user", "b"), (0, 1, "assistant", "a")]
    (row,) = P.assembled(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [tuple(t) for t in row.turns] == [(1, "assistant", "a"), (3, "user", "b"), (3, "user", None), (3, None, "c"), (None, "user", "end")]
