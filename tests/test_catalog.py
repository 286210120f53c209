"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from sievewright.plans import catalog

TABLES = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in TABLES.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS FROM '{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return round(v, 6) if isinstance(v, float) else v


def test_each_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, db, name):
    got = catalog.QUERIES[name](spark, str(TABLES))
    want = db.sql(catalog.ORACLES[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    left = sorted((tuple(map(plain, r)) for r in got.select(*names).collect()), key=repr)
    right = sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
    assert left == right


def test_scores_at_the_threshold(spark, db, tmp_path):
    """Three videos of sixty copies of sf0.1's events, where a frame outside the sample has the score that lies between two of the sample."""
    db.sql(f"""COPY (SELECT event_id + 100000 * i AS event_id, ts, user_id + 100000 * i AS user_id, event_type, value, props FROM '{TABLES.parent}/sf0.1/events.parquet'
        JOIN (VALUES (31, 789), (46, 710), (51, 1150)) v(i, u) ON user_id = u) TO '{tmp_path}/events.parquet'""")
    got = catalog.QUERIES["auto_gated_frames"](spark, str(tmp_path)).select("video", "frame_index", "reason").collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    want = con.sql(f"SELECT video, frame_index, reason FROM ({catalog.ORACLES['auto_gated_frames']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 150
