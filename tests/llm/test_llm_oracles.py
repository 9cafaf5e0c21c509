"""Queries with an SQL twin give the twin's rows, with repeats, on the small tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


def names():
    from terrafold.llm.registry import oracle

    return sorted(oracle())


@pytest.mark.parametrize("name", names())
def test_twin(spark, name):
    from terrafold.llm.registry import oracle, registered

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.sql(oracle()[name])
    got = registered()[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    cols = sorted(want.columns)
    key = lambda row: [(v is None, v if v is not None else 0) for v in row]
    a = sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key)
    b = sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=key)
    assert len(a) > 0 and a == b
