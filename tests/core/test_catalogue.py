import duckdb
import pytest

from timberline.plans.catalogue import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as from '/root/testdata/sf0.01/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, con, name):
    got = QUERIES[name](spark, "/root/testdata/sf0.01")
    rows = [tuple(map(plain, r)) for r in got.collect()]
    if name not in ORACLES:
        assert rows
        return
    want = con.sql(ORACLES[name])
    assert sorted(want.columns) == sorted(got.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(rows, key=str) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
