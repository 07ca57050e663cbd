"""Every core query against its SQL on the smallest tables."""

import os

import pytest

from corpuslake.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    return con


def rows_of(columns, rows):
    def one(v):
        if v is None or v != v:
            return "NULL"
        if isinstance(v, float):
            return f"{v + 0.0:.9g}"
        return str(list(v)) if isinstance(v, (list, tuple)) else str(v)

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in got.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(set(got.columns)) == len(got.columns) and rows
        assert any(v is not None for r in rows for v in r)
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows_of(got.columns, rows) == rows_of(names, want.fetchall())
