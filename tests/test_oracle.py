"""Every registered query of the core against its oracle SQL in DuckDB, at sf 0.001."""

import os

import duckdb
import pytest

from weftgraph import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    if v is None:
        return "\0"
    if isinstance(v, float):
        return f"{v:.9g}"
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert rows
    if name in catalogue.ORACLES:
        r = duck.sql(catalogue.ORACLES[name])
        assert sorted(r.columns) == cols
        at = [r.columns.index(c) for c in cols]
        assert rows == sorted(tuple(norm(x[i]) for i in at) for x in r.fetchall())
