"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from sparkloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def flat(x):
    """Numbers as text, alike whether they are integers, doubles or decimals."""
    if x is None or isinstance(x, bool):
        return str(x)
    try:
        return format(float(x), ".9g") if not isinstance(x, str) else x
    except TypeError:
        return str(x)


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted((tuple(map(flat, r)) for r in df.select(columns).collect()), key=str)
    if name not in catalog.SQL:
        again = catalog.QUERIES[name](spark, DIR).select(columns)
        assert got and got == sorted((tuple(map(flat, r)) for r in again.collect()), key=str)
        return
    rel = duck.execute(catalog.SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == columns
    want = sorted((tuple(flat(r[names.index(c)]) for c in columns) for r in rel.fetchall()), key=str)
    assert got == want


def test_sql_belongs_to_queries():
    assert set(catalog.SQL) <= set(catalog.QUERIES)
