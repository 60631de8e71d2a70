"""Every named query runs; those with SQL give its rows."""

import os

import pytest

from fedrank.plans import oracle
from fedrank.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(row):
    return tuple(round(v, 6) if isinstance(v, float) else v for v in row)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")

    def connect(folder):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        return con

    return connect


#: Those over pages again on a larger table, which has characters that the smaller lacks.
CASES = [(name, DATA) for name in QUERIES] + [(name, LARGER) for name in QUERIES if name.startswith(("url", "source", "text", "extracted"))]


@pytest.mark.parametrize("name, folder", CASES)
def test_query(name, folder, spark, duck):
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    got = sorted(map(plain, df.select(*columns).collect()), key=repr)
    assert got
    if name in oracle.ORACLE:
        rel = duck(folder).sql(oracle.ORACLE[name])
        assert sorted(rel.columns) == columns
        assert sorted(map(plain, rel.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr) == got


def test_entry_and_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(QUERIES) <= set(entry.queries())
