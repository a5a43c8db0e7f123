"""Every catalogue query against its SQL oracle, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from postloom.catalog import ORACLE_SQL, QUERIES

DIR = "/root/testdata/sf0.001"


def plain(rows, columns):
    def cell(v):
        if v is None or str(v) in ("nan", "NaT", "<NA>"):
            return "NULL"
        return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)

    return sorted(tuple(cell(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    rows = [r.asDict() for r in df.collect()]
    if name not in ORACLE_SQL:
        assert rows
        return
    cur = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert plain(rows, sorted(names)) == plain([dict(zip(names, r, strict=True)) for r in cur.fetchall()], sorted(names))
