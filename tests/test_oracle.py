"""Every query that has SQL, against DuckDB on the same tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402
from tracelake import queries, queries_functions, queries_ingest  # noqa: E402, F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def normal(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        return (1, "nan" if math.isnan(v) else repr(round(v, 9) + 0.0))
    return (1, str(v))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in sorted(os.listdir(DATA)):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(queries.ORACLE[name])
    theirs = [d[0] for d in want.description]
    assert sorted(theirs) == columns
    at = [theirs.index(c) for c in columns]
    assert sorted(tuple(normal(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(normal(r[i]) for i in at) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
