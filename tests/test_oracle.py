"""Every query with SQL gives what DuckDB gives on the same tables, types included."""

import glob
import os

import duckdb
import pytest

from xylem.plans.oracle import SQL
from xylem.plans.queries import QUERIES

DATA = "/root/testdata"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "array<int>": "INTEGER[]", "boolean": "BOOLEAN"}
#: No SQL can say these; test_vision.py holds them against images with known answers.
NO_SQL = {"image_pipeline", "kmeans_rings", "mock_ring_detection"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(rows, names):
    order = sorted(names)
    at = [names.index(n) for n in order]
    value = lambda v: "" if v is None else repr(round(v, 6) + 0.0) if isinstance(v, float) else str(list(v)) if isinstance(v, (list, tuple)) else str(v)
    return sorted(tuple(value(r[k]) for k in at) for r in rows)


def test_which_have_sql():
    assert set(QUERIES) - set(SQL) == NO_SQL and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_gives_what_sql_gives(spark, duck, name):
    df = QUERIES[name](spark, f"{DATA}/sf0.001")
    want = duck.sql(SQL[name])
    assert {k: TYPES[v] for k, v in df.dtypes} == dict(zip(want.columns, map(str, want.types)))
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)
