"""The driver's entry, with and without the training-data subpackage."""

import sys

import duckdb

import __spark_entry__

DATA = "/root/testdata"


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_of_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    names = set(__spark_entry__.queries())
    assert "sobel_rings" in names and "pipeline" not in names and not any(n.startswith("op") for n in names)
    assert set(__spark_entry__.oracle_sql()) <= names


def test_nothing_else_imports_it():
    import os
    import re

    root = os.path.dirname(os.path.abspath(__spark_entry__.__file__))
    for folder, _, files in os.walk(f"{root}/xylem"):
        for f in files:
            if f.endswith(".py") and "/llm" not in folder:
                assert not re.search(r"xylem\.llm|corpus_pipeline", open(f"{folder}/{f}").read())


def test_subpackage_sql(spark):
    """What the subpackage has SQL for gives the same."""
    both = [n for n in __spark_entry__.oracle_sql() if n.startswith("op")]
    c = duckdb.connect()
    c.sql(f"create view pages as select * from '{DATA}/sf0.001/pages.parquet'")
    for n in both:
        want = c.sql(__spark_entry__.oracle_sql()[n])
        got = __spark_entry__.queries()[n](spark, f"{DATA}/sf0.001").select(*want.columns)
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.fetchall())))
