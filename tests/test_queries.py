"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from lectern import queries as Q
from lectern import queries_files, queries_more, queries_streams, queries_tables  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    cols = sorted(frame.columns)
    return cols, sorted(map(repr, frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False, name=None)))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query(spark, duck, name):
    assert rows(Q.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(Q.SQL[name]).fetchdf())


def test_entry_imports_without_the_optional_part(monkeypatch):
    import importlib
    import sys

    for k in [k for k in sys.modules if k.startswith(("lectern.llm", "corpus_pipeline", "__spark_entry__"))]:
        monkeypatch.delitem(sys.modules, k)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.queries()) == set(Q.QUERIES)
    monkeypatch.delitem(sys.modules, "__spark_entry__")
