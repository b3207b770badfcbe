"""Every query of the subpackage on empty and odd tables, and against its SQL."""

import glob
import os

import duckdb
import pytest

from docweft.llm import queries
from tests.fixtures import DATA, empty_tables, odd_tables

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp("odd"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    assert QUERIES[name](spark, empty).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_tables(spark, odd, name):
    rows = QUERIES[name](spark, odd).collect()
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
        assert all(v is not None for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = QUERIES[name](spark, DATA)
    res = con.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(res.fetchall())
