"""Every core query against its SQL, and on empty and odd tables."""

import datetime
import decimal
import glob
import os

import duckdb
import numpy as np
import pytest

from docweft import catalogue
from tests.fixtures import DATA, empty_tables, odd_tables

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    res = duck.execute(SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    # So small a table has no pair that is rescued.
    assert QUERIES[name](spark, DATA).count() > 0 or name == "rescued_candidates"


def test_equal_texts_of_all_scripts(spark, tmp_path):
    texts = ["Le salarié a  été licencié.", "LE SALARIÉ A ÉTÉ\u00a0LICENCIÉ. ", "Суд решил", "суд\u3000\nрешил", "“Quote” § 5", "“quote”  § 5", "İstanbul", "ΟΔΟΣ", "οδος", "οδοσ", "plain", " Plain", "", None]
    rows = [(len(texts) - k, t, f"c{k}") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, case_id string").write.parquet(f"{tmp_path}/documents.parquet")
    first = {}
    for doc, text, case in sorted(rows):
        if text is not None:
            first.setdefault(" ".join(text.split()).lower(), (doc, case))
    got = QUERIES["first_of_equal_texts_all"](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.case_id) for r in got) == sorted(first.values())


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    return empty_tables(tmp_path_factory.mktemp("empty"))


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return odd_tables(tmp_path_factory.mktemp("odd"))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"kmeans", "pca"}))
def test_empty_tables(spark, empty, name):
    QUERIES[name](spark, empty).collect()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"kmeans", "pca"}))
def test_odd_tables(spark, odd, name):
    QUERIES[name](spark, odd).collect()
