import importlib.util

import duckdb
import pytest

import __spark_entry__ as e

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DIR}/documents.parquet'")
    return con


OWN = [k for k in __import__("quillspark.queries", fromlist=["x"]).oracle_sql()]


@pytest.mark.parametrize("name", OWN)
def test_query_equals_its_sql(spark, db, name):
    got = e.queries()[name](spark, DIR).toPandas()
    want = db.execute(e.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.round(6).astype(str).equals(b.round(6).astype(str))


def test_entry(spark):
    assert e.entry(spark).count() == 10


def test_every_operator_has_its_query():
    names = list(e.queries())
    if importlib.util.find_spec("quillspark.llm"):
        for n in range(1, 14):
            assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert set(e.oracle_sql()) <= set(names)
