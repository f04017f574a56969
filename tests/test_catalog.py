import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from alertmill.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return None
    if isinstance(value, dt.datetime):
        return str(pd.Timestamp(value))
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = rows(entry_module.queries()[name](spark, SF).toPandas())
    want = rows(duck.execute(entry_module.oracle_sql()[name]).df())
    assert got == want


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
