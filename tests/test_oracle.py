"""Every registered query against its SQL answer on the same tables."""

import math

import duckdb
import pandas as pd
import pytest
from conftest import SF_DIR

import __spark_entry__ as entry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return bool(value)
    if isinstance(value, (int, float)) or hasattr(value, "dtype"):
        number = float(value)
        return round(number, 9) + 0.0 if math.isfinite(number) else None
    return str(value)


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted((tuple(plain(v) for v in r) for r in pdf.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_sql(spark, duck, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got) > 0
        return
    want = duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
