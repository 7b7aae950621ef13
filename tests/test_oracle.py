"""Queries held to their SQL in DuckDB on the smallest tables, one or two of each family."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver

FOLDER = "/root/testdata/sf0.001"
NAMES = ["val1", "val7", "val11", "val20", "val25", "aud2", "aud4_stops", "mut3", "mut4", "mut12", "mut19", "rte3", "rte6", "rte9", "flt4", "flt9", "join6", "join7", "agg5", "agg7", "win5", "win7", "srt1", "sug4", "grd1", "grd5", "grd6", "geo3", "src10", "gph2_matches"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


def plain(df: pd.DataFrame) -> list:
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(value(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, db, name):
    assert plain(driver.queries()[name](spark, FOLDER).toPandas()) == plain(db.sql(driver.oracle_sql()[name]).df())


def test_registry_is_consistent(spark):
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).columns == ["to_place_id", "cost"]
