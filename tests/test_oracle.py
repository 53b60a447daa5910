"""Every registered query against its SQL at the smallest scale."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.compare import TABLES, compare

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, con, name):
    text, ok = compare(spark, con, name, SF)
    assert ok, text


def test_entry(spark):
    df = entry.entry(spark)
    assert {"id", "total", "has_next"} <= set(df.columns)
    assert df.count() <= 20
