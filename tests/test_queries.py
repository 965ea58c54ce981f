"""Every registered query with a SQL check, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, compare

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, con, name):
    status, _, _, note = compare(spark, con, SF, name)
    assert status in ("ok", "rows-only"), note


def test_entry(spark):
    assert entry.entry(spark).columns == ["video_id", "chapters", "segments", "mean_tokens"]


def test_checks_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
