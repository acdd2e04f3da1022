from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from contract import queries
from contract.oracles import ORACLES
from contract.queries import QUERIES
from check_oracles import compare, duckdb_tables

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SF_DIR)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query_agrees_with_its_sql(spark, con, name):
    assert compare(spark, con, name, SF_DIR) == ""


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_a_large_stream_has_more_files_and_the_same_sessions(spark, con, monkeypatch):
    monkeypatch.setattr(queries, "STREAMED_ROWS", 250)
    files = queries.new_path(spark)
    queries.write_stream(queries.events(spark, SF_DIR), files)
    rows = [r["count"] for r in spark.read.parquet(files).groupBy(F.input_file_name()).count().collect()]
    assert len(rows) > 5 and max(rows) < sum(rows) // 3
    assert compare(spark, con, "streamed_sessions", SF_DIR) == ""
