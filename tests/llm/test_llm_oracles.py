"""Queries with SQL against it, on the smallest tables."""

from __future__ import annotations

import pytest

from check_oracles import compare, duckdb_tables
from clickloom.llm.oracles import ORACLES
from clickloom.llm.queries import QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, duckdb_tables(SF_DIR), name, SF_DIR) == ""


@pytest.mark.parametrize("name", ["op6_secret_scan", "op10_chat_windows", "op4_minimax_shards"])
def test_native_queries_cover_their_table(spark, name):
    found = QUERIES[name](spark, SF_DIR)
    table, more = ("conversations", 1) if name.startswith("op10") else ("documents", 0)
    key = found.columns[0]
    assert found.count() == spark.read.parquet(f"{SF_DIR}/{table}.parquet").select(key).distinct().count() + more
