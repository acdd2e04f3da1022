from __future__ import annotations

import json

import pytest

from clickloom.sources.quarantine import LoadReport, load_or_reject, route

SCHEMA = "event_id string, Collector_Tstamp string, event_name string, tr_total string, br_colordepth string, domain_sessionidx bigint, note string"
GOOD = ("1", "2024-03-01 12:00:00", "view", "1.5", "deep", 3, "x")
ROWS = [
    GOOD,
    ("2", "2024-03-01T12:00:00+02:00", None, None, None, None, None),
    ("3", "soon", "view", "n/a", "24", 1, "kept as it was"),
    ("4", "2024-03-01 12:00:00", "view", "", None, 2**40, None),
    ("5", None, "view", " 2 ", None, -1, None),
    (None, "2024-03-01 12:00:00", "view", "x", None, None, None),
]


@pytest.fixture
def make(spark):
    return lambda rows: spark.createDataFrame(rows, SCHEMA)


def rejects(spark, zones):
    found = spark.table(zones.rejects).select("event_id", "column_name", "text", "batch_id").collect()
    return sorted((r.event_id or "", r.column_name, r.text, r.batch_id) for r in found)


def test_unreadable_values_leave_the_batch_with_their_rows(spark, zones, make):
    assert load_or_reject(spark, make(ROWS), zones, "b0") == LoadReport(6, 3, 3, 5)
    assert rejects(spark, zones) == [
        ("", "tr_total", "x", "b0"),
        ("3", "collector_tstamp", "soon", "b0"),
        ("3", "tr_total", "n/a", "b0"),
        ("4", "domain_sessionidx", str(2**40), "b0"),
        ("4", "tr_total", "", "b0"),
    ]
    kept = {r.event_id: r for r in spark.table(zones.events).collect()}
    assert sorted(kept) == ["1", "2", "5"]
    assert kept["1"].tr_total == 1.5 and kept["1"].br_colordepth is None and kept["5"].tr_total == 2.0
    assert kept["2"].collector_tstamp.isoformat() == "2024-03-01T10:00:00"
    row = spark.table(zones.rejects).where("event_id = '3'").first()["source_row"]
    assert json.loads(row)["note"] == "kept as it was" and json.loads(row)["Collector_Tstamp"] == "soon"


def test_batch_that_is_loaded_again_replaces_rows_and_rejects(spark, zones, make):
    load_or_reject(spark, make(ROWS), zones, "b0")
    load_or_reject(spark, make(ROWS[2:3]), zones, "b1")
    assert load_or_reject(spark, make([GOOD]), zones, "b0") == LoadReport(1, 1, 0, 0)
    assert {r[3] for r in rejects(spark, zones)} == {"b1"}
    assert [r.event_id for r in spark.table(zones.events).collect()] == ["1"]
    assert load_or_reject(spark, make([]), zones, "b1") == LoadReport(0, 0, 0, 0)
    assert rejects(spark, zones) == []


def test_names_that_differ_in_case_and_sources_without_doubtful_columns(spark):
    with pytest.raises(ValueError, match="differ only in case"):
        route(spark.createDataFrame([("1", "2")], "event_id string, EVENT_ID string"))
    plain = route(spark.createDataFrame([("1",)], "event_id string"))
    assert plain.first()["_rejected"] == [] and plain.first()["_source_row"] is None
