"""Refresh by files: whatever becomes of the files, the tables equal a build."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.plans import file_refresh
from clickloom.plans.build import build
from clickloom.plans.file_refresh import held_files, refresh_files, table_files
from clickloom.schema import EVENT_DAY
from clickloom.sources.loading import append_normalized, normalize_into
from clickloom.sources.tables import drop_partitions, overwrite_partitions
from helpers import rows_of

DAY = 86_400
KEYS = [EVENT_DAY, "event_name"]


def rows(first, count, **more):
    return [
        {"event_id": str(i), "at": (i % 3) * DAY + i, "pv": f"p{i % 2}", "domain_sessionid": f"s{i % 4}", "domain_userid": f"u{i % 2}", **more}
        for i in range(first, first + count)
    ]


def results(spark, zones):
    return [rows_of(spark.table(t)) for t in (zones.page_views, zones.sessions, zones.users)]


def test_files_added_dropped_and_rewritten(spark, zones, make_events, monkeypatch):
    spark.sql(f"DROP TABLE {zones.events}")
    early = rows(20, 6, event_name="page_ping", domain_sessionid="s9")
    normalize_into(make_events(rows(0, 20) + early), zones.events)
    assert refresh_files(spark, zones)["removed"] == 0
    assert refresh_files(spark, zones) == {"added": 0, "removed": 0}

    # copies of old events that win or lose, new events, and a partition whose copies go
    append_normalized(make_events(rows(20, 12) + [{"event_id": "3", "at": -50, "domain_sessionid": "s7"}]), zones.events)
    days = spark.table(zones.events).where("event_name = 'page_ping'").select(*KEYS).distinct().collect()
    drop_partitions(spark, zones.events, KEYS, days)
    counts = refresh_files(spark, zones)
    assert counts["added"] >= 3 and counts["removed"] == len(days)
    got = results(spark, zones)
    files = table_files(spark.table(zones.events)).drop(EVENT_DAY)
    assert rows_of(held_files(spark, zones).drop("run")) == rows_of(files)
    build(spark, zones)
    assert results(spark, zones) == got

    # one partition rewritten without some events; a run that ends in the middle, then the next one
    part = spark.table(zones.events).where((F.col("event_name") == "page_view") & (F.col(EVENT_DAY) == F.lit("2024-03-02").cast("date")))
    overwrite_partitions(part.where("event_id <> '4'"), zones.events, KEYS)
    append_normalized(make_events(rows(40, 5)), zones.events)
    real = file_refresh._end
    monkeypatch.setattr(file_refresh, "_end", lambda *a: (_ for _ in ()).throw(RuntimeError("ended")))
    with pytest.raises(RuntimeError):
        refresh_files(spark, zones)
    monkeypatch.setattr(file_refresh, "_end", real)
    append_normalized(make_events(rows(50, 2)), zones.events)
    refresh_files(spark, zones)
    assert refresh_files(spark, zones) == {"added": 0, "removed": 0}
    got = results(spark, zones)
    build(spark, zones)
    assert results(spark, zones) == got
