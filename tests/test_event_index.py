"""The index of event ids: no id is missed, few are taken for others, and a refresh reads no other day."""

from __future__ import annotations

from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from clickloom.plans import event_index
from clickloom.plans.event_index import SOURCE, filters_of, id_hash, possible_days, possible_places
from clickloom.plans.refresh import refresh
from clickloom.schema import EVENT_DAY
from clickloom.sources.loading import load_events
from helpers import rows_of

DAY = 86_400


def ids_of(spark, first, count, day, source="a"):
    return spark.range(first, first + count).select(
        F.col("id").cast("string").alias("event_id"), F.lit(day).cast("date").alias(EVENT_DAY), F.lit(source).alias(SOURCE)
    )


def test_no_id_is_missed_and_few_are_taken_for_others(spark):
    held = ids_of(spark, 0, 30_000, "2024-01-01").unionByName(ids_of(spark, 50_000, 3, None, "b")).unionByName(ids_of(spark, 7, 1, "2024-01-02", "b"))
    held = held.unionByName(spark.createDataFrame([(None, None, "b")], "event_id string, event_day date, source string"))
    index = filters_of(held).cache()
    assert index.where(F.length("bitmap") != 4096).count() == 0 and index.groupBy("blocks").count().count() == 2
    found = possible_places(index, held, 30_005)
    want = held.where("event_id IS NOT NULL").select(id_hash(F.col("event_id")).alias("hash"), EVENT_DAY, SOURCE)
    assert want.distinct().exceptAll(found.distinct()).count() == 0
    strangers = ids_of(spark, 10**6, 100_000, None)
    assert possible_places(index, strangers, 10**9).count() <= 5  # this many ids are not broadcast
    assert [r[0].isoformat() for r in possible_days(index, ids_of(spark, 20_000, 1, None), 1).collect()] == ["2024-01-01"]
    assert possible_days(index.limit(0), strangers, 1).count() == 0


def test_filters_are_not_shuffled(spark):
    index = filters_of(ids_of(spark, 0, 100, "2024-01-01")).cache()
    plan = possible_days(index, ids_of(spark, 0, 10, None), 10)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_a_refresh_reads_no_other_day(spark, zones, make_events):
    """Files of a day that has nothing to do with a batch are spoiled, so that reading them would fail."""
    old = [{"event_id": f"{d}-{i}", "at": d * DAY, "domain_sessionid": f"s{d}-{i % 2}", "domain_userid": f"u{d}"} for d in range(3) for i in range(4)]
    load_events(spark, make_events(old), zones.events, "old")
    refresh(spark, zones, "old")
    load_events(spark, make_events([{"event_id": "1-1", "at": DAY - 9, "domain_sessionid": "s1-9"}]), zones.events, "two")
    refresh(spark, zones, "two")  # has indexed the old batch
    for path in spark.table(zones.events).where(F.col(EVENT_DAY) == F.lit("2024-03-03").cast("date")).inputFiles():
        Path(urlparse(path).path).write_bytes(b"spoiled")
    spark.catalog.refreshTable(zones.events)
    # a better copy of an event in another session, and a further event of an old session
    new = [{"event_id": "0-1", "at": -5, "domain_sessionid": "s9"}, {"event_id": "n", "at": DAY + 7, "domain_sessionid": "s1-0"}]
    load_events(spark, make_events(new), zones.events, "three")
    refresh(spark, zones, "three")
    events = {r[0]: r[1] for r in spark.table(zones.sessions).select("domain_sessionid", "events").collect()}
    assert events == {"s0-0": 2, "s0-1": 1, "s1-0": 3, "s1-1": 1, "s2-0": 2, "s2-1": 2, "s1-9": 1, "s9": 1}
    assert len(rows_of(spark.table(zones.sessions))) == 8


def test_many_ids_are_tested_without_a_row_per_filter(spark, monkeypatch):
    """Ids and filters cut into pieces: the same places as by the join with broadcast ids."""
    held = ids_of(spark, 0, 5_000, "2024-01-01")
    for number in range(8):
        held = held.unionByName(ids_of(spark, 100 * number, 60, f"2024-01-{number + 2:02d}", f"b{number % 3}"))
    held = held.unionByName(ids_of(spark, 40, 20, None, "none"))
    index = filters_of(held).localCheckpoint()
    ids = ids_of(spark, 0, 7_000, None)
    want = sorted(map(tuple, possible_places(index, ids, 7_000).collect()), key=repr)
    for name, value in {"JOINED_TESTS": 0, "IDS_AT_ONCE": 1_000, "FILTERS_AT_ONCE": 3}.items():
        monkeypatch.setattr(event_index, name, value)
    places = possible_places(index, ids, 7_000)
    plan = places._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    assert sorted(map(tuple, places.collect()), key=repr) == want and len(want) >= 5_500
