"""What the physical plans have to look like."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from clickloom.operators.audit import file_inventory
from clickloom.operators.clone import CloneSchedule, clone_batches
from clickloom.operators.filters import in_list, in_partition, keep_keys, on_day
from clickloom.operators.merge import updated
from clickloom.plans import models
from clickloom.plans.refresh import _sessions_with_copies
from clickloom.schema import BATCH_ID, EVENT_DAY, EVENT_PARTITIONS
from clickloom.sources.loading import load_events
from clickloom.sources.tables import partition_filter
from helpers import START, rows_of


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture
def events(spark, zones, make_events):
    rows = [{"event_id": str(i), "at": 86_400 * (i % 3), "domain_sessionid": f"s{i % 4}"} for i in range(12)]
    load_events(spark, make_events(rows), zones.events, "one")
    return spark.table(zones.events)


def read_schema(text: str) -> str:
    return "\n".join(line for line in text.splitlines() if line.startswith("ReadSchema"))


def partition_filters(text: str) -> str:
    return "\n".join(line for line in text.splitlines() if line.startswith("PartitionFilters"))


def test_partition_filters_reach_the_scan(events):
    day = date(2024, 3, 2)
    for condition in (
        in_partition(day, "page_view"),
        on_day("collector_tstamp", day, "collector_tstamp"),
        partition_filter([EVENT_DAY], events.select(EVENT_DAY).distinct().collect()),
    ):
        found = events.where(condition).select("event_id")
        assert EVENT_DAY in partition_filters(plan(found))
        assert "page_url" not in read_schema(plan(found))
    assert events.where(on_day("collector_tstamp", day, "collector_tstamp")).count() == 4
    assert events.where(on_day("load_tstamp", day, "collector_tstamp")).count() == 4
    values = events.select(*EVENT_PARTITIONS).distinct().collect()
    assert events.where(partition_filter(EVENT_PARTITIONS, values[:1])).count() == 4
    assert events.where(partition_filter(EVENT_PARTITIONS, values)).count() == 12
    assert events.where(partition_filter(EVENT_PARTITIONS, [])).count() == 0


def test_models_read_only_their_columns_and_stay_in_the_jvm(events):
    text = plan(models.activity_of(events))
    assert "useragent" not in read_schema(text) and "page_url" in read_schema(text)
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text
    # one shuffle to remove duplicates, one to aggregate; rows without an id skip the first
    assert text.count("Exchange\n") - text.count("BroadcastExchange\n") <= 4


def test_the_search_for_copies_reads_two_columns(events):
    batch = models.model_events(events.where(F.col(BATCH_ID) == "two"))
    others = models.model_events(events)
    text = read_schema(plan(_sessions_with_copies(others, batch)))
    assert "page_url" not in text and "contexts" not in text


def test_cloning_moves_no_rows(make_events):
    rows = make_events([{"event_id": "a"}])
    text = plan(clone_batches(rows, CloneSchedule(3, START, START)))
    assert "Exchange" not in text and "Join" not in text


def test_inventory_reads_no_column(events):
    text = read_schema(plan(file_inventory(events, EVENT_PARTITIONS)))
    assert "event_id" not in text


def test_merge_reads_the_target_once_without_sorting_all_of_it(spark, events):
    source = spark.createDataFrame([("1",)], "event_id string")
    text = plan(updated(events.where(in_partition(date(2024, 3, 2), "page_view")), source, ["event_id"], {"etl_tags": F.lit("x")}))
    assert text.count("Scan parquet") <= 2 and EVENT_DAY in partition_filters(text)


def test_in_list_by_any_means(spark, events):
    short = in_list(events, "event_id", ["1", "2", "x"])
    long = in_list(events, "event_id", [str(i) for i in range(1, 3)] + [f"x{i}" for i in range(2000)])
    numbers = [in_list(events, "event_id", v) for v in ([1, 2], list(range(1, 3)) + list(range(10**6, 10**6 + 2000)))]
    assert rows_of(numbers[0]) == rows_of(numbers[1]) == rows_of(short)
    joined = in_list(events, "event_id", spark.createDataFrame([("1",), ("2",), ("2",)], "k string"))
    assert rows_of(short) == rows_of(long) == rows_of(joined)
    assert "event_id" in [l for l in plan(short).splitlines() if l.startswith("PushedFilters")][0]


def test_many_keys_are_found_through_their_hashes(spark, events):
    keys = spark.createDataFrame([("1",), ("2",), ("none",)], "event_id string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hashed = keep_keys(events, keys, "event_id", 3, few=1)
        shuffled = keep_keys(events, keys, "event_id", 3, few=1, hashed=2)
        assert "BroadcastHashJoin" in plan(hashed) and "BroadcastHashJoin" not in plan(shuffled)
        assert rows_of(hashed) == rows_of(shuffled) and hashed.count() == 2
        assert hashed.columns == shuffled.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
