from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from clickloom.operators import audit
from clickloom.operators.merge import before_image, keyed_rows, merge_update
from clickloom.plans.probe import merge_probe
from clickloom.schema import EVENT_DAY, EVENT_PARTITIONS
from clickloom.session import Scratch
from clickloom.sources.loading import load_events
from helpers import START, rows_of

KEY = ["event_id", "collector_tstamp", "event_name"]
KEY_DDL = "event_id STRING, collector_tstamp TIMESTAMP_NTZ, event_name STRING"
DAY = 86_400


@pytest.fixture
def table(spark, zones, make_events):
    rows = [
        {"event_id": f"e{i}", "at": DAY * (i % 3), "event_name": ["page_view", "it's", None][i % 4 % 3]}
        for i in range(24)
    ]
    load_events(spark, make_events(rows), zones.events, "one")
    return zones.events


def merge(spark, table, source, value="tag"):
    return merge_update(
        spark, table, source, KEY, {"etl_tags": F.lit(value)}, EVENT_PARTITIONS, {EVENT_DAY: F.to_date("collector_tstamp")}
    )


def inventory(spark, table):
    return audit.file_inventory(spark.table(table), EVENT_PARTITIONS)


def paths(spark, table):
    return {r.path: tuple(r.partition) for r in inventory(spark, table).collect()}


def test_only_the_matched_partition_is_rewritten(spark, table):
    before_rows = {r.event_id: r for r in spark.table(table).collect()}
    with Scratch(spark) as scratch:
        before = scratch.save(inventory(spark, table), "before")
        old = paths(spark, table)
        source = keyed_rows(spark, [("e1", datetime(2024, 3, 2, 12), "it's"), ("none", START, "page_view")], KEY_DDL)
        touched = merge(spark, table, source)
        assert [tuple(r) for r in touched] == [(date(2024, 3, 2), "it's", "one")]
        new = paths(spark, table)
        assert {old[p] for p in set(old) - set(new)} == {new[p] for p in set(new) - set(old)} == {tuple(touched[0])}
        target = (F.col("partition.event_day") == F.lit(date(2024, 3, 2))) & (F.col("partition.event_name") == "it's")
        report = audit.audit_partitions(before, inventory(spark, table), target).first()
        assert report["pass"] and report.touched_outside_target == 0
        stray = audit.audit_partitions(before, inventory(spark, table), F.col("partition.event_name") == "page_view")
        assert not stray.first()["pass"]
    after = {r.event_id: r for r in spark.table(table).collect()}
    assert set(after) == set(before_rows)
    for event_id, row in after.items():
        expected = before_rows[event_id].asDict()
        if event_id == "e1":
            expected["etl_tags"] = "tag"
        assert row.asDict() == expected


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [("e1", datetime(2030, 1, 1), "it's")],  # partition absent from the target
        [("e99", datetime(2024, 3, 2, 12), "it's")],  # partition there, no key match
        [("e2", datetime(2024, 3, 3, 12), None)],  # a NULL in the key never matches
        [(None, datetime(2024, 3, 2, 12), "it's")],
    ],
)
def test_a_merge_of_nothing_changes_nothing(spark, table, rows):
    old = paths(spark, table)
    assert merge(spark, table, keyed_rows(spark, rows, KEY_DDL)) == []
    assert paths(spark, table) == old
    same = inventory(spark, table)
    assert not audit.audit_partitions(same, same, F.lit(True)).first()["pass"]


def test_a_repeated_source_key_is_an_error(spark, table):
    row = ("e1", datetime(2024, 3, 2, 12), "it's")
    with pytest.raises(ValueError, match="more than one row"):
        merge(spark, table, keyed_rows(spark, [row, row], KEY_DDL))
    nulls = keyed_rows(spark, [(None, None, None)] * 2, KEY_DDL)
    assert merge(spark, table, nulls) == []


def test_values_may_come_from_the_source(spark, table):
    source = keyed_rows(spark, [("e0", START, "page_view", 5)], KEY_DDL + ", n INT")
    merge_update(
        spark, table, source, KEY, {"etl_tags": F.col("s.n") + 1, "app_id": F.col("t.event_id")}, EVENT_PARTITIONS,
        {EVENT_DAY: F.to_date("collector_tstamp")},
    )
    changed = spark.table(table).where("etl_tags IS NOT NULL").select("event_id", "etl_tags", "app_id").collect()
    assert changed == [("e0", "6", "e0")]
    with pytest.raises(ValueError, match="cannot change"):
        merge_update(spark, table, source, KEY, {"event_name": F.lit("x")}, EVENT_PARTITIONS)


def test_merge_without_derived_day_still_finds_its_partitions(spark, table):
    source = keyed_rows(spark, [("e1", datetime(2024, 3, 2, 12), "it's")], KEY_DDL)
    touched = merge_update(spark, table, source, KEY, {"etl_tags": F.lit("x")}, EVENT_PARTITIONS)
    assert [tuple(r) for r in touched] == [(date(2024, 3, 2), "it's", "one")]


def test_before_image(spark, table):
    merge(spark, table, keyed_rows(spark, [("e1", datetime(2024, 3, 2, 12), "it's")], KEY_DDL), "old")
    keys = keyed_rows(spark, [("e1", datetime(2024, 3, 2, 12), "it's"), ("e99", START, "it's")], KEY_DDL)
    image = before_image(spark.table(table), keys, KEY, ["etl_tags"])
    assert [tuple(r) for r in image.select("event_id", "etl_tags").collect()] == [("e1", "old")]


FILES = [  # day, name, path, rows, status, content
    (1, "a", "p1", 5, 1, 0),
    (1, "a", "p2", 5, 0, 0),
    (1, "b", "p3", 10, 1, 0),
    (2, "a", "p4", 3, 2, 0),
    (2, "a", "p5", 20, 1, 0),
    (2, "b", "p6", 1, 1, 1),
]
FILE_DDL = "partition STRUCT<day: INT, event_name: STRING>, path STRING, record_count BIGINT, status INT, content INT"


def files(spark, rows):
    return spark.createDataFrame([((d, n), *rest) for d, n, *rest in rows], FILE_DDL)


def test_partition_statistics_and_ties(spark):
    found = files(spark, FILES)
    stats = {tuple(r.partition): (r.rows, r.files) for r in audit.partition_stats(found).collect()}
    assert stats == {(1, "a"): (10, 2), (1, "b"): (10, 1), (2, "a"): (20, 1)}
    assert tuple(audit.smallest_partition(found).first().partition) == (1, "a")
    assert {r.path for r in audit.live_files(found).collect()} == {"p1", "p2", "p3", "p5", "p6"}


def test_audit_sees_deletes_and_details(spark):
    before = files(spark, FILES)
    after = files(spark, [*FILES[1:], (1, "a", "p1", 5, 2, 0), *[(1, "a", f"q{i:02d}", 1, 1, 0) for i in range(30)]])
    inside = F.col("partition.day") == 1
    report = audit.audit_partitions(before, after, inside).first()
    assert tuple(report) == (30, 1, 31, 0, True)
    details = audit.audit_details(before, after, inside)
    assert [r.path for r in details["added_detail"].collect()] == [f"q{i:02d}" for i in range(30)]
    assert [r.path for r in details["removed_detail"].collect()] == ["p1"]
    assert details["outside_target"].count() == 0
    outside = audit.audit_partitions(before, after, F.col("partition.event_name") == "zz").first()
    assert outside.touched_outside_target == 31 and not outside["pass"]


def test_inventory_counts_rows(spark, table):
    found = audit.partition_stats(inventory(spark, table)).collect()
    assert sum(r.rows for r in found) == 24
    sample = audit.sample_partition(spark.table(table), F.col("event_name") == "it's", 3)
    assert rows_of(sample.select("event_id")) == rows_of(sample.select("event_id"))
    assert sample.count() == 3


def test_probe_marks_the_smallest_partition_only(spark, zones, make_events):
    with pytest.raises(ValueError, match="no partition"):
        merge_probe(spark, zones)
    rows = [{"event_id": str(i), "at": i, "event_name": "a" if i < 3 else "b", "etl_tags": "old"} for i in range(20)]
    load_events(spark, make_events(rows), zones.events, "b0")
    with pytest.warns(UserWarning, match="fewer than 10"):
        report = merge_probe(spark, zones)
    assert report.rows == 3 and report.audit["pass"] and report.partition["event_name"] == "a"
    tags = {r.event_id: r.etl_tags for r in spark.table(zones.events).collect()}
    assert tags == {str(i): "probe" if i < 3 else "old" for i in range(20)}
    kept = spark.table(f"{zones.manifest}.probe_before").where(F.col("probe_id") == report.probe_id)
    assert sorted((r.event_id, r.etl_tags) for r in kept.collect()) == [("0", "old"), ("1", "old"), ("2", "old")]
