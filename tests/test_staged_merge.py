"""Merges in two phases: finished or taken back wherever they end; fingerprints of what they leave alone."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.functions.times import day_of
from clickloom.operators import staged_merge as staged
from clickloom.operators.fingerprint import compare_fingerprints, fingerprints, untouched
from clickloom.operators.staged_merge import settle_merges, staged_merge, undo_merge
from clickloom.schema import EVENT_DAY, EVENT_PARTITIONS
from clickloom.sources.loading import load_events
from helpers import rows_of

KEY = ["event_id", "collector_tstamp", "event_name"]
DAY = 86_400


@pytest.fixture
def table(spark, zones, make_events):
    rows = [{"event_id": str(i), "at": (i % 2) * DAY + i, "event_name": ["it's", "a/b c"][i % 2], "etl_tags": "old"} for i in range(6)]
    load_events(spark, make_events(rows), zones.events, "one")
    return zones.events


def merge(spark, zones, ids, tag):
    source = spark.table(zones.events).where(F.col("event_id").isin(ids)).select(*KEY)
    derive = {EVENT_DAY: day_of(F.col("collector_tstamp"))}
    return staged_merge(spark, zones.events, source, KEY, {"etl_tags": F.lit(tag)}, EVENT_PARTITIONS, f"{zones.manifest}.merges", derive)


def tags(spark, zones):
    return {r[0]: r[1] for r in spark.table(zones.events).select("event_id", "etl_tags").collect()}


def breaking_after(monkeypatch, switches):
    """The next merge or undo ends after so many switched partitions."""
    left, point = [switches], staged._point

    def one(*args):
        if not left[0]:
            raise RuntimeError("ended")
        left[0] -= 1
        point(*args)

    monkeypatch.setattr(staged, "_point", one)
    return lambda: monkeypatch.setattr(staged, "_point", point)


def test_ended_between_switches_and_undone(spark, zones, table, monkeypatch):
    log, before = f"{zones.manifest}.merges", rows_of(spark.table(table))
    assert merge(spark, zones, ["none"], "x") is None
    mend = breaking_after(monkeypatch, 1)
    with pytest.raises(RuntimeError):
        merge(spark, zones, ["0", "1"], "new")
    mend()
    assert len(settle_merges(spark, table, log)) == 1 and settle_merges(spark, table, log) == []
    assert tags(spark, zones) == {"0": "new", "1": "new", **dict.fromkeys("2345", "old")}
    first = spark.table(log).where("step = 'done'").first()["merge_id"]

    second = merge(spark, zones, ["1", "3"], "newer")
    with pytest.raises(ValueError):
        undo_merge(spark, table, first, log)  # a partition of it was switched again
    mend = breaking_after(monkeypatch, 0)
    with pytest.raises(RuntimeError):
        undo_merge(spark, table, second, log)
    mend()
    settle_merges(spark, table, log)
    assert undo_merge(spark, table, first, log) == 2
    assert rows_of(spark.table(table)) == before
    with pytest.raises(ValueError):
        undo_merge(spark, table, first, log)
    load_events(spark, spark.table(table).where("event_id <> '0'"), table, "one")  # a plain load goes on
    assert sorted(tags(spark, zones)) == list("12345")


def test_ended_before_the_log_leaves_the_table(spark, zones, table, monkeypatch):
    before = rows_of(spark.table(table))
    monkeypatch.setattr(staged, "_note", lambda *a: (_ for _ in ()).throw(RuntimeError("ended")))
    with pytest.raises(RuntimeError):
        merge(spark, zones, ["0"], "new")
    spark.catalog.refreshTable(table)
    assert rows_of(spark.table(table)) == before


def test_fingerprints_see_one_changed_cell(spark, zones, table):
    rows = spark.table(table)
    source = rows.where("event_id = '0'").select(*KEY)
    old = fingerprints(untouched(rows, source, KEY), [EVENT_DAY])

    def same(after):
        found = compare_fingerprints(old, fingerprints(untouched(after, source, KEY), [EVENT_DAY]), [EVENT_DAY])
        return sorted((r["rows_old"], r["rows_new"], r["same"]) for r in found.collect())

    def where(event_id, column, value):
        return rows.withColumn(column, F.when(F.col("event_id") == event_id, F.lit(value)).otherwise(F.col(column)))

    assert same(rows.orderBy(F.desc("event_id"))) == [(2, 2, True), (3, 3, True)]
    assert same(where("0", "etl_tags", "new")) == [(2, 2, True), (3, 3, True)]
    assert same(where("2", "etl_tags", "new")) == [(2, 2, False), (3, 3, True)]
    assert same(rows.where("event_id <> '1'")) == [(2, 2, True), (3, 2, False)]
    assert same(where("1", EVENT_DAY, None)) == [(0, 1, False), (2, 2, True), (3, 2, False)]
    moved = rows.withColumn("page_url", F.when(F.col("event_id") == "3", F.col("etl_tags"))).withColumn("etl_tags", F.when(F.col("event_id") != "3", F.col("etl_tags")))
    assert same(moved) == [(2, 2, True), (3, 3, False)]
