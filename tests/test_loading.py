from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clickloom.operators.verify import verify, verify_count
from clickloom.schema import EVENT_COLUMNS, EVENTS_SCHEMA, IAB, UA, WEB_PAGE
from clickloom.sources import tables
from clickloom.sources.loading import load_events, normalize_events, normalize_into, to_contract
from clickloom.sources.seeds import load_seed
from clickloom.sources.tables import (
    Zones,
    contract_events,
    create_zones,
    preview,
    reset_zones,
    table_partitions,
)
from helpers import rows_of


def test_names_are_matched_without_case_and_cast(spark):
    df = spark.createDataFrame(
        [("x", "2022-08-19 00:00:00.836", "e1", 5, "24.7")],
        "extra string, COLLECTOR_TSTAMP string, Event_Id string, TXN_ID int, br_colordepth string",
    )
    row = to_contract(df).first()
    assert list(row.asDict()) == EVENT_COLUMNS
    assert row.collector_tstamp == datetime(2022, 8, 19, 0, 0, 0, 836000)
    assert (row.event_id, row.txn_id, row.br_colordepth, row.app_id) == ("e1", "5", None, None)
    assert to_contract(df).schema.simpleString() == EVENTS_SCHEMA.simpleString()


def test_names_that_differ_only_in_case_are_an_error(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="event_id"):
            to_contract(spark.createDataFrame([("a", "b")], "event_id string, EVENT_ID string"))
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_a_bad_value_stops_the_load(spark):
    df = spark.createDataFrame([("no time",)], "collector_tstamp string")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        to_contract(df).collect()


def test_a_batch_loaded_twice_is_there_once(spark, zones, make_events):
    first = make_events([{"event_id": "a"}, {"event_id": "b", "event_name": "it's"}])
    load_events(spark, first, zones.events, "o'clock")
    load_events(spark, make_events([{"event_id": "c"}]), zones.events, "second")
    load_events(spark, first, zones.events, "o'clock")
    assert sorted(r.event_id for r in spark.table(zones.events).collect()) == ["a", "b", "c"]
    listed = table_partitions(spark, zones.events, ["event_day", "event_name", "batch_id"]).collect()
    assert {tuple(r) for r in listed} == {
        (date(2024, 3, 1), "page_view", "o'clock"),
        (date(2024, 3, 1), "it's", "o'clock"),
        (date(2024, 3, 1), "page_view", "second"),
    }


def test_replace_drops_earlier_loads(spark, zones, make_events, tmp_path):
    load_events(spark, make_events([{"event_id": "a"}]), zones.events, "one")
    path = str(tmp_path / "files")
    make_events([{"event_id": "b"}]).write.parquet(path)
    load_events(spark, path, zones.events, "two", append=False)
    assert [r.event_id for r in contract_events(spark, zones.events).collect()] == ["b"]
    assert contract_events(spark, zones.events).columns == EVENT_COLUMNS


def nested(spark):
    return spark.sql(
        f"""
        SELECT 'e1' AS event_id, TIMESTAMP'2026-04-17 19:47:00Z' AS load_tstamp, 7 AS txn_id,
            CAST(12.34 AS DECIMAL(18,2)) AS tr_total, CAST(1.5 AS DOUBLE) AS se_value, '32' AS br_colordepth,
            array(named_struct('id', 'p', 'gone', CAST(NULL AS STRING))) AS {WEB_PAGE},
            named_struct('a', 1) AS {UA}, 'view' AS event_name, 'x' AS other_context
        UNION ALL
        SELECT 'e2', TIMESTAMP'2026-04-17 21:46:59.999999+02:00', 8, CAST(0.10 AS DECIMAL(18,2)), 2.0, 'deep',
            NULL, NULL, 'view', 'x'
        """
    )


def test_nested_events_are_normalised(spark):
    rows = {r.event_id: r for r in normalize_events(nested(spark)).collect()}
    first = rows["e1"]
    assert first.load_tstamp == datetime(2026, 4, 17, 19, 47)
    assert rows["e2"].load_tstamp == datetime(2026, 4, 17, 19, 46, 59, 999999)
    assert (first.txn_id, first.tr_total, first.se_value, first.br_colordepth) == ("7", 12.34, "1.5", 32)
    assert first[WEB_PAGE] == '[{"id":"p","gone":null}]' and first[UA] == '{"a":1}'
    assert rows["e2"][WEB_PAGE] is None and rows["e2"].br_colordepth is None and first[IAB] is None
    assert "other_context" not in first.asDict()
    assert isinstance(first.tr_total, float) and not isinstance(first.tr_total, Decimal)


def test_cutover_is_inclusive_and_in_utc(spark):
    kept = normalize_events(nested(spark), cutover=datetime(2026, 4, 17, 19, 47)).collect()
    assert [r.event_id for r in kept] == ["e1"]
    assert normalize_events(nested(spark), row_limit=1).count() == 1


def test_normalised_table_is_partitioned_and_guarded(spark, zones):
    table = f"{zones.raw}.normalised"
    assert normalize_into(nested(spark), table) == 2
    assert normalize_into(nested(spark), table) == 2
    assert table_partitions(spark, table, ["event_day", "event_name"]).collect() == [(date(2026, 4, 17), "view")]
    files = [r[0] for r in spark.table(table).select("_metadata.file_path").distinct().collect()]
    assert all(f.endswith(".zstd.parquet") for f in files)
    with pytest.raises(Exception, match="TABLE_OR_VIEW_ALREADY_EXISTS"):
        normalize_into(nested(spark), table, replace=False)


def test_zones_are_created_once_and_reset(spark, zones, make_events, tmp_path):
    load_events(spark, make_events([{"event_id": "a"}]), zones.events, "one")
    create_zones(spark, zones)
    assert spark.table(zones.events).count() == 1
    spark.range(1).write.saveAsTable(f"{zones.derived}.old")
    reset_zones(spark, zones, str(tmp_path / "again"))
    assert spark.table(zones.events).count() == 0
    assert not spark.catalog.tableExists(f"{zones.derived}.old")
    assert {d.name for d in spark.catalog.listDatabases()} >= set(zones.schemas)
    assert Zones().schemas == ["atomic", "atomic_scratch", "atomic_derived", "atomic_manifest"]


def test_null_partition_values_are_kept(spark, zones, make_events):
    df = make_events([{"event_id": "a", "event_name": None}, {"event_id": "b", "event_name": "x y/z=+%"}])
    load_events(spark, df, zones.events, "one")
    load_events(spark, df, zones.events, "one")
    assert spark.table(zones.events).count() == 2
    listed = {r.event_name for r in table_partitions(spark, zones.events, ["event_name"]).collect()}
    assert listed == {None, "x y/z=+%"}
    assert {r.event_name for r in spark.table(zones.events).collect()} == listed


def test_verification(spark, make_events):
    df = make_events([{"event_id": "a"}, {"event_id": None}, {"event_id": "c"}])
    report = {r.rule: r for r in verify(df, {"id": F.col("event_id").isNotNull(), "c": F.col("event_id") > "0"}).collect()}
    assert (report["id"].rows, report["id"].broken, report["id"].passed) == (3, 1, False)
    assert report["c"].broken == 1
    empty = verify(df.limit(0), {"id": F.col("event_id").isNotNull()}).first()
    assert (empty.rows, empty.broken, empty.passed) == (0, 0, False)
    assert verify_count(df, df).first().passed and not verify_count(df, df.limit(2)).first().passed
    assert verify_count(df.limit(0), df.limit(0)).first() == (0, 0, True)
    assert preview_rows(spark, df) == 2


def preview_rows(spark, df):
    df.write.mode("overwrite").saveAsTable("preview_input")
    return preview(spark, "preview_input", 2).count()


def test_seeds(spark, zones, tmp_path):
    path = tmp_path / "seed.csv"
    path.write_text("code,name\nDE,Germany\nFR,\"France, metropolitan\"\n")
    seed = load_seed(spark, str(path), "code STRING, name STRING", f"{zones.raw}.seed")
    assert rows_of(seed) == ["('DE', 'Germany')", "('FR', 'France, metropolitan')"]


def test_duplicate_seed_keys_are_an_error(spark):
    from clickloom.operators.enrich import enrich

    df = spark.createDataFrame([("DE",), ("XX",), (None,)], "code string")
    seed = spark.createDataFrame([("DE", "Germany")], "code string, name string")
    assert rows_of(enrich(df, seed, "code")) == ["('DE', 'Germany')", "('XX', None)", "(None, None)"]
    with pytest.raises(ValueError):
        enrich(df, seed.union(seed), "code")


def test_a_wide_table_is_written_by_smaller_tasks(spark, zones, make_events, monkeypatch):
    """Rows of NULLs shrink in a shuffle, so its bytes do not bound the sort of a write; the setting comes back."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    rows = make_events([{"event_id": str(i), "at": i * 86_400} for i in range(4)])
    before = spark.conf.get(name)
    for asked, used in (("64MB", 256 * 2**20 * 64 // (8 * len(rows.columns))), ("64k", 65_536), ("1m", 2**20)):
        spark.conf.set(name, asked)
        try:
            with tables.bounded_sort(rows):
                assert spark.conf.get(name) == f"{used}b"
            with tables.bounded_sort(rows.select("event_id")):
                assert spark.conf.get(name) == f"{tables._bytes(asked)}b"
            assert spark.conf.get(name) == asked
        finally:
            spark.conf.set(name, before)
    monkeypatch.setattr(tables, "SORT_BYTES", 20_000)
    load_events(spark, rows.unionByName(rows), zones.events, "a")
    assert spark.table(zones.events).count() == 8 and spark.conf.get(name) == before
