from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from clickloom.functions import contexts, times
from clickloom.functions.casts import safe_int
from clickloom.operators.numbering import number_rows
from clickloom.schema import CONTEXT_COLUMNS, EVENT_COLUMNS, EVENTS_SCHEMA, ID_COLUMNS, TIMESTAMP_COLUMNS, UA, WEB_PAGE
from clickloom.session import Scratch
from helpers import rows_of


def test_contract_has_136_columns_of_the_declared_types():
    counts = {}
    for field in EVENTS_SCHEMA:
        counts[field.dataType.typeName()] = counts.get(field.dataType.typeName(), 0) + 1
    assert len(EVENT_COLUMNS) == len(set(EVENT_COLUMNS)) == 136
    assert counts == {"string": 92, "integer": 15, "boolean": 11, "double": 10, "timestamp_ntz": 8}
    assert len(CONTEXT_COLUMNS) == 7 and len(TIMESTAMP_COLUMNS) == 8
    assert set(ID_COLUMNS) <= set(EVENT_COLUMNS)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_zone_is_stripped_as_utc_in_any_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.range(1).select(
            times.strip_zone(F.lit("2024-03-10 21:47:00.000001+02:00").cast("timestamp")).alias("t"),
            times.micros_between(times.ntz(datetime(2024, 3, 10)), times.ntz(datetime(2024, 3, 11))).alias("day"),
        )
        assert row.first() == (datetime(2024, 3, 10, 19, 47, 0, 1), 86_400_000_000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_micros_survive_addition(spark):
    low = datetime(1999, 12, 31, 23, 59, 59, 999999)
    df = spark.createDataFrame([(0,), (1,), (-1,), (10**14,), (None,)], "d bigint")
    got = df.select(times.add_micros(times.ntz(low), F.col("d"))).collect()
    assert [r[0] for r in got[:4]] == [low + timedelta(microseconds=d) for d in (0, 1, -1, 10**14)]
    assert got[4][0] is None


def test_day_numbers(spark):
    df = spark.createDataFrame([(0,), (19723,), (-1,)], "n int").select(times.day_from_number(F.col("n")).alias("d"))
    assert [r.d for r in df.collect()] == [date(1970, 1, 1), date(2024, 1, 1), date(1969, 12, 31)]
    assert [r[0] for r in df.select(times.day_number(F.col("d"))).collect()] == [0, 19723, -1]


def test_context_path_gives_null_for_what_is_not_json(spark):
    texts = ['[{"id":"a"}]', "[{'id':'a'}]", "", None, "[]", '{"id":"a"}', '[{"id":7}]', '[{"id":null}]']
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(contexts.context_value("c", "$[0].id")).collect()]
    assert got == ["a", None, None, None, None, None, "7", None]


def test_text_after_a_json_value_makes_it_invalid(spark):
    texts = ['[{"id":"x"}] garbage', '[{"id":"x"}] [1]', '{"id":1}}', '1,2', '[{"id":"x"}]\n', '[{"id":"a","id":"b"}]', "{'id':1}", "NaN"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [tuple(r) for r in df.select(contexts.is_json(F.col("c")), contexts.context_value("c", "$[0].id")).collect()]
    assert [g[0] for g in got] == [False, False, False, False, True, True, False, False]
    assert [g[1] for g in got] == [None, None, None, None, "x", "a", None, None]


def test_moments_and_text_with_zones_are_taken_in_utc(spark):
    aware = datetime(2024, 3, 1, 13, tzinfo=timezone(timedelta(hours=2)))
    assert spark.range(1).select(times.ntz(aware)).first()[0] == datetime(2024, 3, 1, 11)
    texts = ["2024-03-01 12:00:00+02:00", "2024-03-01T12:00:00Z", "2024-03-01 12:00:00.5", "2024-03-01", None, "2024-03-01 12:00:00 -05:30"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    got = [r[0] for r in df.select(times.text_to_ntz(F.col("c"))).collect()]
    day = datetime(2024, 3, 1)
    hours = lambda h: day + timedelta(hours=h)
    assert got == [hours(10), hours(12), hours(12) + timedelta(microseconds=500_000), day, None, hours(17.5)]


def test_page_view_id_is_the_parsed_value_whatever_the_text(spark):
    texts = [
        '[{"id":"a"}]', '[{"id": "a b"}]', '[{"id":"é"}]', '[{"id":""}]', '[{"id":"a\\u0041"}]', '[{"id":"a\\""}]',
        '[{"id":"a"}] ', '[{"id":"a"}]\n', ' [{"id":"a"}]', '[{"id":"a"}]x', '[{"id":"a","b":1}]', '[{"id":"a\nb"}]',
        '[{"id":"a"},{"id":"b"}]', "[{'id':'a'}]", "", None, '[{"id":"a\tb"}]', '{"id":"a"}', '[{"id":7}]',
    ]
    df = spark.createDataFrame([(t,) for t in texts], f"{WEB_PAGE} string")
    for r in df.select(WEB_PAGE, contexts.page_view_id(), contexts.context_value(WEB_PAGE, "$[0].id")).collect():
        assert r[1] == r[2], r[0]
    assert df.where(contexts.page_view_id() == "a b").count() == 1


def test_gates_keep_the_schema(spark):
    df = spark.createDataFrame([('[{"id":"a"}]', '[{"v":3}]')], f"{WEB_PAGE} string, {UA} string")
    fields = {WEB_PAGE: {"id": ("$[0].id", "string")}, UA: {"v": ("$[0].v", "int")}}
    on, off = contexts.extract_contexts(df, fields, [UA]), contexts.extract_contexts(df, fields)
    assert on.schema == off.schema
    assert on.select("id", "v").first() == ("a", 3)
    assert off.select("id", "v").first() == ("a", None)
    absent = contexts.extract_contexts(df.drop(UA), fields, [UA])
    assert absent.select("id", "v").first() == ("a", None)


def test_json_ids_are_rewritten_wherever_they_are(spark):
    text = '[{"id" : "x", "n": {"id":"y"}, "id2": "z", "i": {"id": 5}}]'
    df = spark.createDataFrame([(text,), (None,), ('{"id": ""}',)], "c string")
    got = [r[0] for r in df.select(contexts.suffix_json_ids(F.col("c"), F.lit("__b001"))).collect()]
    assert got[0] == '[{"id" : "x__b001", "n": {"id":"y__b001"}, "id2": "z", "i": {"id": 5}}]'
    assert got[1:] == [None, '{"id": ""}']


def test_safe_int(spark):
    df = spark.createDataFrame([(t,) for t in ["24", "24.7", " 7 ", "abc", "", None]], "c string")
    assert [r[0] for r in df.select(safe_int(F.col("c"))).collect()] == [24, None, 7, None, None, None]


def test_numbering_in_pieces_equals_a_window(spark):
    """Keys above the limit, also one with few distinct times, NULL among the keys."""
    df = (
        spark.range(4000)
        .select(
            F.when(F.col("id") % 3 == 0, "hot")
            .when(F.col("id") % 3 == 1, "flat")
            .when(F.col("id") % 97 == 2, F.lit(None))
            .otherwise(F.concat(F.lit("k"), F.col("id") % 50))
            .alias("key"),
            F.when(F.col("id") % 3 == 1, 0).otherwise((F.col("id") * 7919) % 100).alias("t"),
            F.col("id").cast("string").alias("name"),
        )
        .repartition(7)
    )
    df.write.mode("overwrite").saveAsTable("numbering_input")
    df = spark.table("numbering_input")
    with Scratch(spark) as scratch:
        plain = number_rows(df, "key", ["t", "name"], "n", scratch, hot_rows=10_000)
        pieces = number_rows(df, "key", ["t", "name"], "n", scratch, hot_rows=20)
        assert rows_of(plain) == rows_of(pieces)
        assert plain.count() == 4000
