from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from clickloom.operators import clone
from clickloom.operators.verify import source_metrics
from clickloom.plans.incremental import run_incremental
from clickloom.schema import ID_COLUMNS, TIMESTAMP_COLUMNS, WEB_PAGE
from clickloom.sources.batches import read_batch, read_manifest, split_manifest, write_batches, write_manifest
from helpers import START


def template(make_events, n=40):
    return make_events(
        [
            {"event_id": str(i), "at": i * 61, "pv": f"p{i % 7}", "domain_sessionid": f"s{i % 5}",
             "domain_userid": f"u{i % 3}", "true_tstamp": None, "txn_id": None}
            for i in range(n)
        ]
    )


def test_batches_are_whole_distinct_and_in_order(spark, make_events):
    rows = template(make_events)
    schedule = clone.CloneSchedule.for_template(rows, 3)
    copies = clone.clone_batches(rows, schedule)
    assert copies.count() == 120 and copies.select("event_id").distinct().count() == 120
    assert copies.drop("batch_index").schema == rows.schema
    bounds = [
        source_metrics(copies.where(F.col("batch_index") == i)).first() for i in range(3)
    ]
    span = timedelta(seconds=39 * 61)
    for i, (n, low, high) in enumerate(bounds):
        assert (n, low, high) == (40, START + i * (span + timedelta(hours=1)), START + i * (span + timedelta(hours=1)) + span)
    one = copies.where("event_id = '3__b002'").first()
    assert (one.domain_sessionid, one.domain_userid, one.txn_id, one.true_tstamp) == ("s3__b002", "u0__b002", None, None)
    assert one[WEB_PAGE] == '[{"id": "p3__b002"}]'


def test_text_timestamps_stay_text_and_names_upper_case(spark):
    rows = spark.createDataFrame(
        [("a", "2022-08-19 00:00:00.836"), ("b", "2022-08-19 00:00:10.836"), ("c", None)],
        "EVENT_ID string, COLLECTOR_TSTAMP string",
    )
    schedule = clone.CloneSchedule.for_template(rows, 2, window=timedelta(seconds=5), fixed_spacing=timedelta(hours=2))
    got = {r.EVENT_ID: r.COLLECTOR_TSTAMP for r in clone.clone_batches(rows, schedule).collect()}
    assert got == {
        "a__b000": "2022-08-19 00:00:00.836000", "b__b000": "2022-08-19 00:00:05.836000", "c__b000": None,
        "a__b001": "2022-08-19 02:00:00.836000", "b__b001": "2022-08-19 02:00:05.836000", "c__b001": None,
    }


def test_schedule_options():
    low, high = datetime(2024, 1, 1), datetime(2024, 1, 3)
    make = lambda **o: clone.CloneSchedule(2, low, high, **o)
    assert (make().scale, make().spacing) == (1.0, timedelta(days=2, hours=1))
    assert make(gap=timedelta(0)).spacing == timedelta(days=2)
    compressed = make(window=timedelta(hours=12))
    assert (compressed.scale, compressed.spacing) == (0.25, timedelta(hours=12))
    assert make(window=timedelta(hours=12), fixed_spacing=timedelta(days=9)).spacing == timedelta(days=9)
    assert clone.CloneSchedule(1, low, low, window=timedelta(hours=1)).scale == 1.0


def test_an_empty_template_is_an_error(spark, make_events):
    with pytest.raises(ValueError):
        clone.CloneSchedule.for_template(make_events([{"collector_tstamp": None}]), 1)


@settings(max_examples=5, deadline=None)
@given(
    offsets=st.lists(st.integers(0, 10**12), min_size=2, max_size=20),
    window=st.integers(1, 10**12),
)
def test_compressed_times_keep_their_order_and_equal_plain_arithmetic(spark, offsets, window):
    times = [START + timedelta(microseconds=o) for o in offsets]
    schedule = clone.CloneSchedule(3, min(times), max(times), window=timedelta(microseconds=window))
    df = spark.createDataFrame([(t,) for t in times], "collector_tstamp timestamp_ntz")
    got = [r[0] for r in df.select(schedule.shift(F.col("collector_tstamp"), F.lit(2))).collect()]
    want = []
    for t in times:
        offset = (t - min(times)) // timedelta(microseconds=1)
        if schedule.scale != 1.0:
            offset = int(offset * schedule.scale // 1)
        want.append(min(times) + 2 * schedule.spacing + timedelta(microseconds=offset))
    assert got == want
    order = sorted(range(len(times)), key=lambda i: times[i])
    assert all(got[a] <= got[b] for a, b in zip(order, order[1:]))


def test_a_spacing_under_an_int_does_not_overflow(spark):
    schedule = clone.CloneSchedule(3, START, START + timedelta(microseconds=10), fixed_spacing=timedelta(microseconds=2**30))
    moved = spark.range(1).select(schedule.start(F.lit(2))).first()[0]
    assert moved == START + timedelta(microseconds=2**31)


def test_batches_and_manifest_on_storage_drive_an_incremental_run(spark, zones, make_events, tmp_path):
    rows = template(make_events)
    schedule = clone.CloneSchedule.for_template(rows, 3)
    files, manifest_path = str(tmp_path / "batches"), str(tmp_path / "manifest")
    write_batches(clone.clone_batches(rows, schedule), files)
    manifest = clone.batch_manifest(spark, schedule, spark.read.parquet(files), files)
    write_manifest(manifest, manifest_path)
    stored = read_manifest(spark, manifest_path).orderBy("batch_index").collect()
    assert [r.rows for r in stored] == [40] * 3
    assert [r.name for r in stored][0] == "batch_000_20240301T120000"
    for r in stored:
        assert (r.collector_tstamp_min, r.collector_tstamp_max) == (r.measured_tstamp_min, r.measured_tstamp_max)
    assert read_batch(spark, stored[1].uri).count() == 40
    steps = run_incremental(spark, zones, read_manifest(spark, manifest_path), initial=1, limit=2)
    assert [(s.phase, s.row_count) for s in steps] == [("initial", 40), ("incremental", 80)]
    assert spark.table(zones.users).count() == 6
    with pytest.raises(ValueError, match="initial"):
        split_manifest(read_manifest(spark, manifest_path), initial=4)
    with pytest.raises(ValueError, match="no batches"):
        split_manifest(read_manifest(spark, manifest_path).limit(0))


def test_every_id_and_time_column_is_covered(make_events):
    rows = template(make_events, 2)
    schedule = clone.CloneSchedule(1, START, START + timedelta(seconds=61))
    before, after = rows.first(), clone.clone_batches(rows, schedule).first()
    for c in ID_COLUMNS:
        assert after[c] == (None if before[c] is None else before[c] + "__b000")
    for c in TIMESTAMP_COLUMNS:
        assert after[c] == before[c]
