from __future__ import annotations

import pytest

from clickloom.plans import incremental
from clickloom.plans.build import build
from clickloom.plans.incremental import noted_steps, run_incremental
from helpers import rows_of
from test_refresh import random_events


@pytest.fixture
def manifest(spark, make_events, tmp_path):
    rows = random_events(9, 80)
    places = [(i, f"batch_{i}", str(tmp_path / f"batch_{i}")) for i in range(3)]
    for i, _, uri in places:
        make_events(rows[i::3]).write.parquet(uri)
    return spark.createDataFrame(places, "batch_index INT, name STRING, uri STRING")


def test_run_that_was_ended_goes_on_and_equals_a_build(spark, zones, manifest, monkeypatch):
    done = []

    def ending(session, where, batch_id, options):
        refresh(session, where, batch_id, options)
        done.append(batch_id)
        if done == ["batch_1", "batch_2"]:  # after the refresh, before its note
            raise RuntimeError("ended")

    refresh = incremental.refresh
    monkeypatch.setattr(incremental, "refresh", ending)
    with pytest.raises(RuntimeError):
        run_incremental(spark, zones, manifest, initial=2)
    assert [s.batches for s in noted_steps(spark, zones)] == [["batch_0", "batch_1"]]
    steps = run_incremental(spark, zones, manifest, initial=2, resume=True)
    assert done == ["batch_1", "batch_2", "batch_2"]  # the first step is not repeated
    assert [(s.phase, s.batches, s.row_count) for s in steps] == [
        ("initial", ["batch_0", "batch_1"], 54),
        ("incremental", ["batch_2"], 80),
    ]
    assert noted_steps(spark, zones) == steps
    got = [rows_of(spark.table(t)) for t in (zones.page_views, zones.sessions, zones.users)]
    build(spark, zones)
    assert got == [rows_of(spark.table(t)) for t in (zones.page_views, zones.sessions, zones.users)]
    with pytest.raises(ValueError, match="earlier run"):
        run_incremental(spark, zones, manifest, initial=1, resume=True)
