from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from clickloom.plans import refresh as refresh_module
from clickloom.plans.build import build
from clickloom.plans.models import ModelOptions
from clickloom.plans.refresh import refresh
from clickloom.sources.loading import load_events
from clickloom.sources.tables import table_partitions
from clickloom.streaming.refresh import start_refresh, stream_files
from helpers import rows_of

DAY = 86_400


def results(spark, zones):
    derived = [rows_of(spark.table(t)) for t in (zones.page_views, zones.sessions, zones.users)]
    days = rows_of(spark.table(zones.session_state).select("domain_sessionid", "first_day", "last_day", "session_day"))
    return [*derived, days]


def rebuilt(spark, zones):
    build(spark, zones)
    return results(spark, zones)


def random_events(seed: int, n: int = 120) -> list[dict]:
    """Copies of events within and across sessions and days, users that change."""
    rng = random.Random(seed)
    return [
        {
            "event_id": rng.choice([None, *map(str, range(n))]),
            "at": rng.randrange(0, 4 * DAY, 3600) + rng.randrange(3),
            "pv": rng.choice([None, "p1", "p2", "p3"]),
            "domain_sessionid": rng.choice([None, *[f"s{i}" for i in range(25)]]),
            "domain_userid": rng.choice([None, "u1", "u2", "u3", "u4"]),
            "event_name": rng.choice(["page_view", "page_ping", None]),
            "page_url": rng.choice(["/a", "/b", None]),
            "pp_yoffset_max": rng.choice([None, 10, 20]),
        }
        for _ in range(n)
    ]


def test_any_split_and_order_of_batches_equals_a_full_build(spark, zones, make_events):
    seed = 3
    rng = random.Random(seed)
    rows = random_events(seed)
    batches: list[list[dict]] = [[] for _ in range(3)]
    for row in rows:
        batches[rng.randrange(3)].append(row)
    for i, batch in enumerate(batches):
        load_events(spark, make_events(batch), zones.events, f"b{i}")
        refresh(spark, zones, f"b{i}", ModelOptions(hot_rows=3))
    got = results(spark, zones)
    refresh(spark, zones, "b1")  # asked for again
    assert results(spark, zones) == got
    assert rebuilt(spark, zones) == got


EDGES = {
    "a late copy in another session wins": (
        [{"event_id": "x", "at": 100, "pv": "p", "domain_sessionid": "s1", "domain_userid": "u1"},
         {"event_id": "y", "at": 200, "pv": "p", "domain_sessionid": "s1", "domain_userid": "u1"}],
        [{"event_id": "x", "at": 50, "pv": "q", "domain_sessionid": "s2", "domain_userid": "u2"}],
    ),
    "a session loses its only event": (
        [{"event_id": "x", "at": 100, "domain_sessionid": "s1", "domain_userid": "u1"},
         {"event_id": "z", "at": 100, "domain_sessionid": "s9", "domain_userid": "u9"}],
        [{"event_id": "x", "at": 50, "domain_sessionid": "s2", "domain_userid": "u2"}],
    ),
    "a late copy loses": (
        [{"event_id": "x", "at": 100, "domain_sessionid": "s1", "domain_userid": "u1"}],
        [{"event_id": "x", "at": 500, "domain_sessionid": "s2", "domain_userid": "u2"}],
    ),
    "a copy outside any session wins": (
        [{"event_id": "x", "at": 100, "domain_sessionid": "s1"}, {"event_id": "y", "at": 9, "domain_sessionid": "s3"}],
        [{"event_id": "x", "at": 50}],
    ),
    "copies in one batch, one of them in a session that is recomputed": (
        [{"event_id": "old", "at": 100, "domain_sessionid": "s1"}],
        [{"event_id": "old", "at": 200, "domain_sessionid": "s1"},
         {"event_id": "n", "at": 10, "domain_sessionid": "s1"}, {"event_id": "n", "at": 20, "domain_sessionid": "s2"}],
    ),
    "the first event and with it the user change": (
        [{"event_id": "x", "at": 100, "domain_sessionid": "s1", "domain_userid": "u1"}],
        [{"event_id": "y", "at": 50, "domain_sessionid": "s1", "domain_userid": "u2"}],
    ),
    "a session moves to an earlier day and leaves its old one empty": (
        [{"event_id": "x", "at": 3 * DAY, "pv": "p", "domain_sessionid": "s1", "domain_userid": "u1"}],
        [{"event_id": "y", "at": 0, "pv": "q", "domain_sessionid": "s1", "domain_userid": "u1"}],
    ),
    "a page-view id in two sessions, one event without": (
        [{"event_id": "x", "at": 0, "pv": "p", "domain_sessionid": "s1"}],
        [{"event_id": "y", "at": 1, "pv": "p", "domain_sessionid": "s2"}, {"event_id": "z", "at": 2, "domain_sessionid": "s1"}],
    ),
    "a session that crosses midnight": (
        [{"event_id": "x", "at": DAY // 2 - 1, "pv": "p", "domain_sessionid": "s1"}],
        [{"event_id": "y", "at": DAY // 2 + 1, "pv": "p", "domain_sessionid": "s1"}],
    ),
}


def apart(case: str, row: dict) -> dict:
    """The row with ids of its own case, so that all cases fit into one table."""
    ids = ("event_id", "domain_sessionid", "domain_userid", "pv")
    return {k: f"{case}: {v}" if k in ids else v for k, v in row.items()}


def test_edge_batches(spark, zones, make_events):
    for i in range(2):
        rows = [apart(case, row) for case, batches in EDGES.items() for row in batches[i]]
        load_events(spark, make_events(rows), zones.events, f"b{i}")
        refresh(spark, zones, f"b{i}")
    got = results(spark, zones)
    assert got == rebuilt(spark, zones)
    sessions = {r.domain_sessionid: r for r in spark.table(zones.sessions).collect()}
    gone = ["a session loses its only event: s1", "a copy outside any session wins: s1", "a late copy loses: s2"]
    assert not set(gone) & set(sessions)
    assert sessions["a late copy in another session wins: s1"].events == 1
    assert sessions["the first event and with it the user change: s1"].domain_userid.endswith("u2")


def test_a_partition_left_empty_is_dropped(spark, zones, make_events):
    for i, batch in enumerate(EDGES["a session moves to an earlier day and leaves its old one empty"]):
        load_events(spark, make_events(batch), zones.events, f"b{i}")
        refresh(spark, zones, f"b{i}")
    assert table_partitions(spark, zones.session_state, ["session_day"]).count() == 1
    assert results(spark, zones) == rebuilt(spark, zones)


def test_an_interrupted_refresh_is_made_good(spark, zones, make_events, monkeypatch):
    first, second = EDGES["the first event and with it the user change"]
    load_events(spark, make_events(first), zones.events, "b0")
    refresh(spark, zones, "b0")
    load_events(spark, make_events(second), zones.events, "b1")
    whole = refresh_module.replace_rows
    for stop_at in (1, 2, 3):  # before page activity, users, session state are written
        calls = []

        def replace(*args, calls=calls, stop_at=stop_at, **kwargs):
            calls.append(1)
            if len(calls) == stop_at:
                raise InterruptedError
            return whole(*args, **kwargs)

        monkeypatch.setattr(refresh_module, "replace_rows", replace)
        with pytest.raises(InterruptedError):
            refresh(spark, zones, "b1")
    monkeypatch.setattr(refresh_module, "replace_rows", whole)
    refresh(spark, zones, "b1")
    got = results(spark, zones)
    assert got == rebuilt(spark, zones)


def test_an_interrupted_build_is_made_good(spark, zones, make_events, monkeypatch):
    from clickloom.plans import build as build_module

    first, second = EDGES["a late copy in another session wins"]
    load_events(spark, make_events(first), zones.events, "b0")
    build(spark, zones)  # without a refresh before it
    load_events(spark, make_events(second), zones.events, "b1")
    refresh(spark, zones, "b1")
    expected = results(spark, zones)

    def fail(*args, **kwargs):
        raise InterruptedError

    with monkeypatch.context() as patched:
        patched.setattr(build_module, "with_last_seen_day", fail)
        with pytest.raises(InterruptedError):
            build(spark, zones)
    refresh(spark, zones, "b1")
    assert results(spark, zones) == expected == rebuilt(spark, zones)


def test_a_batch_that_waits_for_its_turn_is_left_out(spark, zones, make_events):
    load_events(spark, make_events([{"event_id": "a", "at": 5, "domain_sessionid": "s"}]), zones.events, "b0")
    refresh(spark, zones, "b0")
    load_events(spark, make_events([{"event_id": "a", "at": 6, "domain_sessionid": "s"}]), zones.events, "b1")
    load_events(spark, make_events([{"event_id": "b", "at": 9, "domain_sessionid": "s"}]), zones.events, "b2")
    refresh(spark, zones, "b1")
    assert [r.events for r in spark.table(zones.sessions).collect()] == [1]
    refresh(spark, zones, "b2")
    assert [r.events for r in spark.table(zones.sessions).collect()] == [2]
    assert results(spark, zones) == rebuilt(spark, zones)


def test_streamed_files_equal_a_full_build(spark, zones, make_events, tmp_path):
    folder, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows = random_events(7)
    make_events(rows[:80]).repartition(2).write.parquet(folder)
    start_refresh(stream_files(spark, folder, files_per_batch=1), zones, checkpoint).awaitTermination()
    assert spark.table(zones.events).count() == 80
    make_events(rows[80:]).coalesce(1).write.mode("append").parquet(folder)
    start_refresh(stream_files(spark, folder), zones, checkpoint).awaitTermination()
    assert spark.table(zones.events).count() == 120
    query = json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]
    assert {r.batch_id for r in spark.table(zones.batches).select(F.col("batch_id")).collect()} == {
        f"stream_{query}_{i:012d}" for i in range(3)
    }
    got = results(spark, zones)
    assert got == rebuilt(spark, zones)


def test_a_second_stream_leaves_the_events_of_the_first(spark, zones, make_events, tmp_path):
    for name in ("one", "two"):
        rows = [{"event_id": name, "at": 5, "pv": "p", "domain_sessionid": f"s_{name}", "domain_userid": "u"}]
        make_events(rows).write.parquet(str(tmp_path / name))
        start_refresh(stream_files(spark, str(tmp_path / name)), zones, str(tmp_path / f"c_{name}")).awaitTermination()
        spark.catalog.refreshTable(zones.events)
    assert {r.event_id for r in spark.table(zones.events).select("event_id").collect()} == {"one", "two"}
    got = results(spark, zones)
    assert rebuilt(spark, zones) == got


@pytest.mark.parametrize("seed", [1, 2])
def test_reload_with_other_content_equals_a_full_build(spark, zones, make_events, seed):
    rng = random.Random(seed)
    batches = [[r for r in random_events(10 * seed + i, 60)] for i in range(3)]
    for i, batch in enumerate(batches):
        load_events(spark, make_events(batch), zones.events, f"b{i}")
        refresh(spark, zones, f"b{i}")
    again = rng.randrange(3)
    kept = rng.sample(batches[again], 20) + random_events(seed + 99, 15)
    load_events(spark, make_events(kept), zones.events, f"b{again}")
    load_events(spark, make_events(kept[:-5]), zones.events, f"b{again}")  # twice before the refresh
    refresh(spark, zones, f"b{again}")
    got = results(spark, zones)
    assert rebuilt(spark, zones) == got


def test_a_winner_that_a_reload_takes_away(spark, zones, make_events):
    first = [{"event_id": "x", "at": 10, "pv": "p", "domain_sessionid": "s1", "domain_userid": "u1"},
             {"event_id": "y", "at": 20, "pv": "p", "domain_sessionid": "s3", "domain_userid": "u3"}]
    loser = [{"event_id": "x", "at": 3 * DAY, "pv": "q", "domain_sessionid": "s9", "domain_userid": "u9"},
             {"event_id": "z", "at": 9 * DAY, "pv": "q", "domain_sessionid": "s9", "domain_userid": "u9"}]
    for name, rows in (("b0", first), ("b1", loser)):
        load_events(spark, make_events(rows), zones.events, name)
        refresh(spark, zones, name)
    load_events(spark, make_events([{"event_id": "n", "at": 5, "pv": "p", "domain_sessionid": "s2"}]), zones.events, "b0")
    refresh(spark, zones, "b0")
    got = results(spark, zones)
    assert {r.domain_sessionid for r in spark.table(zones.sessions).collect()} == {"s2", "s9"}
    assert rebuilt(spark, zones) == got
