from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from clickloom.operators.dedup import dedup_events
from clickloom.plans import models
from clickloom.session import Scratch
from helpers import rows_of


def all_models(events, scratch, options=models.ModelOptions()):
    activity = scratch.save(models.activity_of(events, options), "activity")
    sessions = models.sessions(models.session_rollup(activity))
    return (
        models.page_views(models.index_page_views(activity, scratch, options)),
        sessions,
        models.users(sessions),
    )


ROWS = [
    {"event_id": "1", "at": 10, "pv": "p1", "domain_sessionid": "s1", "domain_userid": "u1", "page_url": "/a",
     "page_title": "A", "mkt_source": "mail"},
    {"event_id": "2", "at": 20, "pv": "p1", "domain_sessionid": "s1", "domain_userid": "u1", "page_url": "/a",
     "event_name": "page_ping", "pp_yoffset_max": 300},
    {"event_id": "3", "at": 30, "pv": "p2", "domain_sessionid": "s1", "domain_userid": "u1", "page_url": "/b"},
    {"event_id": "4", "at": 5, "domain_sessionid": "s1", "domain_userid": "u0", "page_url": "/first",
     "event_name": "link_click", "dvce_ismobile": True},
    {"event_id": "5", "at": 7200, "pv": "p1", "domain_sessionid": "s2", "domain_userid": "u1"},
    {"event_id": "6", "at": 1, "pv": "p9", "domain_userid": "u1"},  # in no session
    {"event_id": "7", "at": 50, "domain_sessionid": "s3", "event_name": None},  # no user, no page view
]


def test_models_of_a_few_events(spark, make_events):
    with Scratch(spark) as scratch:
        views, sessions, users = all_models(make_events(ROWS), scratch)
        got = {(r.page_view_id, r.domain_sessionid): r for r in views.collect()}
        assert set(got) == {("p1", "s1"), ("p2", "s1"), ("p1", "s2")}
        first = got["p1", "s1"]
        assert (first.events, first.activity, first.max_scroll, first.page_url, first.page_title) == (2, 1, 300, "/a", "A")
        assert [got[k].page_view_in_session_index for k in sorted(got)] == [1, 1, 2]
        by_id = {r.domain_sessionid: r for r in sessions.collect()}
        assert set(by_id) == {"s1", "s2", "s3"}
        one = by_id["s1"]
        # the session belongs to the user of its first event, a click without a page view
        assert (one.domain_userid, one.events, one.page_views, one.duration_in_s) == ("u0", 4, 2, 25)
        assert (one.first_page_url, one.last_page_url, one.dvce_ismobile, one.mkt_source) == ("/first", "/b", True, None)
        assert (by_id["s3"].page_views, by_id["s3"].domain_userid) == (0, None)
        assert {r.domain_userid: (r.sessions, r.events, r.page_views) for r in users.collect()} == {
            "u0": (1, 4, 2), "u1": (1, 1, 1),
        }


def test_start_date_and_missing_derived_time(spark, make_events):
    rows = [{**r, "derived_tstamp": None} if i % 2 else r for i, r in enumerate(ROWS)]
    with Scratch(spark) as scratch:
        plain = [rows_of(m) for m in all_models(make_events(ROWS), scratch)]
        assert [rows_of(m) for m in all_models(make_events(rows), scratch)] == plain
        options = models.ModelOptions(start_date=datetime(2024, 3, 1, 12, 0, 20))
        _, sessions, _ = all_models(make_events(ROWS), scratch, options)
        assert {r.domain_sessionid: r.events for r in sessions.collect()} == {"s1": 2, "s2": 1, "s3": 1}


def test_one_session_with_most_of_the_events(spark, make_events):
    rows = [
        {"event_id": str(i), "at": i % 17, "pv": f"p{i % 40}", "domain_sessionid": "hot" if i % 3 else f"s{i % 5}",
         "domain_userid": "u"}
        for i in range(300)
    ]
    with Scratch(spark) as scratch:
        events = make_events(rows).repartition(6)
        plain, *_ = all_models(events, scratch)
        pieces, *_ = all_models(events, scratch, models.ModelOptions(hot_rows=5))
        assert rows_of(plain) == rows_of(pieces)


def test_the_earliest_copy_is_kept_whatever_the_order(spark, make_events):
    rows = [
        {"event_id": "a", "at": 5, "domain_sessionid": "late"},
        {"event_id": "a", "at": 1, "domain_sessionid": "y"},
        {"event_id": "a", "at": 1, "domain_sessionid": "x"},
        {"event_id": "a", "at": 0, "domain_sessionid": "undated", "collector_tstamp": None},
        {"event_id": None, "at": 1},
        {"event_id": None, "at": 1},
        *[{"event_id": "many", "at": i} for i in range(50)],
    ]
    kept = dedup_events(make_events(rows))
    assert kept.columns == make_events(rows).columns
    assert rows_of(kept) == rows_of(dedup_events(make_events(rows[::-1]).repartition(5)))
    assert kept.where(F.col("event_id").isNull()).count() == 2
    assert [r.domain_sessionid for r in kept.where("event_id = 'a'").collect()] == ["x"]
    assert kept.count() == 4


def test_merged_activity_is_that_of_the_union(spark, make_events):
    events = models.model_events(make_events(ROWS))
    some, rest = events.where("event_id < '4'"), events.where("event_id >= '4'")
    merged = models.merge_activity(models.page_activity(some), rest)
    assert rows_of(merged) == rows_of(models.page_activity(events))
