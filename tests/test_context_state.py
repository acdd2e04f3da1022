from __future__ import annotations

import json
import random
from dataclasses import replace

import pytest

from clickloom.plans import context_state
from clickloom.plans.build import build
from clickloom.plans.file_refresh import refresh_files
from clickloom.plans.models import ModelContext, ModelOptions, model_events
from clickloom.plans.refresh import refresh
from clickloom.schema import IAB, UA, WEB_PAGE
from clickloom.sources.loading import append_normalized, load_events, normalize_into
from helpers import rows_of
from test_refresh import random_events

UA_FIELDS = (("family", "$[0].family", "string"), ("ua_version", "$[0].v", "int"))
BASE = ModelOptions(hot_rows=3)


def with_contexts(ua: bool, iab: bool) -> ModelOptions:
    fields = (("spider", "$[0].spider", "boolean"),)
    page = ModelContext(WEB_PAGE, (("web_page_id", "$[0].id", "string"),))
    return replace(BASE, contexts=(ModelContext(UA, UA_FIELDS, ua), ModelContext(IAB, fields, iab), page))


def batches(seed: int, n: int = 3) -> list[list[dict]]:
    rng = random.Random(seed)
    found: list[list[dict]] = [[] for _ in range(n)]
    for row in random_events(seed, 90):
        ua = [None, "no json", json.dumps([{"family": rng.choice("abc")}]), json.dumps([{"family": None, "v": rng.randrange(9)}])]
        row |= {UA: rng.choice(ua), IAB: rng.choice([None, json.dumps([{"spider": rng.random() < 0.5}])])}
        found[rng.randrange(n)].append(row)
    return found


def results(spark, zones):
    return [rows_of(spark.table(t)) for t in (zones.page_views, zones.sessions, zones.users)]


def test_refresh_equals_build_after_switches(spark, zones, make_events):
    flags = [(True, False), (False, True), (True, True)]  # one on, off and on again
    for i, ((ua, iab), batch) in enumerate(zip(flags, batches(4))):
        load_events(spark, make_events(batch), zones.events, f"b{i}")
        refresh(spark, zones, f"b{i}", with_contexts(ua, iab))
    got = results(spark, zones)
    build(spark, zones, with_contexts(*flags[-1]))
    assert got == results(spark, zones)
    families = [r.family for r in spark.table(zones.sessions).select("family").collect()]
    assert any(families) and spark.table(zones.sessions).where("web_page_id IS NOT NULL").count() > 0
    assert dict(spark.table(zones.sessions).dtypes)["spider"] == "boolean"


def test_contexts_can_be_declared_later_and_dropped_again(spark, zones, make_events):
    first, second = batches(5, 2)
    load_events(spark, make_events(first), zones.events, "b0")
    refresh(spark, zones, "b0", BASE)
    plain = spark.table(zones.sessions).columns
    load_events(spark, make_events(second), zones.events, "b1")
    refresh(spark, zones, "b1", with_contexts(True, True))
    got = results(spark, zones)
    build(spark, zones, with_contexts(True, True))
    assert got == results(spark, zones)
    refresh(spark, zones, "b1", BASE)
    assert spark.table(zones.sessions).columns == plain


def test_refresh_by_files_fills_a_context_though_no_file_changed(spark, zones, make_events):
    spark.sql(f"DROP TABLE {zones.events}")
    first, second = batches(6, 2)
    normalize_into(make_events(first), zones.events)
    refresh_files(spark, zones, with_contexts(False, True))
    assert refresh_files(spark, zones, with_contexts(True, True)) == {"added": 0, "removed": 0}
    append_normalized(make_events(second), zones.events)
    refresh_files(spark, zones, with_contexts(True, False))
    got = results(spark, zones)
    build(spark, zones, with_contexts(True, False))
    assert got == results(spark, zones)


def test_interrupted_switch_is_repeated(spark, zones, make_events, monkeypatch):
    first, second = batches(7, 2)
    load_events(spark, make_events(first), zones.events, "b0")
    refresh(spark, zones, "b0", with_contexts(False, False))
    load_events(spark, make_events(second), zones.events, "b1")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(context_state, "publish", lost)
        with pytest.raises(RuntimeError):
            refresh(spark, zones, "b1", with_contexts(True, True))
    refresh(spark, zones, "b1", with_contexts(True, True))
    got = results(spark, zones)
    build(spark, zones, with_contexts(True, True))
    assert got == results(spark, zones)


def test_only_contexts_that_are_on_are_read(spark, zones, make_events):
    load_events(spark, make_events(batches(8)[0]), zones.events, "b0")
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = model_events(spark.table(zones.events), with_contexts(True, False))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert UA in schema and IAB not in schema


def test_names_that_are_taken_are_refused():
    with pytest.raises(ValueError, match="events"):
        ModelOptions(contexts=(ModelContext(UA, (("Events", "$.e", "int"),)),))
