from __future__ import annotations

import sys
import uuid
from datetime import timedelta
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent.parent), str(Path(__file__).resolve().parent)]

from clickloom.schema import EVENTS_SCHEMA, WEB_PAGE  # noqa: E402
from clickloom.session import build_session  # noqa: E402
from clickloom.sources.tables import Zones, create_events_table, create_zones  # noqa: E402
from helpers import START  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
        spark__sql__adaptive__advisoryPartitionSizeInBytes="64k",
        spark__sql__sources__parallelPartitionDiscovery__threshold="10000",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def zones(spark, tmp_path):
    """Empty zones of their own."""
    found = Zones.with_prefix(f"t{uuid.uuid4().hex[:8]}")
    create_zones(spark, found, str(tmp_path / "zones"))
    create_events_table(spark, found.events)
    return found


@pytest.fixture
def make_events(spark):
    """Contract events from short dicts; ``at`` is seconds, ``pv`` the page-view id."""

    def make(rows: list[dict]):
        full = []
        for row in rows:
            row = dict(row)
            at = START + timedelta(seconds=row.pop("at", 0))
            view = row.pop("pv", None)
            values = {"collector_tstamp": at, "derived_tstamp": at, "load_tstamp": at, "event_name": "page_view"}
            if view is not None:
                values[WEB_PAGE] = f'[{{"id": "{view}"}}]'
            values.update(row)
            full.append(tuple(values.get(f.name) for f in EVENTS_SCHEMA))
        return spark.createDataFrame(full, EVENTS_SCHEMA)

    return make
