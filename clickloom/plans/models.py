"""Page views, sessions and users.

Events are aggregated once, to one row per session and page view. All of its
measures can be merged (counts, extremes, first and last as ordered structs),
so sessions roll up from these rows, users roll up from sessions, and a refresh
adds new events to old rows without reading old events.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.contexts import context_value, page_view_id
from clickloom.functions.times import day_of
from clickloom.operators.dedup import dedup_events
from clickloom.operators.numbering import HOT_ROWS, number_rows
from clickloom.schema import BATCH_ID, EVENT_DAY, WEB_PAGE
from clickloom.session import Scratch
from clickloom.sources.loading import since

# Attributes of a session or page view, taken from its first event.
SOURCE_ATTRIBUTES = [
    "page_referrer",
    "refr_medium",
    "refr_source",
    "refr_term",
    "mkt_medium",
    "mkt_source",
    "mkt_term",
    "mkt_content",
    "mkt_campaign",
]
DEVICE_ATTRIBUTES = ["dvce_type", "dvce_ismobile", "br_family", "os_family"]
GEO_ATTRIBUTES = ["geo_country", "geo_region", "geo_city"]
FIRST_ATTRIBUTES = [
    "domain_userid",
    "page_url",
    "page_title",
    *SOURCE_ATTRIBUTES,
    *DEVICE_ATTRIBUTES,
    *GEO_ATTRIBUTES,
]

SESSION = "domain_sessionid"
ACTIVITY_KEYS = [SESSION, "page_view_id"]


PAGE_VIEW_COLUMNS = [
    "page_view_id",
    SESSION,
    "first_event.domain_userid AS domain_userid",
    "page_view_in_session_index",
    "start_tstamp",
    "end_tstamp",
    "events",
    "activity",
    "max_scroll",
    "first_event.page_url AS page_url",
    "first_event.page_title AS page_title",
]
HAS_PAGE_VIEW = "page_view_id IS NOT NULL"

SESSION_COLUMNS = [
    SESSION,
    "first_event.domain_userid AS domain_userid",
    "start_tstamp",
    "end_tstamp",
    "CAST(floor(CAST(CAST(end_tstamp - start_tstamp AS INTERVAL SECOND) AS DECIMAL(18, 6))) AS BIGINT)"
    " AS duration_in_s",
    "page_views",
    "events",
    "first_event.page_url AS first_page_url",
    "last_event.page_url AS last_page_url",
    *[f"first_event.{c} AS {c}" for c in SOURCE_ATTRIBUTES + DEVICE_ATTRIBUTES + GEO_ATTRIBUTES],
]

# State columns of contexts begin like this.
CONTEXT_STATE = "ctx_"


@dataclass(frozen=True)
class ModelContext:
    """Columns that page views and sessions take from a context: ``fields`` are (name, JSON path, type).

    Their values are those of the first event that has any of them. Off, which
    is the default for all but the web page context, they are typed NULLs and the
    context is not read. Types have to have an order.
    """

    context: str
    fields: tuple[tuple[str, str, str], ...]
    enabled: bool = False

    @property
    def active(self) -> bool:
        return self.enabled or self.context == WEB_PAGE

    @property
    def state(self) -> str:
        """The column of the state tables; other fields are another column."""
        text = repr((self.context, [tuple(f) for f in self.fields]))
        return CONTEXT_STATE + hashlib.sha256(text.encode()).hexdigest()[:12]

    def read(self, columns: list[str]) -> Column:
        """The values in one event; all NULL if there is no such column."""
        present = self.context in columns
        values = [
            (context_value(self.context, path, kind) if present else F.lit(None).cast(kind)).alias(name)
            for name, path, kind in self.fields
        ]
        return F.struct(*values).alias(self.state)

    def any_value(self) -> Column:
        """Whether an event has a value."""
        return reduce(lambda a, b: a | b, [F.col(self.state)[name].isNotNull() for name, *_ in self.fields])

    def outputs(self) -> list[str]:
        """SQL of the columns in page views and sessions."""
        return [
            f"{self.state}.found.`{name}` AS `{name}`" if self.active else f"CAST(NULL AS {kind}) AS `{name}`"
            for name, _, kind in self.fields
        ]


@dataclass(frozen=True)
class ModelOptions:
    """What the models take from the events.

    ``session_tstamp`` is the column that ``start_date`` filters on. Everything
    in a page view that is not a ``page_view_event`` counts as activity on it.
    ``contexts`` add columns to page views and sessions, whether they are on or off.
    """

    page_view_event: str = "page_view"
    session_tstamp: str = "collector_tstamp"
    start_date: datetime | None = None
    hot_rows: int = HOT_ROWS
    contexts: tuple[ModelContext, ...] = ()

    def __post_init__(self) -> None:
        names = [name.lower() for c in self.contexts for name, *_ in c.fields]
        taken = {c.split(" AS ")[-1].lower() for c in PAGE_VIEW_COLUMNS + SESSION_COLUMNS}
        wrong = sorted(n for n, times in Counter(names).items() if times > 1 or n in taken)
        if wrong:
            raise ValueError(f"names of context fields are taken: {wrong}")

    @property
    def active_contexts(self) -> list[ModelContext]:
        return [c for c in self.contexts if c.active]

    def context_columns(self) -> list[str]:
        return [column for c in self.contexts for column in c.outputs()]


def model_events(events: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """The few columns the models need, page-view id in place of its context.

    Extraction comes before any shuffle, so the shuffles stay narrow. Events
    outside a session take no part in the models.
    """
    if options.start_date is not None:
        events = since(events, options.session_tstamp, options.start_date)
    day = F.col(EVENT_DAY) if EVENT_DAY in events.columns else day_of(F.col("collector_tstamp"))
    batch = F.col(BATCH_ID) if BATCH_ID in events.columns else F.lit(None).cast("string")
    return events.select(
        "event_id",
        "collector_tstamp",
        SESSION,
        page_view_id(WEB_PAGE).alias("page_view_id"),
        F.coalesce("derived_tstamp", "collector_tstamp").alias("tstamp"),
        "event_name",
        "pp_yoffset_max",
        *FIRST_ATTRIBUTES,
        day.alias(EVENT_DAY),
        batch.alias(BATCH_ID),
        *[c.read(events.columns) for c in options.active_contexts],
    )


def as_activity(events: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """Every event of a session in the form of activity, ready to be combined.

    ``events`` come from ``model_events``.
    """
    order = [F.col("tstamp"), F.col("event_id")]
    undated = F.col("tstamp").isNull().alias("undated")
    is_view = F.col("event_name").eqNullSafe(options.page_view_event)
    return events.where(F.col(SESSION).isNotNull()).select(
        *ACTIVITY_KEYS,
        F.lit(1).cast("bigint").alias("events"),
        (~is_view).cast("bigint").alias("activity"),
        F.col("pp_yoffset_max").alias("max_scroll"),
        F.col("tstamp").alias("start_tstamp"),
        F.col("tstamp").alias("end_tstamp"),
        F.struct(undated, *order, *FIRST_ATTRIBUTES).alias("first_event"),
        F.struct(*order, F.col("page_url")).alias("last_event"),
        F.col(EVENT_DAY).alias("first_day"),
        F.col(EVENT_DAY).alias("last_day"),
        F.col(BATCH_ID).alias("last_batch"),
        *[
            F.when(c.any_value(), F.struct(undated, *order, F.col(c.state).alias("found"))).alias(c.state)
            for c in options.active_contexts
        ],
    )


def _combined(columns: list[str]) -> list[Column]:
    return [
        F.sum("events").alias("events"),
        F.min("start_tstamp").alias("start_tstamp"),
        F.max("end_tstamp").alias("end_tstamp"),
        F.min("first_event").alias("first_event"),
        F.max("last_event").alias("last_event"),
        F.min("first_day").alias("first_day"),
        F.max("last_day").alias("last_day"),
        F.max("last_batch").alias("last_batch"),
        *[F.min(c).alias(c) for c in columns if c.startswith(CONTEXT_STATE)],
    ]


def combine_activity(activity: DataFrame) -> DataFrame:
    """One row per session and page-view id, the events without such an id included.

    Each map task sends at most one row per group, whatever the size of the group.
    """
    measures = [*_combined(activity.columns), F.sum("activity").alias("activity"), F.max("max_scroll").alias("max_scroll")]
    return activity.groupBy(*ACTIVITY_KEYS).agg(*measures).select(*activity.columns)


def page_activity(events: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    return combine_activity(as_activity(events, options))


def merge_activity(
    activity: DataFrame, events: DataFrame, options: ModelOptions = ModelOptions()
) -> DataFrame:
    """Stored activity with further events added to it, in one shuffle."""
    return combine_activity(as_activity(events, options).unionByName(activity))


def session_rollup(activity: DataFrame) -> DataFrame:
    """Session state: one row per session, still with its first and last event."""
    return activity.groupBy(SESSION).agg(F.count("page_view_id").alias("page_views"), *_combined(activity.columns))


def index_page_views(activity: DataFrame, scratch: Scratch, options: ModelOptions = ModelOptions()) -> DataFrame:
    """Add ``page_view_in_session_index``, from 1 by (start, id); NULL without an id.

    ``activity`` is read more than once: pass a stored table.
    """
    name = "page_view_in_session_index"
    rows = activity.withColumn("_no_view", F.col("page_view_id").isNull())
    order = ["_no_view", "start_tstamp", "page_view_id"]
    numbered = number_rows(rows, SESSION, order, name, scratch, options.hot_rows)
    return numbered.withColumn(name, F.when(~F.col("_no_view"), F.col(name))).drop("_no_view")


def page_views(indexed: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """One row per page-view id and session, from indexed activity."""
    return indexed.where(HAS_PAGE_VIEW).selectExpr(*PAGE_VIEW_COLUMNS, *options.context_columns())


def sessions(state: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """One row per session, from its state."""
    return state.selectExpr(*SESSION_COLUMNS, *options.context_columns())


def users(session_rows: DataFrame) -> DataFrame:
    """One row per user, from sessions; sessions of no known user are left out."""
    return (
        session_rows.where(F.col("domain_userid").isNotNull())
        .groupBy("domain_userid")
        .agg(
            F.min("start_tstamp").alias("first_seen"),
            F.max("end_tstamp").alias("last_seen"),
            F.count("*").alias("sessions"),
            F.sum("page_views").alias("page_views"),
            F.sum("events").alias("events"),
            F.sum("duration_in_s").alias("duration_in_s"),
        )
    )


def activity_of(events: DataFrame, options: ModelOptions = ModelOptions()) -> DataFrame:
    """Page activity straight from contract events, duplicates removed."""
    return page_activity(dedup_events(model_events(events, options)), options)
