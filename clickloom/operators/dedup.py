"""One row per event id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dedup_events(events: DataFrame, key: str = "event_id", order: str = "collector_tstamp") -> DataFrame:
    """Keep the earliest copy of every event; rows without an id are all kept.

    Ties are broken by all other columns in order, so the outcome does not
    depend on file order. This is a plain minimum with map-side partial
    results: however many copies one id has, every map task sends one row.
    """
    rest = [c for c in events.columns if c not in (key, order)]
    rank = F.struct(F.col(order).isNull().alias("undated"), F.col(order), *rest)
    kept = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(rank).alias("kept"))
    kept = kept.select(*[key if c == key else F.col(f"kept.{c}").alias(c) for c in events.columns])
    return kept.unionByName(events.where(F.col(key).isNull()))
