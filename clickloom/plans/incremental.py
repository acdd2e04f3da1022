"""Loading batches in order, each followed by a refresh."""

from __future__ import annotations

import time
from dataclasses import astuple, dataclass

from pyspark.sql import DataFrame, SparkSession

from clickloom.operators.verify import source_metrics
from clickloom.plans.build import is_built
from clickloom.plans.models import ModelOptions
from clickloom.plans.refresh import refresh
from clickloom.sources.batches import read_batch, split_manifest
from clickloom.sources.loading import load_events
from clickloom.sources.tables import Zones


@dataclass(frozen=True)
class Step:
    """What one step loaded, the source after it, and the seconds it took."""

    phase: str
    batches: list[str]
    row_count: int
    min_collector_tstamp: object
    max_collector_tstamp: object
    load_seconds: float
    refresh_seconds: float


STEP_DDL = """
    step INT,
    phase STRING,
    batches ARRAY<STRING>,
    row_count BIGINT,
    min_collector_tstamp TIMESTAMP_NTZ,
    max_collector_tstamp TIMESTAMP_NTZ,
    load_seconds DOUBLE,
    refresh_seconds DOUBLE
"""


def run_incremental(
    spark: SparkSession,
    zones: Zones,
    manifest: DataFrame,
    initial: int = 1,
    limit: int | None = None,
    options: ModelOptions = ModelOptions(),
    resume: bool = False,
) -> list[Step]:
    """Load the initial batches and build; then load and refresh batch by batch.

    Every step is noted in the manifest zone when it has ended. With ``resume``
    a run goes on at the first step that is not noted, which repeats what an
    interrupted one had begun: loads and refreshes replace themselves. The noted
    steps have to be the manifest's. Without it, the notes of an earlier run go.
    """
    first, later = split_manifest(manifest, initial, limit)
    groups = [("initial", first), *[("incremental", [b]) for b in later]]
    if not resume:
        spark.sql(f"DROP TABLE IF EXISTS {zones.run_steps}")
    steps = noted_steps(spark, zones)
    wanted = [(phase, [b.name for b in group]) for phase, group in groups]
    if [(s.phase, s.batches) for s in steps] != wanted[: len(steps)]:
        raise ValueError("the steps of the earlier run are not those of this manifest")
    for number, (phase, group) in list(enumerate(groups))[len(steps) :]:
        start = time.perf_counter()
        for batch in group:
            load_events(spark, read_batch(spark, batch.uri), zones.events, batch.name)
        loaded = time.perf_counter()
        metrics = source_metrics(spark.table(zones.events)).first()
        measured = time.perf_counter()
        # a build takes in all batches, a refresh its own
        for batch in group if is_built(spark, zones) else group[-1:]:
            refresh(spark, zones, batch.name, options)
        step = Step(
            phase,
            [b.name for b in group],
            *metrics,
            load_seconds=loaded - start,
            refresh_seconds=time.perf_counter() - measured,
        )
        row = spark.createDataFrame([(number, *astuple(step))], STEP_DDL)
        row.coalesce(1).write.format("parquet").mode("append").saveAsTable(zones.run_steps)
        steps.append(step)
    return steps


def noted_steps(spark: SparkSession, zones: Zones) -> list[Step]:
    """The steps that have ended, in order; one row per batch at most."""
    if not spark.catalog.tableExists(zones.run_steps):
        return []
    return [Step(*row[1:]) for row in spark.table(zones.run_steps).orderBy("step").collect()]
