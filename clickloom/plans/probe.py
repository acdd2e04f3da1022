"""A small merge on a real table, audited: does it touch its own partition only?"""

from __future__ import annotations

import uuid
import warnings
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.times import day_of
from clickloom.operators.audit import audit_partitions, file_inventory, sample_partition, smallest_partition
from clickloom.operators.merge import before_image, merge_update
from clickloom.schema import EVENT_DAY, EVENT_PARTITIONS
from clickloom.session import Scratch
from clickloom.sources.tables import Zones, day_source, partition_filter

PROBE_KEY = ["event_id", "collector_tstamp", "event_name"]


@dataclass(frozen=True)
class ProbeReport:
    """``audit`` has the counts and the verdict; the values before are kept under ``probe_id``."""

    probe_id: str
    partition: Row
    rows: int
    audit: Row


def merge_probe(spark: SparkSession, zones: Zones, rows: int = 10, column: str = "etl_tags", value: str = "probe") -> ProbeReport:
    """Set ``column`` in ``rows`` events of the smallest partition and audit the files.

    The values before go to the manifest zone, so that a probe can be undone. A
    table without rows is an error, a partition of fewer rows a warning. Rows of
    which a key column is NULL are not matched.
    """
    probe_id = uuid.uuid4().hex
    with Scratch(spark) as scratch:
        before = scratch.save(file_inventory(spark.table(zones.events), EVENT_PARTITIONS), "before")
        smallest = smallest_partition(before).first()
        if smallest is None:
            raise ValueError(f"{zones.events} has no partition to probe")
        inside = partition_filter(EVENT_PARTITIONS, [smallest["partition"]])
        sample = scratch.save(sample_partition(spark.table(zones.events), inside, rows).select(*PROBE_KEY, EVENT_DAY, *_others()), "sample")
        found = sample.count()
        if not found:
            raise ValueError(f"{smallest['partition']} has no rows to probe")
        if found < rows:
            warnings.warn(f"{smallest['partition']} has {found} rows, fewer than {rows}", stacklevel=2)
        image = before_image(spark.table(zones.events).where(inside), sample, PROBE_KEY, [column])
        image.withColumn("probe_id", F.lit(probe_id)).write.mode("append").saveAsTable(f"{zones.manifest}.probe_before")
        derive = {EVENT_DAY: day_of(F.col("collector_tstamp"))} if day_source(spark, zones.events) == "collector_tstamp" else {}
        merge_update(spark, zones.events, sample, PROBE_KEY, {column: F.lit(value)}, EVENT_PARTITIONS, derive)
        after = file_inventory(spark.table(zones.events), EVENT_PARTITIONS)
        same = [F.col(f"partition.{c}").eqNullSafe(F.lit(smallest["partition"][c])) for c in EVENT_PARTITIONS]
        target = reduce(lambda a, b: a & b, same)
        return ProbeReport(probe_id, smallest["partition"], found, audit_partitions(before, after, target).first())


def _others() -> list[str]:
    return [c for c in EVENT_PARTITIONS if c not in (*PROBE_KEY, EVENT_DAY)]
