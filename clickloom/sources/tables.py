"""Catalog tables: zones, the events table, partitioned writes."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterable, Iterator
from contextlib import AbstractContextManager, contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.times import day_of
from clickloom.schema import BATCH_ID, EVENT_COLUMNS, EVENT_DAY, EVENT_PARTITIONS, EVENTS_SCHEMA


# Fixed value: the folder name of a NULL partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"

# What the sort of a write may hold in a task, and a row of mostly NULLs in a shuffle (measured: 69 bytes).
SORT_BYTES = 256 << 20
SHUFFLED_ROW = 64


@dataclass(frozen=True)
class Zones:
    """Schema and table names: raw events, scratch, results, refresh state."""

    raw: str = "atomic"
    scratch: str = "atomic_scratch"
    derived: str = "atomic_derived"
    manifest: str = "atomic_manifest"
    events_table: str = "events"

    @classmethod
    def with_prefix(cls, prefix: str) -> "Zones":
        default = cls()
        return cls(*[f"{prefix}_{s}" for s in default.schemas], events_table=default.events_table)

    @property
    def schemas(self) -> list[str]:
        return [self.raw, self.scratch, self.derived, self.manifest]

    @property
    def events(self) -> str:
        return f"{self.raw}.{self.events_table}"

    @property
    def replaced(self) -> str:
        return replaced_by(self.events)

    @property
    def page_views(self) -> str:
        return f"{self.derived}.page_views"

    @property
    def sessions(self) -> str:
        return f"{self.derived}.sessions"

    @property
    def users(self) -> str:
        return f"{self.derived}.users"

    @property
    def page_activity(self) -> str:
        return f"{self.manifest}.page_activity"

    @property
    def session_state(self) -> str:
        return f"{self.manifest}.session_state"

    @property
    def batches(self) -> str:
        return f"{self.manifest}.batches"

    @property
    def event_index(self) -> str:
        return f"{self.manifest}.event_index"

    @property
    def files(self) -> str:
        return f"{self.manifest}.files"

    @property
    def file_events(self) -> str:
        return f"{self.manifest}.file_events"

    @property
    def file_runs(self) -> str:
        return f"{self.manifest}.file_runs"

    @property
    def run_steps(self) -> str:
        return f"{self.manifest}.run_steps"

    @property
    def rejects(self) -> str:
        return f"{self.raw}.{self.events_table}_rejects"


def replaced_by(events_table: str) -> str:
    """The table that notes what reloaded batches held before."""
    return f"{events_table}_replaced"


def create_zones(spark: SparkSession, zones: Zones, location: str | None = None) -> None:
    """Create the schemas that are missing, below ``location`` if given."""
    for schema in zones.schemas:
        place = f" LOCATION '{location.rstrip('/')}/{schema}'" if location else ""
        spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}{place}")


def reset_zones(
    spark: SparkSession, zones: Zones, location: str | None = None, day_from: str = "collector_tstamp"
) -> None:
    """Drop the events table and every derived thing, then start empty."""
    spark.sql(f"DROP TABLE IF EXISTS {zones.events}")
    spark.sql(f"DROP TABLE IF EXISTS {zones.replaced}")
    spark.sql(f"DROP TABLE IF EXISTS {zones.rejects}")
    for schema in (zones.scratch, zones.derived, zones.manifest):
        spark.sql(f"DROP SCHEMA IF EXISTS {schema} CASCADE")
    create_zones(spark, zones, location)
    create_events_table(spark, zones.events, day_from)


def create_events_table(spark: SparkSession, table: str, day_from: str = "collector_tstamp") -> None:
    """The declared events table, empty, unless it exists.

    Spark's Parquet tables take no day transform, so the day is a real column;
    ``day_from`` is remembered as a table property.
    """
    fields = [f for f in EVENTS_SCHEMA if f.name not in EVENT_PARTITIONS]
    fields += [
        T.StructField(EVENT_DAY, T.DateType()),
        EVENTS_SCHEMA["event_name"],
        T.StructField(BATCH_ID, T.StringType()),
    ]
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"OPTIONS (compression 'zstd') PARTITIONED BY ({', '.join(EVENT_PARTITIONS)}) "
        f"TBLPROPERTIES ('day_from' = '{day_from}')"
    )


def day_source(spark: SparkSession, table: str) -> str:
    """The column whose day the events table is partitioned by."""
    found = spark.sql(f"SHOW TBLPROPERTIES {table}").where(F.col("key") == "day_from").first()
    return found["value"] if found else "collector_tstamp"


def contract_events(spark: SparkSession, table: str) -> DataFrame:
    """The table's rows as the contract: its columns in its order."""
    return spark.table(table).select(*EVENT_COLUMNS)


def preview(
    spark: SparkSession, table: str, rows: int = 10, order: Iterable[Column | str] = ()
) -> DataFrame:
    """Some rows of a table: the first ones in ``order``, any without it."""
    return spark.table(table).orderBy(*order).limit(rows) if order else spark.table(table).limit(rows)


def spread(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Group rows by output partition before a write.

    A rebalance, not a repartition: adaptive execution merges small partitions
    and splits a large one over several tasks, so one hot day or event name
    does not end up in a single task or file.
    """
    return df.hint("rebalance", *columns)


def write_partitioned(
    df: DataFrame,
    table: str,
    partition_by: list[str],
    replace: bool = True,
    compression: str = "zstd",
) -> None:
    """Create ``table`` from ``df``; with ``replace=False`` an existing one is an error."""
    with bounded_sort(df):
        (
            spread(df, partition_by)
            .write.format("parquet")
            .option("compression", compression)
            .mode("overwrite" if replace else "errorifexists")
            .partitionBy(*partition_by)
            .saveAsTable(table)
        )


def with_event_day(df: DataFrame, day_from: str) -> DataFrame:
    return df.withColumn(EVENT_DAY, day_of(F.col(day_from)))


_SETTING = threading.RLock()


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """The session's setting for the time of a write, which takes turns."""
    with _SETTING:
        before = spark.conf.get(name)
        spark.conf.set(name, value)
        try:
            yield
        finally:
            spark.conf.set(name, before)


def _dynamic_overwrite(spark: SparkSession) -> AbstractContextManager[None]:
    """The write option of this name does not let a table be read by its own overwrite, so the session is set."""
    return _setting(spark, "spark.sql.sources.partitionOverwriteMode", "dynamic")


def bounded_sort(df: DataFrame) -> AbstractContextManager[None]:
    """For the write of ``spread`` rows, which sorts them by partition.

    Adaptive execution sizes the tasks by shuffled bytes, where a NULL is next to
    nothing; a sort holds 8 bytes and more a column. A wide table gets tasks of
    less shuffled bytes than the session asks for, so that a sort stays near ``SORT_BYTES``.
    """
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    asked = _bytes(df.sparkSession.conf.get(name))
    bound = SORT_BYTES * SHUFFLED_ROW // (8 * len(df.columns))
    return _setting(df.sparkSession, name, f"{min(asked, bound)}b")


def _bytes(text: str) -> int:
    """A size as Spark's settings have it: 67108864b, 64MB, 1m."""
    number, unit = re.fullmatch(r"(\d+)\s*([kmgtp]?)i?b?", text.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def overwrite_partitions(df: DataFrame, table: str, partition_by: list[str]) -> None:
    """Replace those partitions of ``table`` that ``df`` has rows for.

    Reading from the same table is allowed: new files are written aside first.
    """
    spark = df.sparkSession
    ordered = df.select(*spark.table(table).columns)
    with _dynamic_overwrite(spark), bounded_sort(ordered):
        spread(ordered, partition_by).write.mode("overwrite").insertInto(table)


def table_partitions(
    spark: SparkSession, table: str, partition_by: list[str], within: dict[str, str] | None = None
) -> DataFrame:
    """Partition values from the catalog, of those ``within`` some values if given; no file is opened."""
    types = dict(spark.table(table).dtypes)
    only = ", ".join(f"{c} = {_literal(v)}" for c, v in (within or {}).items())
    listed = spark.sql(f"SHOW PARTITIONS {table}" + (f" PARTITION ({only})" if only else ""))
    escaped = {c: F.regexp_extract("partition", f"(?:^|/){c}=([^/]*)", 1) for c in partition_by}
    return listed.select(
        *[
            F.when(v != NULL_PARTITION, F.url_decode(F.replace(v, F.lit("+"), F.lit("%2B"))))
            .cast(types[c])
            .alias(c)
            for c, v in escaped.items()
        ]
    )


def partition_filter(partition_by: list[str], values: Iterable[Row]) -> Column:
    """Literal filter on partition values, NULL included, that prunes at planning time.

    Values are grouped by all columns but the first, so a filter over many days
    and a few event names is one IN list of days for each name.
    """
    first, *others = partition_by
    groups: dict[tuple, list] = {}
    for row in values:
        groups.setdefault(tuple(row[c] for c in others), []).append(row[first])
    clauses = [
        reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(others, rest)], _one_of(first, firsts))
        for rest, firsts in groups.items()
    ]
    return reduce(lambda a, b: a | b, clauses, F.lit(False))


def _one_of(column: str, values: list) -> Column:
    known = [v for v in values if v is not None]
    clauses = ([F.col(column).isin(known)] if known else []) + (
        [F.col(column).isNull()] if len(known) < len(values) else []
    )
    return reduce(lambda a, b: a | b, clauses)


def drop_partitions(spark: SparkSession, table: str, partition_by: list[str], values: Iterable[Row]) -> None:
    for row in values:
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS PARTITION ({partition_spec(row, partition_by)})")


def partition_spec(row: Row, partition_by: list[str]) -> str:
    """A partition as SQL names it."""
    return ", ".join(f"{c} = {_literal(row[c])}" for c in partition_by)


def _literal(value) -> str:
    if value is None:
        return "NULL"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def replace_rows(
    table: str,
    partition_by: list[str],
    fresh: DataFrame,
    gone: DataFrame,
    key: str,
    held: list[Row],
    filled: list[Row],
) -> None:
    """Replace the rows of ``table`` whose ``key`` is in ``gone`` by ``fresh``.

    ``held`` lists the partition values that held such rows, ``filled`` those
    that ``fresh`` has rows for. Only these partitions are read and rewritten,
    and one left without rows is dropped: overwriting would leave it as it was.
    The driver sees partition values only.
    """
    spark = fresh.sparkSession
    touched = list(dict.fromkeys([*held, *filled]))
    if not touched:
        return
    current = spark.table(table)
    kept = current.where(partition_filter(partition_by, touched)).join(
        gone.select(F.col(key).alias("_gone")), F.col(key).eqNullSafe(F.col("_gone")), "left_anti"
    )
    doubtful = [r for r in held if r not in set(filled)]
    emptied: list[Row] = []
    if doubtful:
        still = kept.where(partition_filter(partition_by, doubtful)).select(*partition_by).distinct()
        remaining = set(still.collect())
        emptied = [r for r in doubtful if r not in remaining]
    overwrite_partitions(kept.unionByName(fresh.select(*current.columns)), table, partition_by)
    drop_partitions(spark, table, partition_by, emptied)
