"""Event files into the contract and into the events table."""

from __future__ import annotations

from collections import Counter
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.casts import to_contract_type, typed_null
from clickloom.functions.times import ntz
from clickloom.schema import BATCH_ID, EVENT_PARTITIONS, EVENTS_SCHEMA
from clickloom.sources.tables import (
    bounded_sort,
    create_events_table,
    day_source,
    drop_partitions,
    overwrite_partitions,
    replaced_by,
    spread,
    table_partitions,
    with_event_day,
    write_partitioned,
)


REPLACED_COLUMNS = ["event_id", "domain_sessionid"]


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def fields_by_name(df: DataFrame) -> dict[str, T.StructField]:
    """Fields by lower-case name; two whose names differ only in case are an error."""
    repeated = [name for name, n in Counter(c.lower() for c in df.columns).items() if n > 1]
    if repeated:
        raise ValueError(f"column names differ only in case: {sorted(repeated)}")
    return {f.name.lower(): f for f in df.schema}


def to_contract(df: DataFrame, *also: str) -> DataFrame:
    """The contract's columns in its order, matched by name without regard to case.

    Values are cast to the declared type, missing columns become typed NULLs,
    further columns are dropped, but for those named in ``also``. Two columns
    whose names differ only in case are an error.
    """
    source = fields_by_name(df)
    return df.select(*[_contract_column(df, source.get(f.name), f).alias(f.name) for f in EVENTS_SCHEMA], *also)


def _contract_column(df: DataFrame, source: T.StructField | None, field: T.StructField) -> Column:
    if source is None:
        return typed_null(field.dataType)
    return to_contract_type(df[f"`{source.name}`"], source.dataType, field)


def since(df: DataFrame, tstamp: str, moment: datetime) -> DataFrame:
    """Rows at or after ``moment``, read as UTC if it has no zone.

    Serves as cutover filter on the load and as start date of the models.
    """
    if isinstance(df.schema[tstamp].dataType, T.TimestampType):
        text = moment.isoformat(sep=" ") + ("" if moment.tzinfo else "+00:00")
        return df.where(F.col(tstamp) >= F.lit(text).cast("timestamp"))
    return df.where(F.col(tstamp) >= ntz(moment))


def normalize_events(
    source: DataFrame, cutover: datetime | None = None, row_limit: int | None = None
) -> DataFrame:
    """Nested source events as the contract.

    The cutover is applied to the source's own column, where it can reach the
    scan. ``row_limit`` takes any rows, for smoke tests.
    """
    if cutover is not None:
        source = since(source, "load_tstamp", cutover)
    events = to_contract(source)
    return events if row_limit is None else events.limit(row_limit)


def normalize_into(
    source: DataFrame,
    table: str,
    cutover: datetime | None = None,
    row_limit: int | None = None,
    replace: bool = True,
    day_from: str = "load_tstamp",
) -> int:
    """Create the partitioned table from nested events; returns its row count."""
    spark = source.sparkSession
    events = with_event_day(normalize_events(source, cutover, row_limit), day_from)
    write_partitioned(events, table, ["event_day", "event_name"], replace)
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('day_from' = '{day_from}')")
    return spark.table(table).count()


def append_normalized(source: DataFrame, table: str, cutover: datetime | None = None) -> None:
    """Further nested events into a table that ``normalize_into`` made; ``refresh_files`` finds them."""
    spark = source.sparkSession
    events = with_event_day(normalize_events(source, cutover), day_source(spark, table))
    rows = events.select(*spark.table(table).columns)
    with bounded_sort(rows):
        spread(rows, ["event_day", "event_name"]).write.mode("append").insertInto(table)


def load_events(
    spark: SparkSession,
    source: DataFrame | str,
    table: str,
    batch_id: str,
    append: bool = True,
    day_from: str = "collector_tstamp",
) -> None:
    """Load event files (or a DataFrame) into the events table by column name.

    ``append=False`` drops and recreates the table first. A batch that is
    loaded again replaces what was loaded under its id: partition by partition
    where it has rows again, then by dropping those where it has none. An
    interrupted load leaves old or new rows in each partition and is put right
    by repeating it. Before that, event and session ids of the old rows are noted
    for the refresh, which could not know them otherwise.
    """
    if not append:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"DROP TABLE IF EXISTS {replaced_by(table)}")
    create_events_table(spark, table, day_from)
    rows = read_files(spark, source) if isinstance(source, str) else source
    rows = with_event_day(to_contract(rows), day_source(spark, table)).withColumn(BATCH_ID, F.lit(batch_id))
    held = table_partitions(spark, table, EVENT_PARTITIONS, {BATCH_ID: batch_id}).collect()
    if held:
        old = spark.table(table).where(F.col(BATCH_ID) == batch_id).select(*REPLACED_COLUMNS, BATCH_ID).distinct()
        old.write.format("parquet").mode("append").partitionBy(BATCH_ID).saveAsTable(replaced_by(table))
    overwrite_partitions(rows, table, EVENT_PARTITIONS)
    if held:
        filled = set(rows.select(*EVENT_PARTITIONS).distinct().collect())
        # not every catalog drops by a part of the partition key
        drop_partitions(spark, table, EVENT_PARTITIONS, [r for r in held if r not in filled])


def replaced_rows(spark: SparkSession, table: str, batch_id: str) -> DataFrame | None:
    """Event and session ids that earlier loads of the batch held, None if it was loaded once."""
    if not spark.catalog.tableExists(replaced_by(table)):
        return None
    return spark.table(replaced_by(table)).where(F.col(BATCH_ID) == batch_id).select(*REPLACED_COLUMNS)


def forget_replaced(spark: SparkSession, table: str, batch_id: str) -> None:
    if spark.catalog.tableExists(replaced_by(table)):
        drop_partitions(spark, replaced_by(table), [BATCH_ID], [Row(**{BATCH_ID: batch_id})])
