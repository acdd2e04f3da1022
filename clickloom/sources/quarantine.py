"""Loading with a reject table: one unreadable value does not end the load of a batch."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clickloom.functions.times import text_to_ntz_or_null
from clickloom.schema import BATCH_ID, EVENT_COLUMNS, EVENTS_SCHEMA
from clickloom.session import Scratch
from clickloom.sources.loading import fields_by_name, load_events, read_files, to_contract
from clickloom.sources.tables import Zones, drop_partitions, overwrite_partitions

REJECTED, SOURCE_ROW = "_rejected", "_source_row"


@dataclass(frozen=True)
class LoadReport:
    """Rows of a batch: read, loaded, left out; and the values for which rows were left out."""

    rows: int
    kept: int
    rejected: int
    values: int


def route(source: DataFrame) -> DataFrame:
    """The contract's columns, with the values that could not be read in ``_rejected``.

    ``_rejected`` is an array of (column_name, text), empty for a row that is to
    be loaded; ``_source_row`` is the JSON of a row that is not. A value is
    unreadable if it is not NULL and its cast to the contract's type gives
    NULL or would end the load. A bad colour depth is NULL by contract and not rejected.
    """
    given = fields_by_name(source)
    whole = F.struct(*[F.col(f"`{c}`") for c in source.columns])
    typed, bad = {}, []
    for field in EVENTS_SCHEMA:
        found = given.get(field.name)
        if found is None or not _can_fail(found.dataType, field):
            continue
        raw = F.col(f"`{found.name}`")
        typed[found.name] = _or_null(raw, found.dataType, field)
        value = F.struct(F.lit(field.name).alias("column_name"), raw.cast("string").alias("text"))
        bad.append(F.when(raw.isNotNull() & typed[found.name].isNull(), value))
    listed = F.array(*bad).cast("array<struct<column_name:string,text:string>>")
    routed = source.withColumns({**typed, REJECTED: F.filter(listed, lambda b: b.isNotNull()), SOURCE_ROW: whole})
    kept = to_contract(routed, REJECTED, SOURCE_ROW)
    return kept.withColumn(SOURCE_ROW, F.when(F.size(REJECTED) > 0, F.to_json(SOURCE_ROW)))


def load_or_reject(spark: SparkSession, source: DataFrame | str, zones: Zones, batch_id: str) -> LoadReport:
    """Load the readable rows of a batch; put the others, a row per unreadable value, into the reject table.

    The batch is cast once, into an intermediate table on whose write the rows
    are counted. A batch that is loaded again replaces its rows and its rejects.
    """
    rows = read_files(spark, source) if isinstance(source, str) else source
    create_rejects(spark, zones)
    seen = Observation()
    values = F.size(REJECTED)
    counts = [F.count("*").alias("rows"), F.count_if(values > 0).alias("rejected"), F.sum(values).alias("values")]
    with Scratch(spark) as scratch:
        staged = scratch.save(route(rows).observe(seen, *counts), "routed")
        found = seen.get
        if found["rejected"]:
            bad = staged.where(values > 0).select("event_id", F.inline(REJECTED), F.col(SOURCE_ROW).alias("source_row"))
            overwrite_partitions(bad.withColumn(BATCH_ID, F.lit(batch_id)), zones.rejects, [BATCH_ID])
        else:
            drop_partitions(spark, zones.rejects, [BATCH_ID], [Row(**{BATCH_ID: batch_id})])
        load_events(spark, staged.where(values == 0).select(*EVENT_COLUMNS), zones.events, batch_id)
    return LoadReport(found["rows"], found["rows"] - found["rejected"], found["rejected"], found["values"] or 0)


def create_rejects(spark: SparkSession, zones: Zones) -> None:
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {zones.rejects} (event_id STRING, column_name STRING, text STRING, "
        f"source_row STRING, {BATCH_ID} STRING) USING parquet PARTITIONED BY ({BATCH_ID})"
    )


def _can_fail(source: T.DataType, field: T.StructField) -> bool:
    """Whether a value of this type may be unreadable: text and numbers in another type."""
    if isinstance(field.dataType, T.StringType) or source == field.dataType:
        return False
    if field.name == "br_colordepth" and isinstance(source, T.StringType):
        return False
    return isinstance(source, (T.StringType, T.NumericType))


def _or_null(column: Column, source: T.DataType, field: T.StructField) -> Column:
    if isinstance(field.dataType, T.TimestampNTZType) and isinstance(source, T.StringType):
        return text_to_ntz_or_null(column)
    return column.try_cast(field.dataType)
