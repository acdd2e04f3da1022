"""Event files as a stream: every micro-batch is loaded and followed by a refresh."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.plans.models import ModelOptions
from clickloom.plans.refresh import refresh
from clickloom.schema import EVENTS_SCHEMA
from clickloom.sources.loading import load_events
from clickloom.sources.tables import Zones


def stream_files(
    spark: SparkSession,
    folder: str,
    schema: T.StructType = EVENTS_SCHEMA,
    files_per_batch: int | None = None,
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_refresh(
    stream: DataFrame,
    zones: Zones,
    checkpoint: str,
    options: ModelOptions = ModelOptions(),
    prefix: str = "stream",
) -> StreamingQuery:
    """Take in what is available and stop.

    The batch id is the id of the query, which its checkpoint keeps, and the number
    of the micro-batch. After a failure Spark repeats the last micro-batch under
    its number, which replaces what it had loaded; another checkpoint is another
    query and never touches these batches. Micro-batches run in a session of
    their own: refresh tables that the caller has read before.
    Nothing relies on the order of files, so no watermark is needed: a late
    event changes the session it belongs to whenever it comes.
    """

    def take_in(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        batch_id = f"{prefix}_{_query_id(spark, checkpoint)}_{number:012d}"
        load_events(spark, rows, zones.events, batch_id)
        refresh(spark, zones, batch_id, options)

    return (
        stream.writeStream.foreachBatch(take_in)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _query_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that the query keeps in its checkpoint, from its first start on."""
    stored = spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
    return json.loads(stored)["id"]
