"""Cloning a template into event batches that follow each other in time."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.contexts import suffix_id, suffix_json_ids
from clickloom.functions.times import add_micros, micros_between, ntz, timestamp_text
from clickloom.schema import CONTEXT_COLUMNS, ID_COLUMNS, TIMESTAMP_COLUMNS

MICROSECOND = timedelta(microseconds=1)

# Formats of the id suffix and of the batch name.
SUFFIX_FORMAT = "__b%03d"
BATCH_NAME_FORMAT = "batch_%03d_%s"
BATCH_NAME_TIME = "yyyyMMdd'T'HHmmss"


@dataclass(frozen=True)
class CloneSchedule:
    """When each copy of the template starts and how far its time is compressed."""

    batches: int
    template_min: datetime
    template_max: datetime
    window: timedelta | None = None
    gap: timedelta = timedelta(hours=1)
    fixed_spacing: timedelta | None = None

    @classmethod
    def for_template(cls, template: DataFrame, batches: int, **options) -> "CloneSchedule":
        """Bounds measured in one aggregate over a single column."""
        tstamp = F.col("collector_tstamp").cast("timestamp_ntz")
        low, high = template.agg(F.min(tstamp), F.max(tstamp)).first()
        if low is None:
            raise ValueError("the template has no event time")
        return cls(batches, low, high, **options)

    @property
    def template_span(self) -> timedelta:
        return self.template_max - self.template_min

    @property
    def scale(self) -> float:
        if self.window is None or not self.template_span:
            return 1.0
        return self.window / self.template_span

    @property
    def scaled_span(self) -> timedelta:
        """The time a batch takes: the template's span by ``scale``, to the microsecond."""
        return self.template_span if self.window is None or not self.template_span else self.window

    @property
    def spacing(self) -> timedelta:
        if self.fixed_spacing is not None:
            return self.fixed_spacing
        return self.template_span + self.gap if self.window is None else self.window

    def start(self, index: Column) -> Column:
        return add_micros(ntz(self.template_min), index.cast("bigint") * F.lit(self.spacing // MICROSECOND))

    def shift(self, moment: Column, index: Column) -> Column:
        """``moment`` moved into batch ``index``; the order of events is kept."""
        offset = micros_between(ntz(self.template_min), moment)
        if self.scale != 1.0:
            offset = F.floor(offset * F.lit(self.scale)).cast("bigint")
        return add_micros(self.start(index), offset)


def batch_suffix(index: Column) -> Column:
    return F.format_string(SUFFIX_FORMAT, index)


def batch_name(index: Column, start: Column) -> Column:
    return F.format_string(BATCH_NAME_FORMAT, index, F.date_format(start, BATCH_NAME_TIME))


def fan_out(template: DataFrame, schedule: CloneSchedule) -> DataFrame:
    """Every template row once per batch, as ``batch_index``; no join, no shuffle."""
    indexes = F.sequence(F.lit(0), F.lit(schedule.batches - 1))
    return template.withColumn("batch_index", F.explode(indexes))


def shift_times(df: DataFrame, schedule: CloneSchedule, index: Column) -> DataFrame:
    """Shift the timestamp columns; a column of text stays a column of text."""
    types = dict(df.dtypes)
    shifted = {}
    for c in df.columns:
        if c.lower() in TIMESTAMP_COLUMNS:
            moved = schedule.shift(F.col(c).cast("timestamp_ntz"), index)
            shifted[c] = timestamp_text(moved) if types[c] == "string" else moved
    return df.withColumns(shifted)


def suffix_ids(df: DataFrame, index: Column) -> DataFrame:
    suffix = batch_suffix(index)
    return df.withColumns({c: suffix_id(F.col(c), suffix) for c in df.columns if c.lower() in ID_COLUMNS})


def suffix_context_ids(df: DataFrame, index: Column) -> DataFrame:
    suffix = batch_suffix(index)
    return df.withColumns(
        {c: suffix_json_ids(F.col(c), suffix) for c in df.columns if c.lower() in CONTEXT_COLUMNS}
    )


def clone_batches(template: DataFrame, schedule: CloneSchedule) -> DataFrame:
    """All batches in one narrow job: shifted times and fresh ids, plus ``batch_index``."""
    index = F.col("batch_index")
    copies = shift_times(fan_out(template, schedule), schedule, index)
    return suffix_context_ids(suffix_ids(copies, index), index)


def manifest_header(spark: SparkSession, schedule: CloneSchedule, template_uri: str, template_rows: int) -> DataFrame:
    """One row: the template a run of batches comes from and how it was spread out."""
    hours = None if schedule.window is None else schedule.window / timedelta(hours=1)
    return spark.range(1).select(
        F.lit(template_uri).alias("template_uri"),
        F.lit(template_rows).cast("bigint").alias("template_rows"),
        ntz(schedule.template_min).alias("template_collector_tstamp_min"),
        ntz(schedule.template_max).alias("template_collector_tstamp_max"),
        F.lit(hours).cast("double").alias("window_hours"),
        F.lit(schedule.spacing / timedelta(seconds=1)).alias("batch_spacing_seconds"),
    )


def batch_manifest(spark: SparkSession, schedule: CloneSchedule, batches: DataFrame, prefix: str) -> DataFrame:
    """One row per batch: scheduled bounds next to the measured rows and bounds.

    ``prefix`` is the folder that ``write_batches`` wrote to.
    """
    index = F.col("batch_index")
    span = schedule.scaled_span // MICROSECOND
    tstamp = F.col("collector_tstamp").cast("timestamp_ntz")
    measured = batches.groupBy("batch_index").agg(
        F.count("*").alias("rows"),
        F.min(tstamp).alias("measured_tstamp_min"),
        F.max(tstamp).alias("measured_tstamp_max"),
    )
    scheduled = (
        spark.range(schedule.batches)
        .select(F.col("id").cast("int").alias("batch_index"))
        .withColumn("collector_tstamp_min", schedule.start(index))
        .withColumn("collector_tstamp_max", add_micros(F.col("collector_tstamp_min"), F.lit(span)))
        .withColumn("suffix", batch_suffix(index))
        .withColumn("name", batch_name(index, F.col("collector_tstamp_min")))
        .withColumn("uri", F.concat(F.lit(prefix.rstrip("/") + "/batch_index="), index.cast("string")))
    )
    return scheduled.join(measured, "batch_index", "left").withColumn(
        "rows", F.coalesce("rows", F.lit(0).cast("bigint"))
    )
