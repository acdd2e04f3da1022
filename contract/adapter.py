"""The driver's ``events`` table as contract events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.plans.models import ModelOptions
from clickloom.schema import WEB_PAGE
from clickloom.sources.loading import to_contract

OPTIONS = ModelOptions(page_view_event="view")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_events(raw: DataFrame) -> DataFrame:
    """One-day sessions; three page-view ids a session, taken from the properties."""
    user = F.col("user_id").cast("string")
    session = F.concat_ws("_", user, F.date_format("ts", "yyyyMMdd"))
    k = F.get_json_object("props", "$.k").cast("int")
    view_id = F.concat_ws("_", session, (k % 3).cast("string"))
    return raw.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").alias("collector_tstamp"),
        F.col("ts").alias("derived_tstamp"),
        F.col("ts").alias("load_tstamp"),
        user.alias("domain_userid"),
        session.alias("domain_sessionid"),
        F.col("event_type").alias("event_name"),
        F.col("value").cast("string").alias("se_value"),
        F.col("value").alias("tr_total"),
        F.concat(F.lit("https://example.org/"), "event_type", F.lit("/"), k.cast("string")).alias("page_url"),
        F.concat(F.lit("Page "), k.cast("string")).alias("page_title"),
        (k * 10).alias("pp_yoffset_max"),
        F.to_json(F.array(F.struct(view_id.alias("id")))).alias(WEB_PAGE),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_contract(as_events(read_table(spark, sf_dir, "events")))
