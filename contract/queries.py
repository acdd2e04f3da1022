"""The registered queries. Each runs over the whole tables it names."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions.casts import safe_int, typed_null
from clickloom.functions.contexts import context_value, extract_contexts, is_json, nested_to_json
from clickloom.functions.times import add_micros, day_from_number, day_number, micros_between, ntz, parse_zoned
from clickloom.operators import audit, clone
from clickloom.operators.dedup import dedup_events
from clickloom.operators.enrich import enrich
from clickloom.operators.filters import in_list, in_partition, on_day
from clickloom.operators.fingerprint import compare_fingerprints, fingerprints, untouched
from clickloom.operators.merge import before_image, keyed_rows, merge_update
from clickloom.operators.repair import repair_contexts, repair_counts, repair_files, repaired
from clickloom.operators.staged_merge import staged_merge, undo_merge
from clickloom.operators.verify import source_metrics, verify, verify_count
from clickloom.plans import models
from clickloom.plans.event_index import id_hash, possible_places
from clickloom.plans.file_refresh import refresh_files
from clickloom.plans.incremental import run_incremental
from clickloom.plans.probe import merge_probe
from clickloom.plans.refresh import refresh
from clickloom.schema import CONTEXT_COLUMNS, EVENT_DAY, EVENT_PARTITIONS, IAB, UA, WEB_PAGE, WEB_VITALS
from clickloom.session import Scratch, shared_dir
from clickloom.sources.batches import read_header, read_manifest, write_batches, write_manifest
from clickloom.sources.loading import append_normalized, load_events, normalize_events, normalize_into, since, to_contract
from clickloom.sources.quarantine import load_or_reject
from clickloom.sources.seeds import read_seed
from clickloom.sources.tables import Zones, contract_events, create_zones, drop_partitions, preview, reset_zones, table_partitions
from clickloom.streaming.refresh import start_refresh, stream_files
from contract.adapter import OPTIONS, as_events, events, read_table

MERGE_KEY = ["event_id", "collector_tstamp", "event_name"]
DAY, NAME = date(2024, 1, 15), "view"
STREAMED_ROWS = 500_000
BATCHES = [["view"], ["click", "error"], ["purchase", "signup"]]


# --- tables the queries work on -------------------------------------------------


def new_zones(spark: SparkSession) -> Zones:
    zones = Zones.with_prefix(f"run_{uuid.uuid4().hex[:12]}")
    create_zones(spark, zones, shared_dir(spark))
    return zones


def new_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/files_{uuid.uuid4().hex}"


def loaded(spark: SparkSession, sf_dir: str) -> Zones:
    """A real events table: Parquet, partitioned by day, event name and batch."""
    zones = new_zones(spark)
    load_events(spark, as_events(read_table(spark, sf_dir, "events")), zones.events, "all")
    return zones


_loaded: dict[tuple[str, str], Zones] = {}
_refreshed: dict[tuple[str, str], Zones] = {}


def loaded_once(spark: SparkSession, sf_dir: str) -> Zones:
    """The same for queries that only read it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _loaded:
        _loaded[key] = loaded(spark, sf_dir)
    return _loaded[key]


def refreshed(spark: SparkSession, sf_dir: str) -> Zones:
    """Derived tables after three batches that split almost every session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _refreshed:
        zones = new_zones(spark)
        rows = events(spark, sf_dir)
        for number, names in enumerate(BATCHES):
            load_events(spark, rows.where(F.col("event_name").isin(names)), zones.events, f"batch_{number}")
            refresh(spark, zones, f"batch_{number}", OPTIONS)
        _refreshed[key] = zones
    return _refreshed[key]


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "events").withColumn("event_id", F.col("event_id").cast("string"))


def k_of(column: str = "props"):
    return F.get_json_object(column, "$.k").cast("int")


def zoned(column: str):
    """A zoned timestamp showing the same wall clock in UTC."""
    return F.timestamp_micros(micros_between(ntz(datetime(1970, 1, 1)), F.col(column)))


# --- models -----------------------------------------------------------------------


def stored_activity(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Scratch]:
    scratch = Scratch(spark)
    return scratch.save(models.activity_of(events(spark, sf_dir), OPTIONS), "activity"), scratch


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    activity, scratch = stored_activity(spark, sf_dir)
    return models.page_views(models.index_page_views(activity, scratch, OPTIONS))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.sessions(models.session_rollup(models.activity_of(events(spark, sf_dir), OPTIONS)))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.users(sessions(spark, sf_dir))


def page_views_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(refreshed(spark, sf_dir).page_views)


def sessions_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(refreshed(spark, sf_dir).sessions)


def users_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(refreshed(spark, sf_dir).users).drop("last_seen_day")


def refresh_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = spark.table(refreshed(spark, sf_dir).session_state)
    return state.select("domain_sessionid", "first_day", "last_day", "last_batch")


def write_stream(rows: DataFrame, files: str) -> int:
    """Three files by event name, of which two are a micro-batch; each as several where rows are many. Returns how many."""
    pieces = rows.count() // STREAMED_ROWS + 1
    piece = [F.pmod(F.xxhash64("event_id"), F.lit(pieces))] if pieces > 1 else []
    rows.repartition(3 * pieces, "event_name", *piece).write.parquet(files)
    return pieces


def streamed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, zones = new_path(spark), new_zones(spark)
    pieces = write_stream(events(spark, sf_dir), files)
    start_refresh(stream_files(spark, files, files_per_batch=2 * pieces), zones, new_path(spark), OPTIONS).awaitTermination()
    return spark.table(zones.sessions)


_reloaded: dict[tuple[str, str], Zones] = {}


def reloaded(spark: SparkSession, sf_dir: str) -> Zones:
    """Three batches, the second loaded again with fewer and other events.

    At first it holds earlier copies of views, in sessions of their own, which win.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _reloaded:
        zones = new_zones(spark)
        rows = events(spark, sf_dir)
        k = F.get_json_object(WEB_PAGE, "$[0].id")
        views = rows.where((F.col("event_name") == "view") & (F.xxhash64(k) % 3 == 0))
        copies = views.withColumns(
            {
                "domain_sessionid": F.concat(F.lit("x_"), "domain_sessionid"),
                **{c: F.col(c) - F.expr("INTERVAL 3 HOURS") for c in ("collector_tstamp", "derived_tstamp")},
            }
        )
        errors = rows.where((F.col("event_name") == "error") & (F.col("pp_yoffset_max") >= 500))
        clicks = rows.where(F.col("event_name") == "click")
        first = rows.where(F.col("event_name").isin("click", "error")).unionByName(copies)
        loads = [("batch_0", rows.where(F.col("event_name") == "view")), ("batch_1", first)]
        loads += [("batch_2", rows.where(F.col("event_name").isin("purchase", "signup"))), ("batch_1", clicks.unionByName(errors))]
        for name, batch in loads:
            load_events(spark, batch, zones.events, name)
            refresh(spark, zones, name, OPTIONS)
        _reloaded[key] = zones
    return _reloaded[key]


def sessions_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(reloaded(spark, sf_dir).sessions)


def users_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(reloaded(spark, sf_dir).users).drop("last_seen_day")


def page_views_reloaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(reloaded(spark, sf_dir).page_views)


def normalized_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions from the normalised table, refreshed by its files.

    At first purchases lie three hours early in sessions of their own. Then their
    partitions are dropped, and all events that are missing are added.
    """
    zones = new_zones(spark)
    rows = as_events(read_table(spark, sf_dir, "events"))
    purchases = rows.where(F.col("event_name") == "purchase")
    early = purchases.withColumns(
        {
            "domain_sessionid": F.concat(F.lit("x_"), "domain_sessionid"),
            **{c: F.col(c) - F.expr("INTERVAL 3 HOURS") for c in ("collector_tstamp", "derived_tstamp", "load_tstamp")},
        }
    )
    normalize_into(rows.where(F.col("event_name") == "view").unionByName(early), zones.events)
    refresh_files(spark, zones, OPTIONS)
    held = table_partitions(spark, zones.events, [EVENT_DAY, "event_name"]).where(F.col("event_name") == "purchase")
    drop_partitions(spark, zones.events, [EVENT_DAY, "event_name"], held.collect())
    append_normalized(rows.where(F.col("event_name") != "view"), zones.events)
    refresh_files(spark, zones, OPTIONS)
    return spark.table(zones.sessions)


def refresh_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch and day, event ids and how many of them the index of event ids finds there."""
    zones = refreshed(spark, sf_dir)
    ids = spark.table(zones.events).select("event_id", EVENT_DAY, "batch_id", id_hash(F.col("event_id")).alias("hash"))
    places = possible_places(spark.table(zones.event_index), ids, ids.count()).withColumnRenamed("source", "batch_id")
    there = ids.join(places.withColumn("found", F.lit(1)).distinct(), ["hash", EVENT_DAY, "batch_id"], "left")
    return there.groupBy("batch_id", EVENT_DAY).agg(
        F.count_distinct("event_id").alias("ids"), F.count_distinct(F.when(F.col("found") == 1, F.col("event_id"))).alias("found")
    )


def sessions_with_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: a context that is switched on after the first, another on for the second alone.

    Events of even ``k`` have both contexts, so the first event of a session may have none.
    """
    zones = new_zones(spark)
    raw_events = read_table(spark, sf_dir, "events")
    rows = as_events(raw_events).join(
        raw_events.where(k_of() % 2 == 0).select(
            F.col("event_id").cast("string").alias("event_id"),
            *[F.concat(F.lit("["), "props", F.lit("]")).alias(c) for c in (UA, IAB)],
        ),
        "event_id",
        "left",
    )
    for number, (names, ua, iab) in enumerate(zip(BATCHES, (False, True, True), (False, True, False))):
        contexts = (
            models.ModelContext(UA, (("ua_k", "$[0].k", "int"),), ua),
            models.ModelContext(IAB, (("iab_k", "$[0].k", "int"),), iab),
            models.ModelContext(WEB_VITALS, (("lcp", "$.lcp", "double"),), True),
        )
        load_events(spark, rows.where(F.col("event_name").isin(names)), zones.events, f"batch_{number}")
        refresh(spark, zones, f"batch_{number}", replace(OPTIONS, contexts=contexts))
    return spark.table(zones.sessions)


def start_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = models.ModelOptions("view", start_date=datetime(2024, 1, 20))
    return models.sessions(models.session_rollup(models.activity_of(events(spark, sf_dir), options))).select(
        "domain_sessionid", "start_tstamp", "end_tstamp", "events"
    )


def dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event twice more: an exact copy and a later one with another value."""
    rows = events(spark, sf_dir).select("event_id", "collector_tstamp", "domain_sessionid", "tr_total")
    later = rows.withColumns(
        {"collector_tstamp": add_micros(F.col("collector_tstamp"), F.lit(1)), "tr_total": F.col("tr_total") + 1}
    )
    return dedup_events(rows.unionByName(rows).unionByName(later))


def context_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two populated contexts of which one is enabled, one that is missing."""
    listed = F.concat(F.lit("["), "props", F.lit("]"))
    rows = raw(spark, sf_dir).select(
        "event_id",
        F.to_json(F.array(F.struct(F.col("event_type").alias("id")))).alias(WEB_PAGE),
        listed.alias(UA),
        listed.alias(IAB),
    )
    fields = {
        WEB_PAGE: {"web_page_id": ("$[0].id", "string")},
        UA: {"ua_k": ("$[0].k", "int")},
        IAB: {"iab_k": ("$[0].k", "int")},
        WEB_VITALS: {"vitals": ("$.lcp", "double")},
    }
    wide = extract_contexts(rows, fields, enabled=[UA, WEB_VITALS])
    return wide.select("event_id", "web_page_id", "ua_k", "iab_k", "vitals")


# --- ingest -----------------------------------------------------------------------


def load_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upper-case names in reverse order, a column too many, most columns missing."""
    zones = new_zones(spark)
    source = as_events(read_table(spark, sf_dir, "events"))
    source = source.withColumn("collector_tstamp", F.col("collector_tstamp").cast("string"))
    upper = source.select(*[F.col(c).alias(c.upper()) for c in reversed(source.columns)], F.lit(1).alias("EXTRA"))
    load_events(spark, upper, zones.events, "upper")
    return contract_events(spark, zones.events)


def replace_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load that appends nothing: the table has the second source alone."""
    zones, source = new_zones(spark), as_events(read_table(spark, sf_dir, "events"))
    load_events(spark, source, zones.events, "all")
    load_events(spark, source.where(F.col("event_name") == "click"), zones.events, "clicks", append=False)
    return spark.table(zones.events).select("event_id", "event_name")


def row_limit_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = f"{new_zones(spark).raw}.some"
    normalize_into(nested_source(spark, sf_dir), table, row_limit=100)
    return spark.table(table).agg(F.count("*").alias("rows"))


def reset_zones_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load into zones that were reset after another one."""
    zones = loaded(spark, sf_dir)
    reset_zones(spark, zones, shared_dir(spark))
    load_events(spark, events(spark, sf_dir).where(F.col("event_name") == "view"), zones.events, "views")
    return spark.table(zones.events).agg(F.count("*").alias("rows"))


def load_zoned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text times of mixed offsets, and without any."""
    source = as_events(read_table(spark, sf_dir, "events"))
    text = F.date_format("collector_tstamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    offset = F.when(F.col("event_name") == "view", "+02:00").when(F.col("event_name") == "click", " -05:30")
    offset = offset.when(F.col("event_name") == "error", "Z").otherwise("")
    return to_contract(source.withColumn("collector_tstamp", F.concat(text, offset))).select("event_id", "collector_tstamp")


def nested_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver events in the types of the nested source: zoned times, decimals, structs."""
    k = k_of()
    return raw(spark, sf_dir).select(
        "event_id",
        zoned("ts").alias("collector_tstamp"),
        zoned("ts").alias("load_tstamp"),
        F.col("event_type").alias("event_name"),
        k.alias("txn_id"),
        F.col("value").alias("se_value"),
        F.col("value").cast("decimal(18,2)").alias("tr_total"),
        F.col("value").cast("decimal(18,2)").alias("ti_price"),
        F.when(F.col("event_type") == "view", k.cast("string"))
        .when(F.col("event_type") == "click", F.concat(k.cast("string"), F.lit(".7")))
        .otherwise(F.col("event_type"))
        .alias("br_colordepth"),
        F.array(F.struct(k.cast("string").alias("id"), F.lit(None).cast("string").alias("note"))).alias(WEB_PAGE),
        F.lit("dropped").alias("other_context"),
    )


NORMALIZED = [
    "event_id", "collector_tstamp", "load_tstamp", "event_name", "txn_id", "tr_total", "ti_price", "tr_tax",
    "br_colordepth", WEB_PAGE, UA, IAB,
]


def quarantined(spark: SparkSession, sf_dir: str) -> Zones:
    """Every seventh amount and every fifth time is text that cannot be read."""
    zones = new_zones(spark)
    rows = as_events(read_table(spark, sf_dir, "events"))
    number = F.col("event_id").cast("bigint")
    amount = F.when(number % 7 == 0, "n/a").otherwise(F.col("tr_total").cast("string"))
    moment = F.when(number % 5 == 0, "soon").otherwise(F.col("load_tstamp").cast("string"))
    load_or_reject(spark, rows.withColumns({"tr_total": amount, "load_tstamp": moment}), zones, "all")
    return zones


def load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(quarantined(spark, sf_dir).rejects).select("event_id", "column_name", "text", "batch_id")


def load_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(quarantined(spark, sf_dir).events).select("event_id", "load_tstamp", "tr_total", "page_url")


def run_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of a run of three batches that ends after two and is resumed."""
    path, zones = new_path(spark), new_zones(spark)
    rows = as_events(read_table(spark, sf_dir, "events"))
    places = [(i, f"batch_{i}", f"{path}/{i}") for i in range(len(BATCHES))]
    for (_, _, uri), names in zip(places, BATCHES):
        rows.where(F.col("event_name").isin(names)).write.parquet(uri)
    manifest = spark.createDataFrame(places, "batch_index INT, name STRING, uri STRING")
    run_incremental(spark, zones, manifest, limit=2, options=OPTIONS)
    run_incremental(spark, zones, manifest, options=OPTIONS, resume=True)
    return spark.table(zones.run_steps).select(
        "step", "phase", F.array_join("batches", ",").alias("batches"), "row_count", "min_collector_tstamp", "max_collector_tstamp"
    )


def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize_events(nested_source(spark, sf_dir)).select(*NORMALIZED)


def cutover(spark: SparkSession, sf_dir: str) -> DataFrame:
    normalized = normalize_events(nested_source(spark, sf_dir), cutover=datetime(2024, 1, 17, 19, 47))
    return normalized.select("event_id", "load_tstamp")


def cutover_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A moment with an offset against a zoned and a plain column."""
    moment = datetime(2024, 1, 17, 19, 47, tzinfo=timezone(timedelta(hours=2)))
    source = nested_source(spark, sf_dir)
    zoned_rows = since(source, "load_tstamp", moment).select("event_id", F.lit("zoned").alias("kind"))
    plain = since(to_contract(source), "load_tstamp", moment).select("event_id", F.lit("plain").alias("kind"))
    return zoned_rows.select(F.col("event_id").cast("string").alias("event_id"), "kind").unionByName(plain)


def double_to_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_contract(nested_source(spark, sf_dir)).select("event_id", "se_value")


def safe_int_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = nested_source(spark, sf_dir)
    return source.select("event_id", safe_int(F.col("br_colordepth")).alias("br_colordepth"))


def typed_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    absent = {c: typed_null("string") for c in CONTEXT_COLUMNS[1:4]}
    return raw(spark, sf_dir).select("event_id").withColumns({**absent, "tr_tax": typed_null("double")})


def nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested_source(spark, sf_dir).select("event_id", nested_to_json(WEB_PAGE).alias("web_page"))


def strip_zone_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_contract(nested_source(spark, sf_dir)).select("event_id", "collector_tstamp", "load_tstamp")


def zoned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text with an offset to a zoned timestamp, stripped to UTC."""
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+02:00"))
    parsed = raw(spark, sf_dir).select("event_id", parse_zoned(text).alias("collector_tstamp"))
    return to_contract(parsed).select("event_id", "collector_tstamp")


def day_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = day_number(F.to_date("ts"))
    return raw(spark, sf_dir).select(
        "event_id", number.alias("day_number"), day_from_number(number).alias(EVENT_DAY)
    )


def context_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", context_value(WEB_PAGE, "$[0].id").alias("page_view_id"))


def broken_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal text, nested literal text, JSON, text that is neither, NULL; one per event type."""
    literal = F.replace("props", F.lit('"'), F.lit("'"))
    kind = F.col("event_type")
    text = (
        F.when(kind == "click", literal)
        .when(kind == "purchase", F.concat(F.lit("[{'ok': True, 'none': None, 'of': "), literal, F.lit("}]")))
        .when(kind == "view", F.col("props"))
        .when(kind == "error", F.concat(F.lit("{1, "), literal))
    )
    return raw(spark, sf_dir).select("event_id", text.alias(WEB_PAGE))


def context_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_contexts(broken_contexts(spark, sf_dir)).select("event_id", F.col(WEB_PAGE).alias("context"))


def context_repair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_counts(broken_contexts(spark, sf_dir))


def rewritten_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair as a rewrite of files."""
    source, target = new_path(spark), new_path(spark)
    broken_contexts(spark, sf_dir).write.parquet(source)
    repair_files(spark, source, target)
    return spark.read.parquet(target).select("event_id", F.col(WEB_PAGE).alias("context"))


def context_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON, repeated keys, text after the value, infinity, a literal, two values."""
    k = k_of()
    kind, id_ = k % 6, k.cast("string")
    lone = F.concat(F.lit('[{"id":"'), id_, F.lit('"}]'))
    text = (
        F.when(kind == 0, lone)
        .when(kind == 1, F.concat(F.lit('[{"id":"'), id_, F.lit('","id":"z"}]')))
        .when(kind == 2, F.concat(lone, F.lit(" garbage")))
        .when(kind == 3, F.lit("{'a': 1e999}"))
        .when(kind == 4, F.replace(lone, F.lit('"'), F.lit("'")))
        .otherwise(F.concat(lone, F.lit(" "), lone))
    )
    rows = raw(spark, sf_dir).select("event_id", text.alias("text"))
    return rows.select(
        "event_id",
        is_json(F.col("text")).alias("is_json"),
        context_value("text", "$[0].id").alias("value"),
        repaired("text").alias("repaired"),
    )


def verify_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify(
        events(spark, sf_dir),
        {
            "event_id present": F.col("event_id").isNotNull(),
            "context parses": context_value(WEB_PAGE, "$[0].id").isNotNull(),
            "load time present": F.col("load_tstamp").isNotNull(),
            "is a view": F.col("event_name") == "view",
        },
    )


def verify_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    zones = loaded_once(spark, sf_dir)
    return verify_count(contract_events(spark, zones.events), read_table(spark, sf_dir, "events"))


# --- filters, samples -------------------------------------------------------------


def partition_filter_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.table(loaded_once(spark, sf_dir).events)
    return table.where(in_partition(DAY, NAME)).select("event_id", EVENT_DAY, "event_name")


def partition_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.table(loaded_once(spark, sf_dir).events)
    condition = on_day("collector_tstamp", DAY, day_from="collector_tstamp")
    return table.where(condition & (F.col("event_name") == NAME)).agg(F.count("*").alias("rows"))


def event_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose id is also a customer key."""
    keys = read_table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string"))
    return in_list(events(spark, sf_dir), "event_id", keys).select("event_id", "etl_tags")


def event_in_list_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers against text ids, in a list that is written out and in one that is joined."""
    rows = events(spark, sf_dir)
    short = in_list(rows, "event_id", list(range(1, 51))).select("event_id", F.lit("short").alias("kind"))
    return short.unionByName(in_list(rows, "event_id", list(range(100, 3_000))).select("event_id", F.lit("long").alias("kind")))


def preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten events of the loaded table that were worth most."""
    shown = preview(spark, loaded_once(spark, sf_dir).events, 10, [F.desc("tr_total"), "event_id"])
    return shown.select("event_id", "tr_total")


def limit_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeatable sample of one partition."""
    table = spark.table(loaded_once(spark, sf_dir).events)
    return audit.sample_partition(table, in_partition(DAY, NAME), 10).select(*MERGE_KEY)


# --- cloning ----------------------------------------------------------------------


def template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_events(read_table(spark, sf_dir, "events"))


def compressed(rows: DataFrame) -> clone.CloneSchedule:
    return clone.CloneSchedule.for_template(rows, batches=3, window=timedelta(hours=36))


def spaced(rows: DataFrame) -> clone.CloneSchedule:
    return clone.CloneSchedule.for_template(rows, batches=3)


def shift_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template(spark, sf_dir)
    shifted = clone.shift_times(rows, compressed(rows), F.lit(2))
    return shifted.select("event_id", "collector_tstamp", "derived_tstamp", "load_tstamp")


def suffix_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = to_contract(template(spark, sf_dir))
    return clone.suffix_ids(rows, F.lit(7)).select(
        "event_id", "domain_userid", "domain_sessionid", "txn_id", "event_name"
    )


def json_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ids in one text, one of them nested, spaces before the colon."""
    rows = raw(spark, sf_dir).select(
        "event_id",
        F.concat(
            F.lit('[{"id" : "'), "event_id", F.lit('", "id2": "x", "data": {"id":"'), "event_type", F.lit('"}}]')
        ).alias(WEB_PAGE),
    )
    return clone.suffix_context_ids(rows, F.lit(12)).select("event_id", F.col(WEB_PAGE).alias("context"))


def clone_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template(spark, sf_dir)
    return clone.clone_batches(rows, spaced(rows)).select(
        "batch_index", "event_id", "domain_userid", "domain_sessionid", "collector_tstamp",
        F.col(WEB_PAGE).alias("context"),
    )


def batch_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches written, their manifest written, and read back."""
    rows = template(spark, sf_dir)
    schedule, files, manifest = compressed(rows), new_path(spark), new_path(spark)
    write_batches(clone.clone_batches(rows, schedule), files)
    written = spark.read.parquet(files)
    write_manifest(clone.batch_manifest(spark, schedule, written, files), manifest)
    return read_manifest(spark, manifest).drop("uri")


def manifest_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = template(spark, sf_dir), new_path(spark)
    write_manifest(clone.manifest_header(spark, compressed(rows), "events", rows.count()), path)
    return read_header(spark, path)


def source_metrics_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_metrics(events(spark, sf_dir))


def event_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = template(spark, sf_dir)
    return clone.clone_batches(rows, spaced(rows)).groupBy("batch_index").agg(
        F.min("collector_tstamp").alias("tstamp_min"), F.max("collector_tstamp").alias("tstamp_max")
    )


# --- partitions, merge, audit -----------------------------------------------------


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file list derived from events: one file per partition and user.

    Files of `error` events are deleted ones, files of `signup` hold deletes.
    """
    day = F.to_date("ts").alias("day")
    files = raw(spark, sf_dir).groupBy(
        F.struct(day, F.col("event_type").alias("event_name")).alias("partition"), "user_id"
    ).agg(F.count("*").alias("record_count"))
    name = F.col("partition.event_name")
    return files.select(
        "partition",
        F.concat_ws("/", F.col("partition.day").cast("string"), name, "user_id").alias("path"),
        "record_count",
        F.when(name == "error", audit.DELETED).otherwise(audit.ADDED).alias("status"),
        F.when(name == "signup", audit.POSITION_DELETE).otherwise(audit.DATA).alias("content"),
    )


def flat(df: DataFrame) -> DataFrame:
    return df.select("partition.*", *[c for c in df.columns if c != "partition"])


def live_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(audit.live_files(inventory(spark, sf_dir)))


def partition_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(audit.partition_stats(inventory(spark, sf_dir)))


def smallest_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flat(audit.smallest_partition(inventory(spark, sf_dir)))


def file_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per partition as the files of a real table hold them."""
    files = audit.file_inventory(spark.table(loaded_once(spark, sf_dir).events), EVENT_PARTITIONS)
    return flat(audit.partition_stats(files)).select(EVENT_DAY, "event_name", "rows")


def rewritten(before: DataFrame) -> DataFrame:
    """The inventory after a write that replaced all files of the clicks."""
    return before.withColumn(
        "path", F.when(F.col("partition.event_name") == "click", F.concat("path", F.lit("/v2"))).otherwise(F.col("path"))
    )


def partition_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = inventory(spark, sf_dir)
    return audit.audit_partitions(before, rewritten(before), F.col("partition.event_name") == "click")


def audit_stray_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same write judged against a smaller target: it fails."""
    before = inventory(spark, sf_dir)
    target = (F.col("partition.event_name") == "click") & (F.col("partition.day") < F.lit(DAY))
    return audit.audit_partitions(before, rewritten(before), target)


def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = inventory(spark, sf_dir)
    return flat(audit.touched_files(before, rewritten(before)))


def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files that the rewrite added."""
    before = inventory(spark, sf_dir)
    return flat(audit.audit_details(before, rewritten(before), F.col("partition.event_name") == "click")["added_detail"])


def latest_of_users(rows: DataFrame) -> DataFrame:
    """Each user's last event, the merge source."""
    last = F.max(F.struct("collector_tstamp", "event_id", "event_name")).alias("last")
    return rows.groupBy("domain_userid").agg(last).select(*[f"last.{c}" for c in MERGE_KEY])


def merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = loaded(spark, sf_dir).events
    merge_update(
        spark,
        table,
        latest_of_users(events(spark, sf_dir)),
        on=MERGE_KEY,
        changes={"etl_tags": F.lit("last of user")},
        partition_by=EVENT_PARTITIONS,
        derive={EVENT_DAY: F.to_date("collector_tstamp")},
    )
    return spark.table(table).select(*MERGE_KEY, "etl_tags")


def merge_undone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two merges in stages, the second one taken back."""
    zones = loaded(spark, sf_dir)
    log, rows = f"{zones.manifest}.merges", events(spark, sf_dir)
    day = {EVENT_DAY: F.to_date("collector_tstamp")}
    staged_merge(spark, zones.events, latest_of_users(rows), MERGE_KEY, {"etl_tags": F.lit("last of user")}, EVENT_PARTITIONS, log, day)
    wrong = {"etl_tags": F.lit("wrong"), "tr_total": F.lit(-1)}
    second = staged_merge(spark, zones.events, rows.select(*MERGE_KEY), MERGE_KEY, wrong, EVENT_PARTITIONS, log, day)
    undo_merge(spark, zones.events, second, log)
    return spark.table(zones.events).select(*MERGE_KEY, "etl_tags", "tr_total")


def merge_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per partition, the rows that a merge had to leave alone, before and after it."""
    table, scratch = loaded(spark, sf_dir).events, Scratch(spark)
    source = scratch.save(latest_of_users(events(spark, sf_dir)), "source")
    rows = spark.table(table)
    before = scratch.save(fingerprints(untouched(rows, source, MERGE_KEY), EVENT_PARTITIONS), "before")
    changes = {"etl_tags": F.lit("last of user")}
    merge_update(spark, table, source, MERGE_KEY, changes, EVENT_PARTITIONS, {EVENT_DAY: F.to_date("collector_tstamp")})
    after = fingerprints(untouched(spark.table(table), source, MERGE_KEY), EVENT_PARTITIONS)
    return compare_fingerprints(before, after, EVENT_PARTITIONS).drop("batch_id")


def literal_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge from rows that are written out: the twenty events worth most."""
    table = loaded(spark, sf_dir).events
    top = events(spark, sf_dir).orderBy(F.desc("tr_total"), "event_id").limit(20).select(*MERGE_KEY).collect()
    source = keyed_rows(spark, [tuple(r) for r in top], "event_id string, collector_tstamp timestamp_ntz, event_name string")
    changes = {"etl_tags": F.concat(F.lit("top "), F.col("s.event_name"))}
    merge_update(spark, table, source, MERGE_KEY, changes, EVENT_PARTITIONS, {EVENT_DAY: F.to_date("collector_tstamp")})
    return spark.table(table).select("event_id", "etl_tags")


def merge_before_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir)
    return before_image(rows, latest_of_users(rows), MERGE_KEY, ["etl_tags", "tr_total"])


def merge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A real merge of one event name's rows, audited against that name's partitions."""
    table = loaded(spark, sf_dir).events
    scratch = Scratch(spark)
    before = scratch.save(audit.file_inventory(spark.table(table), EVENT_PARTITIONS), "before")
    source = events(spark, sf_dir).where(F.col("event_name") == NAME).select(*MERGE_KEY)
    merge_update(
        spark, table, source, MERGE_KEY, {"etl_tags": F.lit("probe")}, EVENT_PARTITIONS,
        {EVENT_DAY: F.to_date("collector_tstamp")},
    )
    after = audit.file_inventory(spark.table(table), EVENT_PARTITIONS)
    result = audit.audit_partitions(before, after, F.col("partition.event_name") == NAME)
    return result.select("touched_outside_target", "pass")


def merge_probe_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows a probe of the smallest partition has marked, with its verdict."""
    zones = loaded(spark, sf_dir)
    report = merge_probe(spark, zones)
    kept = spark.table(f"{zones.manifest}.probe_before").where(F.col("probe_id") == report.probe_id)
    marked = spark.table(zones.events).where(F.col("etl_tags") == "probe").select("event_id")
    outside = F.lit(report.audit["touched_outside_target"])
    return marked.join(kept, "event_id").select("event_id", outside.alias("outside"), F.lit(report.audit["pass"]).alias("pass"))


def seed_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations and regions as CSV seeds on customers."""
    nations, regions = new_path(spark), new_path(spark)
    read_table(spark, sf_dir, "nation").write.csv(nations, header=True)
    read_table(spark, sf_dir, "region").write.csv(regions, header=True)
    nation = read_seed(spark, nations, "n_nationkey INT, n_name STRING, n_regionkey INT")
    region = read_seed(spark, regions, "r_regionkey INT, r_name STRING")
    customers = read_table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    placed = enrich(customers, nation, "n_nationkey").withColumnRenamed("n_regionkey", "r_regionkey")
    return enrich(placed, region, "r_regionkey").select("c_custkey", "n_name", "r_name")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "page_views": page_views,
    "sessions": sessions,
    "users": users,
    "page_views_incremental": page_views_incremental,
    "sessions_incremental": sessions_incremental,
    "users_incremental": users_incremental,
    "refresh_state": refresh_state,
    "streamed_sessions": streamed_sessions,
    "start_date": start_date,
    "normalized_refresh": normalized_refresh,
    "refresh_indexed": refresh_indexed,
    "run_steps": run_steps,
    "load_rejects": load_rejects,
    "load_kept": load_kept,
    "sessions_with_contexts": sessions_with_contexts,
    "merge_undone": merge_undone,
    "merge_fingerprint": merge_fingerprint,
    "sessions_reloaded": sessions_reloaded,
    "users_reloaded": users_reloaded,
    "page_views_reloaded": page_views_reloaded,
    "replace_load": replace_load,
    "row_limit_load": row_limit_load,
    "reset_zones": reset_zones_query,
    "load_zoned_text": load_zoned_text,
    "cutover_aware": cutover_aware,
    "rewritten_files": rewritten_files,
    "context_edges": context_edges,
    "event_in_list_literals": event_in_list_literals,
    "literal_merge": literal_merge,
    "audit_details": audit_details,
    "dedup_events": dedup,
    "context_gates": context_gates,
    "load_by_name": load_by_name,
    "normalize_events": normalize,
    "cutover": cutover,
    "double_to_string": double_to_string,
    "safe_int": safe_int_query,
    "typed_nulls": typed_nulls,
    "nested_to_json": nested_json,
    "strip_zone": strip_zone_query,
    "zoned_text": zoned_text,
    "day_numbers": day_numbers,
    "context_path": context_path,
    "context_repair": context_repair,
    "context_repair_counts": context_repair_counts,
    "verify_load": verify_load,
    "verify_count": verify_rows,
    "partition_filter": partition_filter_query,
    "partition_count": partition_count,
    "event_in_list": event_in_list,
    "preview": preview_query,
    "limit_load": limit_load,
    "shift_time": shift_time,
    "suffix_ids": suffix_ids,
    "json_ids": json_ids,
    "clone_batches": clone_batches,
    "batch_manifest": batch_manifest,
    "source_metrics": source_metrics_query,
    "event_bounds": event_bounds,
    "live_files": live_files,
    "partition_stats": partition_stats,
    "smallest_partition": smallest_partition,
    "file_inventory": file_inventory,
    "touched_files": touched_files,
    "partition_audit": partition_audit,
    "audit_stray_write": audit_stray_write,
    "merge_update": merge,
    "merge_before_image": merge_before_image,
    "merge_audit": merge_audit,
    "seed_enrichment": seed_enrichment,
    "manifest_header": manifest_header,
    "merge_probe": merge_probe_query,
}
