"""The declared events contract: column names, order and types."""

from __future__ import annotations

from pyspark.sql import types as T

# The events contract. Names and order are part of the data
# format; contexts are stored as JSON text and parsed on read.
EVENTS_DDL = """
    app_id STRING,
    platform STRING,
    etl_tstamp TIMESTAMP_NTZ,
    collector_tstamp TIMESTAMP_NTZ,
    dvce_created_tstamp TIMESTAMP_NTZ,
    event STRING,
    event_id STRING,
    txn_id STRING,
    name_tracker STRING,
    v_tracker STRING,
    v_collector STRING,
    v_etl STRING,
    user_id STRING,
    user_ipaddress STRING,
    user_fingerprint STRING,
    domain_userid STRING,
    domain_sessionidx INT,
    network_userid STRING,
    geo_country STRING,
    geo_region STRING,
    geo_city STRING,
    geo_zipcode STRING,
    geo_latitude DOUBLE,
    geo_longitude DOUBLE,
    geo_region_name STRING,
    ip_isp STRING,
    ip_organization STRING,
    ip_domain STRING,
    ip_netspeed STRING,
    page_url STRING,
    page_title STRING,
    page_referrer STRING,
    page_urlscheme STRING,
    page_urlhost STRING,
    page_urlport INT,
    page_urlpath STRING,
    page_urlquery STRING,
    page_urlfragment STRING,
    refr_urlscheme STRING,
    refr_urlhost STRING,
    refr_urlport INT,
    refr_urlpath STRING,
    refr_urlquery STRING,
    refr_urlfragment STRING,
    refr_medium STRING,
    refr_source STRING,
    refr_term STRING,
    mkt_medium STRING,
    mkt_source STRING,
    mkt_term STRING,
    mkt_content STRING,
    mkt_campaign STRING,
    se_category STRING,
    se_action STRING,
    se_label STRING,
    se_property STRING,
    se_value STRING,
    tr_orderid STRING,
    tr_affiliation STRING,
    tr_total DOUBLE,
    tr_tax DOUBLE,
    tr_shipping DOUBLE,
    tr_city STRING,
    tr_state STRING,
    tr_country STRING,
    ti_orderid STRING,
    ti_sku STRING,
    ti_name STRING,
    ti_category STRING,
    ti_price DOUBLE,
    ti_quantity INT,
    pp_xoffset_min INT,
    pp_xoffset_max INT,
    pp_yoffset_min INT,
    pp_yoffset_max INT,
    useragent STRING,
    br_name STRING,
    br_family STRING,
    br_version STRING,
    br_type STRING,
    br_renderengine STRING,
    br_lang STRING,
    br_features_pdf BOOLEAN,
    br_features_flash BOOLEAN,
    br_features_java BOOLEAN,
    br_features_director BOOLEAN,
    br_features_quicktime BOOLEAN,
    br_features_realplayer BOOLEAN,
    br_features_windowsmedia BOOLEAN,
    br_features_gears BOOLEAN,
    br_features_silverlight BOOLEAN,
    br_cookies BOOLEAN,
    br_colordepth INT,
    br_viewwidth INT,
    br_viewheight INT,
    os_name STRING,
    os_family STRING,
    os_manufacturer STRING,
    os_timezone STRING,
    dvce_type STRING,
    dvce_ismobile BOOLEAN,
    dvce_screenwidth INT,
    dvce_screenheight INT,
    doc_charset STRING,
    doc_width INT,
    doc_height INT,
    tr_currency STRING,
    tr_total_base DOUBLE,
    tr_tax_base DOUBLE,
    tr_shipping_base DOUBLE,
    ti_currency STRING,
    ti_price_base DOUBLE,
    base_currency STRING,
    geo_timezone STRING,
    mkt_clickid STRING,
    mkt_network STRING,
    etl_tags STRING,
    dvce_sent_tstamp TIMESTAMP_NTZ,
    refr_domain_userid STRING,
    refr_dvce_tstamp TIMESTAMP_NTZ,
    domain_sessionid STRING,
    derived_tstamp TIMESTAMP_NTZ,
    event_vendor STRING,
    event_name STRING,
    event_format STRING,
    event_version STRING,
    event_fingerprint STRING,
    true_tstamp TIMESTAMP_NTZ,
    load_tstamp TIMESTAMP_NTZ,
    contexts_com_snowplowanalytics_snowplow_web_page_1 STRING,
    unstruct_event_com_snowplowanalytics_snowplow_consent_preferences_1 STRING,
    unstruct_event_com_snowplowanalytics_snowplow_cmp_visible_1 STRING,
    contexts_com_iab_snowplow_spiders_and_robots_1 STRING,
    contexts_com_snowplowanalytics_snowplow_ua_parser_context_1 STRING,
    contexts_nl_basjes_yauaa_context_1 STRING,
    unstruct_event_com_snowplowanalytics_snowplow_web_vitals_1 STRING
"""

# String columns that carry an identifier.
ID_COLUMNS = [
    "event_id",
    "txn_id",
    "user_id",
    "user_fingerprint",
    "domain_userid",
    "network_userid",
    "refr_domain_userid",
    "domain_sessionid",
    "tr_orderid",
    "ti_orderid",
]

_TYPES = {
    "STRING": T.StringType(),
    "INT": T.IntegerType(),
    "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(),
    "TIMESTAMP_NTZ": T.TimestampNTZType(),
}

EVENTS_SCHEMA = T.StructType(
    [T.StructField(name, _TYPES[kind]) for name, kind in map(str.split, EVENTS_DDL.strip().split(","))]
)
EVENT_COLUMNS = EVENTS_SCHEMA.fieldNames()
CONTEXT_COLUMNS = EVENT_COLUMNS[-7:]
TIMESTAMP_COLUMNS = [f.name for f in EVENTS_SCHEMA if isinstance(f.dataType, T.TimestampNTZType)]

# Short names for the seven contexts, in contract order.
WEB_PAGE, CONSENT, CMP_VISIBLE, IAB, UA, YAUAA, WEB_VITALS = CONTEXT_COLUMNS

# Columns the events table adds to the contract, all three used as partitions
# together with event_name.
EVENT_DAY = "event_day"
BATCH_ID = "batch_id"
EVENT_PARTITIONS = [EVENT_DAY, "event_name", BATCH_ID]
