"""The registered queries as DuckDB SQL over the driver's tables."""

from __future__ import annotations

from clickloom.schema import CMP_VISIBLE, CONSENT, IAB, UA, WEB_PAGE

K = "CAST(json_extract_string(props, '$.k') AS INTEGER)"

EV = f"""
    ev AS (
        SELECT
            CAST(event_id AS VARCHAR) AS event_id,
            ts AS collector_tstamp,
            ts AS derived_tstamp,
            ts AS load_tstamp,
            CAST(user_id AS VARCHAR) AS domain_userid,
            CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS domain_sessionid,
            event_type AS event_name,
            CAST(value AS VARCHAR) AS se_value,
            value AS tr_total,
            'https://example.org/' || event_type || '/' || CAST({K} AS VARCHAR) AS page_url,
            'Page ' || CAST({K} AS VARCHAR) AS page_title,
            CAST({K} * 10 AS INTEGER) AS pp_yoffset_max,
            CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') || '_' || CAST({K} % 3 AS VARCHAR)
                AS page_view_id
        FROM events
    )"""

WEB_PAGE_TEXT = """'[{"id":"' || page_view_id || '"}]'"""

RANKED = """
    ranked AS (
        SELECT *,
            row_number() OVER (PARTITION BY {key} ORDER BY derived_tstamp, event_id) AS rn,
            row_number() OVER (PARTITION BY {key} ORDER BY derived_tstamp DESC, event_id DESC) AS rn_last
        FROM ev
    )"""

PAGE_VIEWS = f"""
WITH {EV}, {RANKED.format(key="page_view_id, domain_sessionid")},
    views AS (
        SELECT page_view_id, domain_sessionid,
            max(CASE WHEN rn = 1 THEN domain_userid END) AS domain_userid,
            min(derived_tstamp) AS start_tstamp,
            max(derived_tstamp) AS end_tstamp,
            count(*) AS events,
            CAST(sum(CASE WHEN event_name <> 'view' THEN 1 ELSE 0 END) AS BIGINT) AS activity,
            max(pp_yoffset_max) AS max_scroll,
            max(CASE WHEN rn = 1 THEN page_url END) AS page_url,
            max(CASE WHEN rn = 1 THEN page_title END) AS page_title
        FROM ranked GROUP BY page_view_id, domain_sessionid
    )
SELECT *, row_number() OVER (PARTITION BY domain_sessionid ORDER BY start_tstamp, page_view_id)
    AS page_view_in_session_index
FROM views
"""

# Attributes that the driver's events do not have.
ABSENT = """
    page_referrer refr_medium refr_source refr_term mkt_medium mkt_source mkt_term mkt_content
    mkt_campaign dvce_type dvce_ismobile br_family os_family geo_country geo_region geo_city
"""
NULL_ATTRIBUTES = ",\n".join(
    f"CAST(NULL AS {'BOOLEAN' if c == 'dvce_ismobile' else 'VARCHAR'}) AS {c}" for c in ABSENT.split()
)

SESSION_ROWS = f"""
    session_rows AS (
        SELECT domain_sessionid,
            max(CASE WHEN rn = 1 THEN domain_userid END) AS domain_userid,
            min(derived_tstamp) AS start_tstamp,
            max(derived_tstamp) AS end_tstamp,
            CAST(floor(CAST(epoch_us(max(derived_tstamp)) - epoch_us(min(derived_tstamp)) AS DOUBLE) / 1000000)
                AS BIGINT) AS duration_in_s,
            count(DISTINCT page_view_id) AS page_views,
            count(*) AS events,
            max(CASE WHEN rn = 1 THEN page_url END) AS first_page_url,
            max(CASE WHEN rn_last = 1 THEN page_url END) AS last_page_url,
            {NULL_ATTRIBUTES}
        FROM ranked GROUP BY domain_sessionid
    )"""

SESSIONS_CTE = f"WITH {EV}, {RANKED.format(key='domain_sessionid')}, {SESSION_ROWS}"
SESSIONS = f"{SESSIONS_CTE} SELECT * FROM session_rows"

SESSIONS_WITH_CONTEXTS = f"""
{SESSIONS_CTE},
    valued AS (
        SELECT CAST(user_id AS VARCHAR) || '_' || strftime(ts, '%Y%m%d') AS session, {K} AS ua_k,
            row_number() OVER (
                PARTITION BY user_id, strftime(ts, '%Y%m%d') ORDER BY ts, CAST(event_id AS VARCHAR)) AS place
        FROM events WHERE {K} % 2 = 0
    )
SELECT s.*, v.ua_k, CAST(NULL AS INTEGER) AS iab_k, CAST(NULL AS DOUBLE) AS lcp
FROM session_rows s LEFT JOIN valued v ON v.session = s.domain_sessionid AND v.place = 1
"""

USERS = f"""
{SESSIONS_CTE}
SELECT domain_userid,
    min(start_tstamp) AS first_seen,
    max(end_tstamp) AS last_seen,
    count(*) AS sessions,
    CAST(sum(page_views) AS BIGINT) AS page_views,
    CAST(sum(events) AS BIGINT) AS events,
    CAST(sum(duration_in_s) AS BIGINT) AS duration_in_s
FROM session_rows GROUP BY domain_userid
"""

# The contract's columns in order, by runs of one type.
CONTRACT = [
    ("VARCHAR", """
        app_id platform"""),
    ("TIMESTAMP", """
        etl_tstamp collector_tstamp dvce_created_tstamp"""),
    ("VARCHAR", """
        event event_id txn_id name_tracker v_tracker v_collector v_etl user_id user_ipaddress
        user_fingerprint domain_userid"""),
    ("INTEGER", """
        domain_sessionidx"""),
    ("VARCHAR", """
        network_userid geo_country geo_region geo_city geo_zipcode"""),
    ("DOUBLE", """
        geo_latitude geo_longitude"""),
    ("VARCHAR", """
        geo_region_name ip_isp ip_organization ip_domain ip_netspeed page_url page_title page_referrer
        page_urlscheme page_urlhost"""),
    ("INTEGER", """
        page_urlport"""),
    ("VARCHAR", """
        page_urlpath page_urlquery page_urlfragment refr_urlscheme refr_urlhost"""),
    ("INTEGER", """
        refr_urlport"""),
    ("VARCHAR", """
        refr_urlpath refr_urlquery refr_urlfragment refr_medium refr_source refr_term mkt_medium
        mkt_source mkt_term mkt_content mkt_campaign se_category se_action se_label se_property se_value
        tr_orderid tr_affiliation"""),
    ("DOUBLE", """
        tr_total tr_tax tr_shipping"""),
    ("VARCHAR", """
        tr_city tr_state tr_country ti_orderid ti_sku ti_name ti_category"""),
    ("DOUBLE", """
        ti_price"""),
    ("INTEGER", """
        ti_quantity pp_xoffset_min pp_xoffset_max pp_yoffset_min pp_yoffset_max"""),
    ("VARCHAR", """
        useragent br_name br_family br_version br_type br_renderengine br_lang"""),
    ("BOOLEAN", """
        br_features_pdf br_features_flash br_features_java br_features_director br_features_quicktime
        br_features_realplayer br_features_windowsmedia br_features_gears br_features_silverlight
        br_cookies"""),
    ("INTEGER", """
        br_colordepth br_viewwidth br_viewheight"""),
    ("VARCHAR", """
        os_name os_family os_manufacturer os_timezone dvce_type"""),
    ("BOOLEAN", """
        dvce_ismobile"""),
    ("INTEGER", """
        dvce_screenwidth dvce_screenheight"""),
    ("VARCHAR", """
        doc_charset"""),
    ("INTEGER", """
        doc_width doc_height"""),
    ("VARCHAR", """
        tr_currency"""),
    ("DOUBLE", """
        tr_total_base tr_tax_base tr_shipping_base"""),
    ("VARCHAR", """
        ti_currency"""),
    ("DOUBLE", """
        ti_price_base"""),
    ("VARCHAR", """
        base_currency geo_timezone mkt_clickid mkt_network etl_tags"""),
    ("TIMESTAMP", """
        dvce_sent_tstamp"""),
    ("VARCHAR", """
        refr_domain_userid"""),
    ("TIMESTAMP", """
        refr_dvce_tstamp"""),
    ("VARCHAR", """
        domain_sessionid"""),
    ("TIMESTAMP", """
        derived_tstamp"""),
    ("VARCHAR", """
        event_vendor event_name event_format event_version event_fingerprint"""),
    ("TIMESTAMP", """
        true_tstamp load_tstamp"""),
    ("VARCHAR", """
        contexts_com_snowplowanalytics_snowplow_web_page_1
        unstruct_event_com_snowplowanalytics_snowplow_consent_preferences_1
        unstruct_event_com_snowplowanalytics_snowplow_cmp_visible_1
        contexts_com_iab_snowplow_spiders_and_robots_1
        contexts_com_snowplowanalytics_snowplow_ua_parser_context_1 contexts_nl_basjes_yauaa_context_1
        unstruct_event_com_snowplowanalytics_snowplow_web_vitals_1"""),
]
LOADED = {
    "event_id", "collector_tstamp", "derived_tstamp", "load_tstamp", "domain_userid", "domain_sessionid",
    "event_name", "se_value", "tr_total", "page_url", "page_title", "pp_yoffset_max",
}


def _contract_column(name: str, data_type: str) -> str:
    if name in LOADED:
        return name
    if name == WEB_PAGE:
        return f"{WEB_PAGE_TEXT} AS {name}"
    return f"CAST(NULL AS {data_type}) AS {name}"


LOAD_BY_NAME = f"""
WITH {EV}
SELECT {', '.join(_contract_column(name, data_type) for data_type, names in CONTRACT for name in names.split())}
FROM ev
"""

COLORDEPTH = f"CASE WHEN event_type = 'view' THEN {K} END"
NESTED_TEXT = f"""'[{{"id":"' || CAST({K} AS VARCHAR) || '","note":null}}]'"""

# Times of clones, in microseconds from the template's first event.
BOUNDS = """
    bounds AS (
        SELECT min(ts) AS low, epoch_us(max(ts)) - epoch_us(min(ts)) AS span FROM events
    )"""
WINDOW_US = 36 * 3_600_000_000
GAP_US = 3_600_000_000


def _shifted(index: int) -> str:
    return (
        f"make_timestamp(epoch_us(low) + {index} * {WINDOW_US} + CAST(floor("
        f"CAST(epoch_us(ts) - epoch_us(low) AS DOUBLE) * (CAST({WINDOW_US} AS DOUBLE) / CAST(span AS DOUBLE))"
        f") AS BIGINT))"
    )


SPACED = f"make_timestamp(epoch_us(ts) + i * (span + {GAP_US}))"
SUFFIX = "'__b' || lpad(CAST(i AS VARCHAR), 3, '0')"

INVENTORY = """
    inventory AS (
        SELECT CAST(ts AS DATE) AS day, event_type AS event_name,
            CAST(CAST(ts AS DATE) AS VARCHAR) || '/' || event_type || '/' || CAST(user_id AS VARCHAR) AS path,
            count(*) AS record_count,
            CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS status,
            CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END AS content
        FROM events GROUP BY CAST(ts AS DATE), event_type, user_id
    )"""
PARTITION_STATS = f"""
WITH {INVENTORY}
SELECT day, event_name, CAST(sum(record_count) AS BIGINT) AS rows, count(*) AS files
FROM inventory WHERE status <> 2 AND content = 0 GROUP BY day, event_name
"""
AUDIT_SELECT = """
SELECT count(*) AS added_files, count(*) AS removed_files,
    2 * CAST(sum(CASE WHEN {target} THEN 1 ELSE 0 END) AS BIGINT) AS touched_in_target,
    2 * CAST(sum(CASE WHEN {target} THEN 0 ELSE 1 END) AS BIGINT) AS touched_outside_target,
    sum(CASE WHEN {target} THEN 0 ELSE 1 END) = 0 AND sum(CASE WHEN {target} THEN 1 ELSE 0 END) > 0 AS pass
FROM inventory WHERE status <> 2 AND event_name = 'click'
"""
LATEST = """
    latest AS (
        SELECT event_id AS latest_id FROM (
            SELECT event_id, row_number() OVER (
                PARTITION BY domain_userid ORDER BY collector_tstamp DESC, event_id DESC) AS rn
            FROM ev) WHERE rn = 1
    )"""

BROKEN = """
    broken AS (
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, props,
            CASE event_type WHEN 'click' THEN props
                WHEN 'purchase' THEN '[{"ok": true, "none": null, "of": ' || props || '}]'
                WHEN 'view' THEN props END AS context
        FROM events
    )"""

# What is left after the second batch was loaded again with fewer errors and without copies of views.
RELOADED = EV.replace("FROM events", f"FROM events WHERE event_type <> 'error' OR {K} >= 50")

EDGE_TEXTS = f"""
    edges AS (
        SELECT CAST(event_id AS VARCHAR) AS event_id, {K} AS k, CAST({K} AS VARCHAR) AS id FROM events
    )"""

ORACLES: dict[str, str] = {
    "page_views": PAGE_VIEWS,
    "sessions": SESSIONS,
    "users": USERS,
    "page_views_incremental": PAGE_VIEWS,
    "sessions_incremental": SESSIONS,
    "sessions_with_contexts": SESSIONS_WITH_CONTEXTS,
    "users_incremental": USERS,
    "streamed_sessions": SESSIONS,
    "refresh_state": f"""
        WITH {EV}
        SELECT domain_sessionid,
            CAST(min(collector_tstamp) AS DATE) AS first_day,
            CAST(max(collector_tstamp) AS DATE) AS last_day,
            max(CASE WHEN event_name = 'view' THEN 'batch_0'
                WHEN event_name IN ('click', 'error') THEN 'batch_1' ELSE 'batch_2' END) AS last_batch
        FROM ev GROUP BY domain_sessionid""",
    "normalized_refresh": SESSIONS,
    "refresh_indexed": """
        SELECT CASE WHEN event_type = 'view' THEN 'batch_0' WHEN event_type IN ('click', 'error') THEN 'batch_1'
                ELSE 'batch_2' END AS batch_id,
            CAST(ts AS DATE) AS event_day, count(DISTINCT event_id) AS ids, count(DISTINCT event_id) AS found
        FROM events GROUP BY 1, 2""",
    "sessions_reloaded": SESSIONS.replace(EV, RELOADED),
    "users_reloaded": USERS.replace(EV, RELOADED),
    "page_views_reloaded": PAGE_VIEWS.replace(EV, RELOADED),
    "replace_load": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS event_name FROM events WHERE event_type = 'click'""",
    "run_steps": """
        SELECT CAST(step AS INTEGER) AS step, phase, batches, count(*) AS row_count,
            min(ts) AS min_collector_tstamp, max(ts) AS max_collector_tstamp
        FROM (VALUES (0, 'initial', 'batch_0', ['view']), (1, 'incremental', 'batch_1', ['view', 'click', 'error']),
            (2, 'incremental', 'batch_2', ['view', 'click', 'error', 'purchase', 'signup'])) s(step, phase, batches, names)
            JOIN events ON list_contains(names, event_type)
        GROUP BY step, phase, batches""",
    "load_rejects": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, 'tr_total' AS column_name, 'n/a' AS text, 'all' AS batch_id
        FROM events WHERE event_id % 7 = 0
        UNION ALL
        SELECT CAST(event_id AS VARCHAR), 'load_tstamp', 'soon', 'all' FROM events WHERE event_id % 5 = 0""",
    "load_kept": f"""
        WITH {EV} SELECT event_id, load_tstamp, tr_total, page_url FROM ev
        WHERE CAST(event_id AS BIGINT) % 7 <> 0 AND CAST(event_id AS BIGINT) % 5 <> 0""",
    "row_limit_load": "SELECT least(100, count(*)) AS rows FROM events",
    "reset_zones": "SELECT count(*) AS rows FROM events WHERE event_type = 'view'",
    "rewritten_files": f"WITH {BROKEN} SELECT event_id, context FROM broken",
    "literal_merge": f"""
        WITH {EV}, top AS (SELECT event_id AS top_id FROM ev ORDER BY tr_total DESC, event_id LIMIT 20)
        SELECT event_id, CASE WHEN top_id IS NOT NULL THEN 'top ' || event_name END AS etl_tags
        FROM ev LEFT JOIN top ON event_id = top_id""",
    "cutover_aware": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, kind FROM events, (VALUES ('zoned'), ('plain')) AS k(kind)
        WHERE ts >= TIMESTAMP '2024-01-17 17:47:00'""",
    "load_zoned_text": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
            CASE event_type WHEN 'view' THEN ts - INTERVAL 2 HOUR WHEN 'click' THEN ts + INTERVAL 330 MINUTE ELSE ts END
                AS collector_tstamp
        FROM events""",
    "context_edges": f"""
        WITH {EDGE_TEXTS}
        SELECT event_id,
            k % 6 IN (0, 1) AS is_json,
            CASE k % 6 WHEN 0 THEN id WHEN 1 THEN id END AS value,
            CASE k % 6 WHEN 0 THEN '[{{"id":"' || id || '"}}]'
                WHEN 1 THEN '[{{"id":"' || id || '","id":"z"}}]'
                WHEN 4 THEN '[{{"id": "' || id || '"}}]' END AS repaired
        FROM edges""",
    "event_in_list_literals": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, kind FROM events, (VALUES ('short'), ('long')) AS k(kind)
        WHERE (kind = 'short' AND event_id BETWEEN 1 AND 50) OR (kind = 'long' AND event_id BETWEEN 100 AND 2999)""",
    "audit_details": f"""
        WITH {INVENTORY}
        SELECT day, event_name, path || '/v2' AS path, record_count, content FROM inventory
        WHERE event_name = 'click' AND status <> 2""",
    "start_date": f"""
        WITH {EV}
        SELECT domain_sessionid, min(derived_tstamp) AS start_tstamp, max(derived_tstamp) AS end_tstamp,
            count(*) AS events
        FROM ev WHERE collector_tstamp >= TIMESTAMP '2024-01-20 00:00:00' GROUP BY domain_sessionid""",
    "dedup_events": f"""
        WITH {EV},
            narrow AS (SELECT event_id, collector_tstamp, domain_sessionid, tr_total FROM ev),
            copies AS (
                SELECT * FROM narrow UNION ALL SELECT * FROM narrow UNION ALL
                SELECT event_id, collector_tstamp + INTERVAL 1 MICROSECOND, domain_sessionid, tr_total + 1
                FROM narrow)
        SELECT event_id, collector_tstamp, domain_sessionid, tr_total FROM (
            SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY collector_tstamp) AS rn FROM copies)
        WHERE rn = 1""",
    "context_gates": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS web_page_id, {K} AS ua_k,
            CAST(NULL AS INTEGER) AS iab_k, CAST(NULL AS DOUBLE) AS vitals
        FROM events""",
    "load_by_name": LOAD_BY_NAME,
    "normalize_events": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS collector_tstamp, ts AS load_tstamp,
            event_type AS event_name, CAST({K} AS VARCHAR) AS txn_id,
            CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS tr_total,
            CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) AS ti_price,
            CAST(NULL AS DOUBLE) AS tr_tax,
            {COLORDEPTH} AS br_colordepth,
            {NESTED_TEXT} AS {WEB_PAGE},
            CAST(NULL AS VARCHAR) AS {UA}, CAST(NULL AS VARCHAR) AS {IAB}
        FROM events""",
    "cutover": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS load_tstamp FROM events
        WHERE ts >= TIMESTAMP '2024-01-17 19:47:00'""",
    "double_to_string": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(value AS VARCHAR) AS se_value FROM events""",
    "safe_int": f"SELECT CAST(event_id AS VARCHAR) AS event_id, {COLORDEPTH} AS br_colordepth FROM events",
    "typed_nulls": f"""
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS {CONSENT},
            CAST(NULL AS VARCHAR) AS {CMP_VISIBLE}, CAST(NULL AS VARCHAR) AS {IAB},
            CAST(NULL AS DOUBLE) AS tr_tax
        FROM events""",
    "nested_to_json": f"SELECT CAST(event_id AS VARCHAR) AS event_id, {NESTED_TEXT} AS web_page FROM events",
    "strip_zone": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS collector_tstamp, ts AS load_tstamp FROM events""",
    "zoned_text": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts - INTERVAL 2 HOUR AS collector_tstamp FROM events""",
    "day_numbers": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
            CAST(CAST(ts AS DATE) - DATE '1970-01-01' AS INTEGER) AS day_number, CAST(ts AS DATE) AS event_day
        FROM events""",
    "context_path": f"""
        WITH {EV}
        SELECT event_id, json_extract_string({WEB_PAGE_TEXT}, '$[0].id') AS page_view_id FROM ev""",
    "context_repair": f"WITH {BROKEN} SELECT event_id, context FROM broken",
    "context_repair_counts": f"""
        WITH {BROKEN}
        SELECT '{WEB_PAGE}' AS "column",
            CAST(sum(CASE WHEN event_type <> 'signup' THEN 1 ELSE 0 END) AS BIGINT) AS texts,
            CAST(sum(CASE WHEN event_type IN ('click', 'purchase') THEN 1 ELSE 0 END) AS BIGINT) AS repaired,
            CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS nulled
        FROM broken""",
    "verify_load": """
        WITH counts AS (
            SELECT count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END) AS BIGINT) AS others
            FROM events)
        SELECT 'event_id present' AS rule, n AS rows, CAST(0 AS BIGINT) AS broken, true AS passed FROM counts
        UNION ALL SELECT 'context parses', n, CAST(0 AS BIGINT), true FROM counts
        UNION ALL SELECT 'load time present', n, CAST(0 AS BIGINT), true FROM counts
        UNION ALL SELECT 'is a view', n, others, others = 0 FROM counts""",
    "verify_count": """
        SELECT count(*) AS rows, count(*) AS expected_rows, true AS passed FROM events""",
    "partition_filter": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(ts AS DATE) AS event_day, event_type AS event_name
        FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_type = 'view'""",
    "partition_count": """
        SELECT count(*) AS rows FROM events
        WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_type = 'view'""",
    "event_in_list": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS etl_tags
        FROM events WHERE event_id IN (SELECT c_custkey FROM customer)""",
    "preview": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, value AS tr_total
        FROM events ORDER BY value DESC, CAST(event_id AS VARCHAR) LIMIT 10""",
    "limit_load": """
        SELECT CAST(event_id AS VARCHAR) AS event_id, ts AS collector_tstamp, event_type AS event_name
        FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' AND event_type = 'view'
        ORDER BY CAST(event_id AS VARCHAR) LIMIT 10""",
    "shift_time": f"""
        WITH {BOUNDS}
        SELECT CAST(event_id AS VARCHAR) AS event_id, {_shifted(2)} AS collector_tstamp,
            {_shifted(2)} AS derived_tstamp, {_shifted(2)} AS load_tstamp
        FROM events, bounds""",
    "suffix_ids": f"""
        WITH {EV}
        SELECT event_id || '__b007' AS event_id, domain_userid || '__b007' AS domain_userid,
            domain_sessionid || '__b007' AS domain_sessionid, CAST(NULL AS VARCHAR) AS txn_id, event_name
        FROM ev""",
    "json_ids": """
        SELECT CAST(event_id AS VARCHAR) AS event_id,
            regexp_replace(
                '[{"id" : "' || CAST(event_id AS VARCHAR) || '", "id2": "x", "data": {"id":"' || event_type || '"}}]',
                '("id"\\s*:\\s*")([^"]+)(")', '\\1\\2__b012\\3', 'g') AS context
        FROM events""",
    "clone_batches": f"""
        WITH {EV}, {BOUNDS}, copies AS (SELECT CAST(range AS INTEGER) AS i FROM range(3))
        SELECT i AS batch_index,
            event_id || {SUFFIX} AS event_id, domain_userid || {SUFFIX} AS domain_userid,
            domain_sessionid || {SUFFIX} AS domain_sessionid,
            {SPACED.replace("(ts)", "(collector_tstamp)")} AS collector_tstamp,
            regexp_replace({WEB_PAGE_TEXT}, '("id"\\s*:\\s*")([^"]+)(")', '\\1\\2' || {SUFFIX} || '\\3', 'g')
                AS context
        FROM ev, bounds, copies""",
    "batch_manifest": f"""
        WITH {BOUNDS}, copies AS (SELECT CAST(range AS INTEGER) AS i FROM range(3)),
            scaled AS (SELECT low, span, CAST({WINDOW_US} AS DOUBLE) / CAST(span AS DOUBLE) AS scale FROM bounds),
            starts AS (SELECT i, make_timestamp(epoch_us(low) + i * {WINDOW_US}) AS start FROM copies, scaled)
        SELECT i AS batch_index,
            'batch_' || lpad(CAST(i AS VARCHAR), 3, '0') || '_' || strftime(start, '%Y%m%dT%H%M%S') AS name,
            (SELECT count(*) FROM events) AS rows,
            start AS collector_tstamp_min,
            make_timestamp(epoch_us(start) + CASE WHEN span = 0 THEN 0 ELSE {WINDOW_US} END) AS collector_tstamp_max,
            start AS measured_tstamp_min,
            make_timestamp(epoch_us(start) + CAST(floor(CAST(span AS DOUBLE) * scale) AS BIGINT))
                AS measured_tstamp_max,
            {SUFFIX} AS suffix
        FROM starts, scaled""",
    "manifest_header": """
        SELECT 'events' AS template_uri, count(*) AS template_rows, min(ts) AS template_collector_tstamp_min,
            max(ts) AS template_collector_tstamp_max, CAST(36 AS DOUBLE) AS window_hours,
            CAST(36 * 3600 AS DOUBLE) AS batch_spacing_seconds
        FROM events""",
    "merge_probe": """
        WITH stats AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL),
            smallest AS (SELECT day, event_type FROM stats ORDER BY n, day, event_type LIMIT 1)
        SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(0 AS BIGINT) AS outside, true AS pass
        FROM events JOIN smallest ON CAST(ts AS DATE) = day AND events.event_type = smallest.event_type
        ORDER BY CAST(event_id AS VARCHAR) LIMIT 10""",
    "source_metrics": """
        SELECT count(*) AS row_count, min(ts) AS min_collector_tstamp, max(ts) AS max_collector_tstamp
        FROM events""",
    "event_bounds": f"""
        WITH {BOUNDS}, copies AS (SELECT CAST(range AS INTEGER) AS i FROM range(3))
        SELECT i AS batch_index, min({SPACED}) AS tstamp_min, max({SPACED}) AS tstamp_max
        FROM events, bounds, copies GROUP BY i""",
    "live_files": f"""
        WITH {INVENTORY}
        SELECT day, event_name, path, record_count, status, content FROM inventory WHERE status <> 2""",
    "partition_stats": PARTITION_STATS,
    "smallest_partition": f"{PARTITION_STATS} ORDER BY rows, day, event_name LIMIT 1",
    "file_inventory": """
        SELECT CAST(ts AS DATE) AS event_day, event_type AS event_name, count(*) AS rows
        FROM events GROUP BY CAST(ts AS DATE), event_type""",
    "touched_files": f"""
        WITH {INVENTORY}, clicks AS (SELECT * FROM inventory WHERE event_name = 'click')
        SELECT day, event_name, path || '/v2' AS path, record_count, status, content, 'added' AS change FROM clicks
        UNION ALL
        SELECT day, event_name, path, record_count, status, content, 'removed' AS change FROM clicks""",
    "partition_audit": f"WITH {INVENTORY} {AUDIT_SELECT.format(target='true')}",
    "audit_stray_write": f"""
        WITH {INVENTORY} {AUDIT_SELECT.format(target="day < DATE '2024-01-15'")}""",
    "merge_update": f"""
        WITH {EV}, {LATEST}
        SELECT event_id, collector_tstamp, event_name,
            CASE WHEN latest_id IS NOT NULL THEN 'last of user' END AS etl_tags
        FROM ev LEFT JOIN latest ON event_id = latest_id""",
    "merge_undone": f"""
        WITH {EV}, {LATEST}
        SELECT event_id, collector_tstamp, event_name,
            CASE WHEN latest_id IS NOT NULL THEN 'last of user' END AS etl_tags, tr_total
        FROM ev LEFT JOIN latest ON event_id = latest_id""",
    "merge_fingerprint": f"""
        WITH {EV}, {LATEST}
        SELECT CAST(collector_tstamp AS DATE) AS event_day, event_name, count(*) AS rows_old, count(*) AS rows_new, true AS same
        FROM ev LEFT JOIN latest ON event_id = latest_id WHERE latest_id IS NULL GROUP BY 1, 2""",
    "merge_before_image": f"""
        WITH {EV}, {LATEST}
        SELECT event_id, collector_tstamp, event_name, CAST(NULL AS VARCHAR) AS etl_tags, tr_total
        FROM ev JOIN latest ON event_id = latest_id""",
    "merge_audit": "SELECT CAST(0 AS BIGINT) AS touched_outside_target, count(*) > 0 AS pass FROM events",
    "seed_enrichment": """
        SELECT c_custkey, n_name, r_name FROM customer
        LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
}
