"""DuckDB SQL of the registered queries that SQL can express.

Language, quality and toxicity are trained models; secret spans need the places
of matches, and shards, mixes and windows follow a hash order or a greedy walk.
Tests hold these against brute force.
"""

from __future__ import annotations

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LETTERS_DIGITS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NO_SPACE = r"[^\x20\x09-\x0D]+"

TOPK = """
WITH whole AS (
        SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS vector
        FROM embeddings
        WHERE embedding IS NOT NULL
            AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scores AS (
        SELECT q.vec_id AS query_id, c.vec_id,
            CAST(list_sum(list_transform(list_zip(q.vector, c.vector), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    ranked AS (
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, score
        FROM scores)
SELECT * FROM ranked WHERE rank <= 5
"""

CONTAMINATION = f"""
WITH docs AS (
        SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{LETTERS_DIGITS}'), []) AS w FROM documents),
    items AS (
        SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("text")}, '{LETTERS_DIGITS}') AS w
        FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
    sized AS (SELECT item, w, least(10, len(w)) AS k FROM items WHERE len(w) > 0),
    places AS (SELECT item, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM sized),
    windows AS (SELECT DISTINCT item, k, array_to_string(w[i + 1:i + k], ' ') AS words FROM places),
    sizes AS (SELECT DISTINCT k FROM windows),
    doc_places AS (SELECT doc_id, w, k, unnest(range(0, len(w) - k + 1)) AS i FROM docs, sizes WHERE len(w) >= k),
    found AS (
        SELECT doc_id, item, k, i FROM (
            SELECT doc_id, k, i, array_to_string(w[i + 1:i + k], ' ') AS words FROM doc_places) JOIN windows USING (k, words)),
    hits AS (
        SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS place FROM found)
        GROUP BY doc_id),
    named AS (
        SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_JACCARD = f"""
WITH RECURSIVE docs AS (
        SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '{NO_SPACE}'), []) AS w FROM documents),
    places AS (
        SELECT doc_id, w, least({{shingle}}, len(w)) AS k, unnest(range(0, greatest(1, len(w) - {{shingle}} + 1))) AS i FROM docs WHERE len(w) > 0),
    shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + k], ' ') AS s FROM places),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    shared AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common >= {{percent}} * (x.n + y.n - common)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
        SELECT a AS doc_id, a AS other FROM ways
        UNION
        SELECT reached.doc_id, ways.b FROM reached JOIN ways ON ways.a = reached.other),
    lowest AS (SELECT doc_id, min(other) AS low FROM reached GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(low, doc_id) AS component_id{{more}}
FROM docs LEFT JOIN sizes USING (doc_id) LEFT JOIN lowest USING (doc_id)
"""

JACCARD = _JACCARD.format(shingle=3, percent=90, more="")
PATH_JOIN = _JACCARD.format(shingle=4, percent=80, more=", coalesce(low, doc_id) = doc_id AS kept")

FILTER_AUDIT = f"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
    words AS (SELECT *, regexp_extract_all(x, '{NO_SPACE}') AS w, min(doc_id) OVER (PARTITION BY x) AS low FROM texts),
    failed AS (
        SELECT doc_id, part, CAST(len(w) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(w)) < 65 * len(w) AS INTEGER)
            + 4 * CAST(100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 5 * length(x) AS INTEGER)
            + 8 * CAST(regexp_matches(x, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(doc_id > low, false) AS INTEGER) AS mask
        FROM words),
    rated AS (
        SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
    masks AS (
        SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
        FROM failed LEFT JOIN rated USING (doc_id) GROUP BY part, mask),
    letters(f, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    orders AS (
        SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bits
        FROM letters a, letters b, letters c, letters d, letters e WHERE a.b | b.b | c.b | d.b | e.b = 31),
    places AS (SELECT filter_order, bits, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
    steps AS (
        SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INTEGER) AS earlier FROM places),
    counted AS (
        SELECT part, filter_order, step, bit,
            sum(CASE WHEN mask & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
            sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & bit <> 0 AND mask & earlier <> 0 THEN n ELSE 0 END) AS redundant,
            sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN good ELSE 0 END) AS good_lost,
            sum(CASE WHEN mask & bit <> 0 AND mask & earlier = 0 THEN toxic ELSE 0 END) AS toxic_lost
        FROM masks, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
    CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
    CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
    CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM counted
"""

_ASSIGNED = """
    {to} AS (
        SELECT r, p, min_by(e, (d, e)) AS e, min(d) AS d FROM (
            SELECT x.r, x.p, b.e,
                CAST(list_sum(list_transform(list_zip(x.v, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d
            FROM cut x JOIN {book} b ON b.p = x.p)
        GROUP BY r, p),"""

_MOVED = """
    {to}_means AS (
        SELECT p, e, list(m ORDER BY k) AS c FROM (
            SELECT x.p, a.e, k, CAST(floor(sum(x.v[k]) / count(*)) AS BIGINT) AS m
            FROM cut x JOIN {assigned} a ON a.r = x.r AND a.p = x.p, (SELECT unnest(range(1, 1 + (SELECT max(len(v)) FROM cut))) AS k)
            GROUP BY x.p, a.e, k)
        GROUP BY p, e),
    {to} AS (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {book} b LEFT JOIN {to}_means m ON m.p = b.p AND m.e = b.e),"""

VECTOR_CODES = f"""
WITH whole AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    numbered AS (SELECT *, row_number() OVER (ORDER BY vec_id, v) AS r, len(v) // 16 AS w FROM whole),
    cut AS MATERIALIZED (
        SELECT r, p, v[p * w + 1:p * w + w] AS v FROM (SELECT r, v, w, unnest(range(16)) AS p FROM numbered)),
    book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v AS c FROM cut WHERE r <= 64),
    {_ASSIGNED.format(to="near0", book="book0")}
    {_MOVED.format(to="book1", book="book0", assigned="near0")}
    {_ASSIGNED.format(to="near1", book="book1")}
    {_MOVED.format(to="book2", book="book1", assigned="near1")}
    {_ASSIGNED.format(to="near2", book="book2")}
    coded AS (
        SELECT r, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY r),
    flat AS (SELECT p, e, generate_subscripts(c, 1) AS k, unnest(c) AS x FROM book2),
    digest AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, k)) AS codebooks_sha256 FROM flat)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM numbered JOIN coded USING (r), digest
"""

ORACLES: dict[str, str] = {
    "op3_exact_topk": TOPK,
    "op5_decontaminate": CONTAMINATION,
    "op9_jaccard_join": JACCARD,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_vector_codes": VECTOR_CODES,
    "op13_path_join": PATH_JOIN,
}
