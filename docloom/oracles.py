"""DuckDB SQL of each catalogue query that SQL can express."""

ORACLES: dict[str, str] = {
    "scan_all": 'SELECT event_id, ts, user_id, event_type, value FROM events',
    "record_count": "SELECT 'events' AS collection, count(*) AS record_count FROM events UNION ALL SELECT 'orders', count(*) FROM orders",
    "point_id": 'SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 42',
    "filter_eq": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'click'",
    "filter_ne": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type <> 'click'",
    "filter_gt_lte": 'SELECT event_id, ts, user_id, event_type, value FROM events WHERE value > 10 AND value <= 50',
    "filter_between_int": 'SELECT p_partkey, p_name, p_size FROM part WHERE p_size >= 10 AND p_size <= 20',
    "filter_between_strict": 'SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20',
    "filter_string_range": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment >= 'BUILDING' AND c_mktsegment < 'HOUSEHOLD'",
    "filter_bool": 'SELECT doc_id, (toxic = 1) AS is_toxic FROM labels WHERE (toxic = 1) = true',
    "filter_three_clauses": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = 'click' AND user_id < 50 AND ts > TIMESTAMP '2024-01-15 00:00:00'",
    "filter_no_hit": "SELECT event_id, ts, user_id, event_type, value FROM events WHERE event_type = '__no_hit__'",
    "missing_field_ne": 'SELECT event_id, k FROM (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END AS k FROM events) t WHERE k <> 7',
    "like_prefix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'",
    "like_suffix": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%ring'",
    "like_contains": "SELECT doc_id, n_chars FROM documents WHERE text LIKE '%the%'",
    "like_underscore": "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#_'",
    "like_multi": "SELECT page_id, url FROM pages WHERE url LIKE 'http://%example%/en/%'",
    "hybrid_eq_like_topk": "SELECT doc_id, n_chars FROM documents WHERE lang = 'en' AND text LIKE '%the%' ORDER BY n_chars DESC, doc_id DESC LIMIT 20",
    "order_limit_desc": 'SELECT event_id, ts, user_id, event_type, value FROM events ORDER BY ts DESC NULLS LAST, event_id DESC LIMIT 50',
    "order_limit_asc": 'SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice ASC NULLS FIRST, o_orderkey ASC LIMIT 25',
    "implicit_order_limit": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC LIMIT 100",
    "composite_topk": "SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30",
    "prefix_order_by_id": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'small%' ORDER BY p_partkey ASC LIMIT 15",
    "exact_multi_intersect": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE 'Customer#00000%'",
    "fetch_one": 'SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 899 ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1',
    "header_projection": "SELECT event_id, value FROM events WHERE event_type = 'purchase'",
    "view_partial_mask": 'SELECT c_custkey, c_name FROM customer',
    "view_value_mask": "SELECT c_custkey, '***' AS c_name, c_mktsegment FROM customer",
    "include_one_hop": "SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'",
    "include_two_hop": "SELECT l_orderkey, l_linenumber, c_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R' AND l_quantity >= 49",
    "include_left_outer_count": 'SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey',
    "json_field_filter": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 90",
    "snapshot_visible": "SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE ts <= TIMESTAMP '2024-01-20 00:00:00') t WHERE rn = 1 AND event_type <> 'error'",
    "version_count": 'SELECT user_id, count(*) AS n_versions FROM events GROUP BY user_id',
    "version_compaction": "SELECT user_id, event_id FROM (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk, max(CASE WHEN ts <= TIMESTAMP '2024-01-20 00:00:00' THEN ts END) OVER (PARTITION BY user_id) AS base_ts FROM events) t WHERE ts > TIMESTAMP '2024-01-20 00:00:00' OR ts = base_ts OR rk <= 2",
    "write_conflicts": "SELECT DISTINCT a.user_id FROM (SELECT user_id FROM events WHERE event_type = 'purchase' AND ts > TIMESTAMP '2024-01-29 00:00:00') a JOIN (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) b ON a.user_id = b.user_id WHERE b.last_ts > TIMESTAMP '2024-01-29 12:00:00'",
    "upsert_last_wins": "SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'Y' WHEN o_orderkey % 10 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "update_where": "SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'F' ELSE o_orderstatus END AS o_orderstatus FROM orders",
    "delete_where": "SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'P')",
    "hash_index": 'SELECT event_type AS value, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type',
    "range_index_gte": 'SELECT p_size AS k, p_partkey AS id FROM part WHERE p_size >= 40',
    "selectivity": "SELECT 'event_type' AS field, 1.0e0 / count(DISTINCT event_type) AS selectivity FROM events UNION ALL SELECT 'user_id', 1.0e0 / count(DISTINCT user_id) FROM events",
    "segment_stats": 'SELECT CAST(floor(event_id / 4096) AS BIGINT) AS segment_id, count(*) AS n, min(user_id) AS min_user, max(user_id) AS max_user, min(value) AS min_value, max(value) AS max_value FROM events GROUP BY 1',
    "block_skip_count": 'SELECT count(*) AS blocks, CAST(sum(CASE WHEN max_v < 9990 THEN 1 ELSE 0 END) AS BIGINT) AS skipped FROM (SELECT floor(event_id / 512) AS b, max(event_id) AS max_v FROM events GROUP BY 1) t',
    "value_dictionary": 'SELECT segment_id, value, freq, code FROM (SELECT segment_id, value, freq, row_number() OVER (PARTITION BY segment_id ORDER BY freq DESC, value ASC) AS code FROM (SELECT CAST(floor(event_id / 4096) AS BIGINT) AS segment_id, user_id AS value, count(*) AS freq FROM events GROUP BY 1, 2) a) b WHERE code <= 254',
    "trigram_postings": 'SELECT g AS gram, count(DISTINCT p_partkey) AS n FROM (SELECT p_partkey, unnest(list_distinct(list_transform(range(1, length(p_name) - 1), lambda i: substring(p_name, i, 3)))) AS g FROM part) t GROUP BY g',
    "trigram_candidates": "SELECT p_partkey FROM part WHERE p_name LIKE '%idget%'",
    "latency_histogram": 'SELECT b AS le, count(CASE WHEN value <= b THEN 1 END) AS n FROM events CROSS JOIN (VALUES (1),(5),(10),(25),(50),(100),(250),(500),(1000)) AS t(b) GROUP BY b',
    "tier_classify": "SELECT user_id, CASE WHEN cnt = 0 THEN 'Frozen' WHEN idle_s <= 300 THEN 'Hot' WHEN idle_s <= 604800 THEN 'Warm' ELSE 'Cold' END AS temperature FROM (SELECT user_id, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) AS idle_s, user_id % 10 AS cnt FROM events GROUP BY user_id) t",
    "colocation": "SELECT concat('user:', CAST(user_id AS VARCHAR)) AS semantic_key, event_id AS member FROM events",
    "compaction_order": "SELECT event_id, row_number() OVER (ORDER BY event_type ASC NULLS FIRST, event_id ASC) AS pos FROM events",
    "lifecycle_action": "SELECT o_orderkey, CASE WHEN o_custkey % 5 > 0 OR o_orderdate > TIMESTAMP '2001-01-01 00:00:00' THEN 'Keep' WHEN o_orderstatus = 'F' THEN 'SoftDelete' WHEN o_orderstatus = 'O' THEN 'Archive' ELSE 'NeedsManualRefresh' END AS action FROM orders",
    "deleted_pool_sweep": "SELECT o_orderkey FROM orders WHERE o_orderdate + INTERVAL 30 DAY <= TIMESTAMP '1996-01-01 00:00:00'",
    "replication_resume": 'SELECT event_id AS sequence, event_type FROM events WHERE event_id > 4000 ORDER BY event_id LIMIT 500',
    "replay_guard": 'SELECT user_id, min(event_id) AS first_event FROM events GROUP BY user_id',
    "sync_plan": "WITH sent AS (SELECT event_id, user_id AS node, event_id AS origin_sequence, ts FROM events), done AS (SELECT * FROM sent WHERE ts < TIMESTAMP '2024-01-25 00:00:00' AND node % 3 <> 0), high AS (SELECT node, max(origin_sequence) AS high FROM done GROUP BY node) SELECT node, origin_sequence FROM sent LEFT JOIN high USING (node) WHERE event_id NOT IN (SELECT event_id FROM done) AND origin_sequence > coalesce(high, 0)",
    "schema_union_by_name": "SELECT doc_id, lang, NULL AS quality FROM documents UNION ALL SELECT doc_id, NULL AS lang, quality FROM labels",
    "access_sessions": 'SELECT user_id, event_id, CASE WHEN lag(ts) OVER w IS NOT NULL AND epoch(ts) - epoch(lag(ts) OVER w) <= 600 THEN 1 ELSE 0 END AS burst FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)',
    "audit_digest": "SELECT event_id, sha256(concat(CAST(event_id AS VARCHAR), '|', event_type)) AS digest FROM events",
    "include_two_hop_count": "SELECT n_nationkey, count(o_orderkey) AS n_related FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey",
    "include_nested": "SELECT n_nationkey, count(c_custkey) AS n, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS keys FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey",
    "include_under_view": "SELECT o_orderkey, c_custkey, '***' AS c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "sql_under_view": "SELECT c_custkey, '***' AS c_name FROM customer WHERE c_custkey > 100 AND c_custkey <= 1000",
    "colocation_summary": "SELECT concat('user:', CAST(user_id AS VARCHAR)) AS semantic_key, count(*) AS members, min(event_id) AS first_member FROM events GROUP BY 1",
    "partition_catch_up": "WITH sent AS (SELECT event_id, user_id AS node, event_id AS origin_sequence, ts FROM events), done AS (SELECT * FROM sent WHERE ts < TIMESTAMP '2024-01-25 00:00:00' AND node % 3 <> 0), high AS (SELECT node, max(origin_sequence) AS high FROM done GROUP BY node) SELECT node, origin_sequence FROM sent LEFT JOIN high USING (node) WHERE event_id NOT IN (SELECT event_id FROM done) AND origin_sequence > coalesce(high, 0) AND node % 2 = 0",
    "apply_report": "SELECT count(DISTINCT event_id) FILTER (event_id > 2500) AS applied, count(*) - count(DISTINCT event_id) FILTER (event_id > 2500) AS skipped, greatest(max(event_id), 2500) AS last FROM (SELECT event_id FROM events UNION ALL SELECT event_id FROM events WHERE event_id % 4 = 0) t",
    "rebalance_tick": """WITH b AS (
  SELECT user_id AS block_id, epoch_ns(max(ts)) AS last_ns, CASE user_id % 4 WHEN 0 THEN 'Hot' WHEN 1 THEN 'Warm' WHEN 2 THEN 'Cold' ELSE 'Frozen' END AS old,
    CASE WHEN user_id % 9 <> 0 THEN user_id % 3 ELSE 0 END AS recent, CASE WHEN user_id % 6 <> 0 THEN user_id % 5 ELSE 1 END AS n, user_id % 6 = 0 OR user_id % 7 = 0 AS immortal, user_id % 2 = 1 AS hit
  FROM events GROUP BY user_id
), d AS (
  SELECT *, CASE WHEN n = 0 AND NOT immortal THEN 'Frozen' WHEN 1706659200000000000 - last_ns <= 300000000000 THEN 'Hot' WHEN 1706659200000000000 - last_ns <= 604800000000000 THEN 'Warm' ELSE 'Cold' END AS due FROM b
), t AS (
  SELECT *, CASE WHEN due = 'Frozen' OR NOT hit THEN due WHEN old IN ('Cold', 'Frozen') THEN 'Warm' WHEN old = 'Warm' AND recent >= 2 THEN 'Hot' ELSE due END AS tier FROM d
)
SELECT block_id, tier, CASE WHEN tier = old THEN 'Noop' WHEN tier = 'Frozen' THEN 'Freeze' WHEN tier = 'Cold' THEN 'Compress'
  WHEN list_position(['Hot', 'Warm', 'Cold', 'Frozen'], tier) < list_position(['Hot', 'Warm', 'Cold', 'Frozen'], old) THEN 'Promote' ELSE 'Demote' END AS move FROM t""",
    "access_counters": """WITH s AS (SELECT user_id AS block_id, epoch_ns(max(ts)) AS last_ns, count(*) AS total, user_id % 4 AS recent FROM events GROUP BY user_id)
SELECT block_id, CASE WHEN block_id % 2 = 0 THEN 1706612400000000000 ELSE last_ns END AS last_access_ns,
  CASE WHEN block_id % 2 <> 0 THEN recent WHEN 1706612400000000000 - last_ns <= 600000000000 THEN recent + 1 ELSE 1 END AS access_count_recent, total + CASE WHEN block_id % 2 = 0 THEN 1 ELSE 0 END AS access_count_total FROM s""",
    "initial_ttl": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 3 ELSE 0 END AS ttl_count, o_orderstatus <> 'F' AS immortal, o_orderdate AS last_refresh FROM orders",
    "ttl_decrement": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN greatest(3 - o_orderkey % 4 - 1, 0) ELSE 0 - o_orderkey % 4 END AS ttl_count FROM orders",
    "ttl_refresh": "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 5 ELSE 1 END AS ttl_count, CASE WHEN o_custkey % 3 = 0 THEN TIMESTAMP '2024-01-01 00:00:00' ELSE o_orderdate END AS last_refresh FROM orders",
    "soft_delete": "SELECT o_orderkey, o_orderdate AS deleted_at, o_orderdate + INTERVAL 30 DAY AS purge_after, 'expired' AS reason FROM orders",
    "base4_round_trip": """SELECT p_partkey, symbols, translate(symbols, '0123', '3210') AS mirror, true AS same, 0 AS n_broken FROM (
  SELECT p_partkey, rpad(s, CAST(ceil(length(s) / 3.0) AS INT) * 3, '0') AS symbols FROM (SELECT p_partkey, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate(hex(p_name), '0123456789ABCDEF', 'ghijklmnopqrstuv'), 'g', '00'), 'h', '01'), 'i', '02'), 'j', '03'), 'k', '10'), 'l', '11'), 'm', '12'), 'n', '13'), 'o', '20'), 'p', '21'), 'q', '22'), 'r', '23'), 's', '30'), 't', '31'), 'u', '32'), 'v', '33') AS s FROM part))""",
    "fnv_hash": "SELECT p_partkey, (SELECT CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) FROM (SELECT list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(range(0, strlen(p_name)), lambda i: CAST('0x' || substr(hex(p_name), 2 * i + 1, 2) AS HUGEINT))), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h)) AS hash FROM part",
    "materialised_frames": """SELECT signature, symbols, translate(symbols, '0123', '3210') AS mirror, '_payload' AS field_name, length(symbols) AS length, value_hash FROM (
  SELECT event_id AS signature, rpad(s, CAST(ceil(length(s) / 3.0) AS INT) * 3, '0') AS symbols, h AS value_hash FROM events JOIN (SELECT event_type, replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(translate(hex(event_type), '0123456789ABCDEF', 'ghijklmnopqrstuv'), 'g', '00'), 'h', '01'), 'i', '02'), 'j', '03'), 'k', '10'), 'l', '11'), 'm', '12'), 'n', '13'), 'o', '20'), 'p', '21'), 'q', '22'), 'r', '23'), 's', '30'), 't', '31'), 'u', '32'), 'v', '33') AS s, (SELECT CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) FROM (SELECT list_reduce(list_concat([CAST(14695981039346656037 AS HUGEINT)], list_transform(range(0, strlen(event_type)), lambda i: CAST('0x' || substr(hex(event_type), 2 * i + 1, 2) AS HUGEINT))), lambda a, b: (xor(a, b) * 1099511628211) % 18446744073709551616) AS h)) AS h FROM (SELECT DISTINCT event_type FROM events)) USING (event_type))""",
    "scrub_report": "SELECT count(*) FILTER (p_partkey % 7 <> 0) AS checked, count(*) FILTER (p_partkey % 7 = 0) AS missing, count(*) FILTER (p_partkey % 7 <> 0 AND p_partkey % 100 = 0) AS corrupt FROM part",
    "bloom_probe": """WITH bits AS (SELECT DISTINCT CAST(floor(event_id / 512) AS BIGINT) AS segment_id, unnest([CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 4096, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 9, 8) AS BIGINT) % 4096, CAST('0x' || substr(md5(CAST(user_id AS VARCHAR)), 17, 8) AS BIGINT) % 4096]) AS bit FROM events), asked AS (SELECT DISTINCT unnest([CAST('0x' || substr(md5('7'), 1, 8) AS BIGINT) % 4096, CAST('0x' || substr(md5('7'), 9, 8) AS BIGINT) % 4096, CAST('0x' || substr(md5('7'), 17, 8) AS BIGINT) % 4096]) AS bit)
SELECT segment_id FROM bits JOIN asked USING (bit) GROUP BY segment_id HAVING count(*) = (SELECT count(*) FROM asked)""",
    "dictionary_coverage": "WITH f AS (SELECT CAST(floor(event_id / 4096) AS BIGINT) AS segment_id, user_id, count(*) AS freq FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY segment_id ORDER BY freq DESC, user_id) AS code FROM f) SELECT segment_id, CAST(sum(freq) FILTER (code <= 254) AS BIGINT) AS covered, CAST(sum(freq) AS BIGINT) AS total, max(code) <= 254 AS complete FROM r GROUP BY segment_id",
    "audit_chain": """WITH RECURSIVE e AS (
  SELECT CAST(user_id AS VARCHAR) AS identity_id, event_id AS audit_id, event_type AS operation, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, '{"identity_id":"' || user_id || '","audit_id":' || event_id || ',"operation":"' || event_type || '"}' AS body FROM events
), c AS (
  SELECT identity_id, audit_id, operation, i, repeat('0', 64) AS prev_hash, sha256(repeat('0', 64) || '|' || body) AS entry_hash FROM e WHERE i = 1
  UNION ALL SELECT e.identity_id, e.audit_id, e.operation, e.i, c.entry_hash, sha256(c.entry_hash || '|' || e.body) FROM c JOIN e ON e.identity_id = c.identity_id AND e.i = c.i + 1
) SELECT identity_id, audit_id, operation, prev_hash, entry_hash FROM c""",
    "path_explain": """WITH n AS (SELECT count(*) AS n, 1.0e0 / count(DISTINCT user_id) AS u, 1.0e0 / count(DISTINCT event_type) AS t FROM events)
SELECT 'by_id' AS query, 'direct' AS path, 'event_id' AS field, 1.0e0 AS cost UNION ALL SELECT 'by_user', 'index', 'user_id', 1.0e0 + n * u * 2.0e0 FROM n
UNION ALL SELECT 'span', 'between', 'value', 1.0e0 + n * 0.1e0 * 2.0e0 FROM n UNION ALL SELECT 'all', 'scan', NULL, n * 0.1e0 FROM n""",
    "hash_prefilter": "SELECT event_id AS signature FROM events WHERE event_type = 'click'",
    "byte_range": "SELECT event_id AS signature FROM events WHERE event_type > 'click' AND event_type <= 'signup'",
    "signature_probe": "SELECT event_id AS signature, event_type AS payload FROM events WHERE event_id = 4242",
    "header_order": "SELECT event_id AS signature, event_id % 10 AS version FROM events ORDER BY version DESC, signature DESC LIMIT 40",
    "header_order_fallback": "SELECT event_id AS signature FROM events ORDER BY event_id LIMIT 40",
    "replayed_versions": "SELECT user_id, max(event_id) AS sequence, max_by(event_type, event_id) AS event_type FROM events WHERE user_id IS NOT NULL GROUP BY user_id",
    "scalar_keys": "SELECT p_partkey, CAST(p_size AS VARCHAR) AS size_key, TRY_CAST(p_name AS BIGINT) AS sort_key, CAST(floor(log2(greatest(p_size, 1))) AS INT) AS bucket FROM part",
}
