"""DuckDB oracle SQL for the acceptance queries (same column names)."""

# Fixture views shared by several oracles, mirroring lakehook.plans.lake.
_LOG = """
log AS (
  SELECT event_id AS log_id, user_id,
         CASE event_type WHEN 'click' THEN 'PUT' WHEN 'error' THEN 'DELETE'
                         WHEN 'view' THEN 'GET' ELSE 'POST' END AS action,
         CAST(CAST(props->>'$.k' AS INT) % 10 AS BIGINT) AS node_id,
         (event_id % 3 = 0) AS processed
  FROM events)"""

_REG = """
base AS (SELECT DISTINCT user_id, node_id FROM log WHERE (user_id + node_id) % 4 = 0),
reg AS (
  SELECT user_id*10+node_id AS transform_id, user_id, node_id AS in_node_id,
         'POST' AS in_action, (node_id+1)%10 AS out_node_id,
         CASE WHEN node_id % 2 = 0 THEN 'POST' ELSE 'PUT' END AS out_action,
         (user_id % 5 <> 0) AS enabled FROM base
  UNION ALL
  SELECT 1000000+user_id*10+node_id, user_id, node_id, 'POST', (node_id+2)%10, 'POST', true
  FROM base WHERE node_id % 3 = 0)"""

TRIGGER_MATCH = f"""
WITH {_LOG}, {_REG},
m AS (
  SELECT l.log_id, l.user_id, l.node_id, r.transform_id, r.out_node_id, r.out_action, r.enabled,
         row_number() OVER (PARTITION BY l.log_id ORDER BY r.transform_id) AS rn
  FROM log l JOIN reg r ON l.user_id=r.user_id AND l.node_id=r.in_node_id AND l.action=r.in_action
  WHERE NOT l.processed)
SELECT log_id, user_id, node_id, transform_id, CAST(out_node_id AS BIGINT) AS out_node_id
FROM m WHERE rn=1 AND enabled AND out_action='POST'
"""

ORACLES = {
    "trigger_match": TRIGGER_MATCH,
}

# File catalog view mirroring lake.files_from_documents.
_FILES = """
files AS (
  SELECT doc_id AS file_id, source AS dataset, lang,
         CAST(doc_id AS VARCHAR) || '.' || lang || '.txt' AS name,
         '/lake/' || lang || '/' || source || '/' || CAST(doc_id AS VARCHAR) || '.' || lang || '.txt' AS path,
         n_chars AS size_bytes,
         DATE '2024-01-01' + CAST((doc_id // 20) % 10 AS INT) AS created
  FROM documents)"""

ORACLES.update({
    "predicate_conj": """
SELECT event_id, event_type, value, CAST(props->>'$.k' AS INT) AS k FROM events
WHERE event_type IN ('click', 'purchase', 'view') AND event_type <> 'view'
  AND value IS NOT NULL AND CAST(props->>'$.k' AS INT) IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)
  AND props IS NOT NULL""",
    "path_functions": f"""
WITH {_FILES}
SELECT file_id, string_split(name, '.')[-1] AS file_extension,
       string_split(path, '/')[-1] AS base_name,
       CASE WHEN suffix(path, '.parquet') THEN path
            ELSE regexp_replace(path, '\\.[^.]*$', '') || '.parquet' END AS output_path,
       'lake:dataset:::' || dataset AS resource_name
FROM files""",
    "distinct_paths": f"""
WITH {_FILES}
SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS dataset_dir,
       string_split(name, '.')[-1] AS file_extension
FROM files""",
    "exists_semi": """
SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "exclude_anti": """
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""",
    "list_members": f"""
WITH {_FILES}
SELECT DISTINCT dataset FROM files WHERE lang = 'en' AND dataset NOT IN ('src0', 'src1')""",
    "grouped_slots": """
SELECT source, count(*) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS total_chars
FROM documents GROUP BY source ORDER BY total_chars DESC, source LIMIT 5""",
    "name_lookup": """
SELECT e.event_id, coalesce(c.c_custkey, 999999999) AS custkey
FROM events e
LEFT JOIN (SELECT c_name, min(c_custkey) AS c_custkey FROM customer GROUP BY c_name) c
  ON c.c_name = 'Customer#' || lpad(CAST(e.user_id * 20 AS VARCHAR), 9, '0')""",
    "id_to_name": """
SELECT o.o_orderkey, c.c_name
FROM orders o
LEFT JOIN (SELECT c_custkey, min(c_name) AS c_name FROM customer GROUP BY c_custkey) c
  ON c.c_custkey = o.o_custkey""",
    "owned_lookup": """
SELECT e.event_id, c.c_name, (c.c_custkey IS NOT NULL) AS found
FROM (SELECT event_id, user_id, CAST(props->>'$.k' AS INT) % 25 AS claimed_nation FROM events) e
LEFT JOIN customer c ON c.c_custkey = e.user_id AND c.c_nationkey = e.claimed_nation""",
    "trigger_gate": f"""
WITH {_LOG}, {_REG}
SELECT log_id, node_id FROM log WHERE node_id IN (SELECT in_node_id FROM reg)""",
    "registration_counts": f"""
WITH {_LOG}, {_REG}
SELECT in_node_id AS node_id, count(*) AS n_transforms FROM reg GROUP BY in_node_id""",
    "first_per_key": """
SELECT user_id, ts, event_id, event_type FROM (
  SELECT user_id, ts, event_id, event_type,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn
  FROM events) WHERE rn = 1""",
    "cascade_delete": """
WITH doomed_orders AS (
  SELECT o_orderkey FROM orders o
  WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_mktsegment = 'AUTOMOBILE'))
SELECT l_orderkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM doomed_orders d WHERE d.o_orderkey = l.l_orderkey)""",
    "upsert_files": f"""
WITH {_FILES},
base AS (SELECT dataset, path, file_id, CAST(created AS TIMESTAMP) AS created,
                CAST(created AS TIMESTAMP) AS last_modified FROM files WHERE lang IS DISTINCT FROM 'es'),
inc AS (SELECT dataset, path, file_id, TIMESTAMP '2024-02-01 00:00:00' AS created,
               TIMESTAMP '2024-02-01 00:00:00' AS last_modified FROM files WHERE lang IS DISTINCT FROM 'en')
SELECT coalesce(b.dataset, i.dataset) AS dataset, coalesce(b.path, i.path) AS path,
       CASE WHEN b.path IS NOT NULL THEN b.file_id ELSE i.file_id END AS file_id,
       CASE WHEN b.path IS NOT NULL THEN b.created ELSE i.created END AS created,
       CASE WHEN i.path IS NOT NULL THEN i.last_modified ELSE b.last_modified END AS last_modified
FROM base b FULL OUTER JOIN inc i ON b.dataset = i.dataset AND b.path = i.path""",
    "update_rows": """
SELECT d.doc_id, d.lang, CASE WHEN c.doc_id IS NOT NULL THEN 'archive' ELSE d.source END AS source
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE lang = 'es') c
  ON c.doc_id = d.doc_id""",
    "patch_rows": """
WITH p AS (
  SELECT o_custkey AS c_custkey,
         CASE WHEN sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) >= 3
              THEN 'PRIORITY' END AS c_mktsegment,
         CASE WHEN count(*) > 12 THEN 0 END AS c_nationkey
  FROM orders GROUP BY o_custkey)
SELECT c.c_custkey, c.c_name, coalesce(p.c_mktsegment, c.c_mktsegment) AS c_mktsegment,
       CAST(coalesce(p.c_nationkey, c.c_nationkey) AS INTEGER) AS c_nationkey
FROM customer c LEFT JOIN p ON p.c_custkey = c.c_custkey""",
    "mark_processed": """
SELECT event_id AS log_id,
       CASE WHEN event_id <= (SELECT max(event_id) FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00')
            THEN true ELSE (event_id % 3 = 0) END AS processed
FROM events""",
    "insert_rows": """
SELECT c_custkey AS user_id, c_name AS username FROM customer
UNION ALL
SELECT s_suppkey + 10000000, s_name FROM supplier""",
    "lifecycle_transition": """
WITH files AS (SELECT doc_id AS file_id, source AS dataset,
                      DATE '2024-01-01' + CAST((doc_id // 20) % 10 AS INT) AS created,
                      'hot' AS storage_class FROM documents),
ds AS (SELECT DISTINCT source AS dataset,
              CASE WHEN source IN ('src1','src2','src3') THEN 1
                   WHEN source IN ('src4','src5') THEN 2 ELSE 3 END AS lifecycle_id
       FROM documents),
rules AS (SELECT dataset, lifecycle_id, dataset NOT IN ('src2', 'src5') AS rule_enabled FROM ds),
trans AS (SELECT * FROM (VALUES (1,3,'cold'),(2,3,'cold'),(3,7,'archive'))
          t(lifecycle_id, days_till_transition, transition_to)),
due AS (SELECT ds.dataset, t.days_till_transition, t.transition_to
        FROM ds JOIN rules r ON ds.lifecycle_id=r.lifecycle_id AND ds.dataset=r.dataset
                JOIN trans t ON r.lifecycle_id=t.lifecycle_id
        WHERE r.rule_enabled)
SELECT f.file_id, f.dataset, coalesce(d.transition_to, f.storage_class) AS storage_class
FROM files f LEFT JOIN due d ON f.dataset=d.dataset
  AND date_diff('day', f.created, DATE '2024-01-08') = d.days_till_transition""",
    "human_size": """
WITH s AS (SELECT doc_id, n_chars AS b1, n_chars * 1000 AS b2, n_chars * 100000000 AS b3 FROM documents)
SELECT doc_id,
  CASE WHEN b1 < 1024 THEN CAST(b1 AS VARCHAR) || ' bytes' WHEN b1 < 1048576 THEN printf('%.2f KB', b1 / 1024.0)
       WHEN b1 < 1073741824 THEN printf('%.2f MB', b1 / 1048576.0) ELSE printf('%.2f GB', b1 / 1073741824.0) END AS size,
  CASE WHEN b2 < 1024 THEN CAST(b2 AS VARCHAR) || ' bytes' WHEN b2 < 1048576 THEN printf('%.2f KB', b2 / 1024.0)
       WHEN b2 < 1073741824 THEN printf('%.2f MB', b2 / 1048576.0) ELSE printf('%.2f GB', b2 / 1073741824.0) END AS size_x1000,
  CASE WHEN b3 < 1024 THEN CAST(b3 AS VARCHAR) || ' bytes' WHEN b3 < 1048576 THEN printf('%.2f KB', b3 / 1024.0)
       WHEN b3 < 1073741824 THEN printf('%.2f MB', b3 / 1048576.0) ELSE printf('%.2f GB', b3 / 1073741824.0) END AS size_x1e8
FROM s""",
    "path_parents": f"""
WITH {_FILES}
SELECT file_id, unnest(list_transform(range(2, len(parts)),
                 lambda i: array_to_string(list_slice(parts, 1, i), '/'))) AS parent_dir
FROM (SELECT file_id, string_split(path, '/') AS parts FROM files)""",
    "sanitize_names": """
SELECT page_id, trim(translate(url, '<>:"/\\|?*$&;()[]{}^!#%@', ''), ' .') AS name FROM pages""",
    "local_time": """
SELECT event_id, date_trunc('second', timezone('America/Denver', ts AT TIME ZONE 'UTC')) AS local_ts
FROM events""",
    "json_roundtrip": """
SELECT event_id,
       CAST(to_json({'event_id': event_id,
                     'ts': regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''),
                     'event_type': event_type, 'user_id': user_id}) AS VARCHAR) AS details,
       CAST(props->>'$.k' AS INT) AS k,
       CAST(json_extract(props, '$.k') AS INT) AS k_parsed
FROM events""",
    "tags_clean": """
WITH t AS (SELECT doc_id, list_filter(string_split(lang || ',,' || source || ',', ','), lambda x: x <> '') AS tags
           FROM documents)
SELECT doc_id, CAST(len(tags) AS INTEGER) AS n_tags, array_to_string(tags, '|') AS tags FROM t""",
    "file_age": f"""
WITH {_FILES}
SELECT file_id, CAST(date_diff('day', created, DATE '2024-01-08') AS INTEGER) AS age_days FROM files""",
    "quality_checks": """
SELECT 'user_name_length' AS rule,
       count(*) FILTER (WHERE coalesce(length(c_name) BETWEEN 8 AND 32, false)) AS n_pass,
       count(*) FILTER (WHERE NOT coalesce(length(c_name) BETWEEN 8 AND 32, false)) AS n_fail FROM customer
UNION ALL
SELECT 'name_distinct_chars',
       count(*) FILTER (WHERE coalesce(length(list_distinct(string_split(c_name, ''))) >= 12, false)),
       count(*) FILTER (WHERE NOT coalesce(length(list_distinct(string_split(c_name, ''))) >= 12, false)) FROM customer
UNION ALL
SELECT 'segment_not_in_name',
       count(*) FILTER (WHERE coalesce(NOT contains(lower(c_name), lower(c_mktsegment)), false)),
       count(*) FILTER (WHERE NOT coalesce(NOT contains(lower(c_name), lower(c_mktsegment)), false)) FROM customer
UNION ALL
SELECT 'acctbal_at_most',
       count(*) FILTER (WHERE coalesce(c_acctbal <= 1500, false)),
       count(*) FILTER (WHERE NOT coalesce(c_acctbal <= 1500, false)) FROM customer""",
})

ORACLES.update({
    "sql_transform_d01": """
SELECT event_id, user_id,
       CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS band,
       upper(event_type) AS etype
FROM events a
WHERE (event_type LIKE 'p%' OR event_type ILIKE 'CL%')
  AND value BETWEEN 5 AND 200
  AND event_type IN ('purchase', 'click', 'view')""",
    "sql_transform_d02": """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       count(*) FILTER (WHERE value > 100) AS n_big
FROM events GROUP BY event_type HAVING count(*) > 10""",
    "sql_transform_d03": """
SELECT l_returnflag, l_linestatus, count(*) AS n,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       CAST(grouping(l_returnflag) AS INT) AS g_flag,
       CAST(grouping(l_linestatus) AS INT) AS g_status
FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    "sql_transform_d03_cube": """
SELECT l_linestatus, CAST(year(l_shipdate) AS INTEGER) AS ship_year, count(*) AS n,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM lineitem GROUP BY CUBE (l_linestatus, year(l_shipdate))""",
    "sql_transform_d03_sets": """
SELECT o_orderstatus, o_orderpriority, count(*) AS n
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())""",
    "sql_transform_d04": """
SELECT l_orderkey, l_linenumber,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rn,
       dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS rk,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_qty,
       lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS prev_line,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines
FROM lineitem""",
    "sql_transform_d05": """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
  FROM lineitem) ranked
WHERE rn <= 3""",
    "sql_transform_d05_topn": """
SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10""",
    "sql_transform_d06": """
SELECT a.event_id, a.user_id, a.value FROM events a
WHERE a.value >= (SELECT max(b.value) FROM events b
                  WHERE b.event_type = a.event_type AND b.user_id = a.user_id)
  AND EXISTS (SELECT 1 FROM events c WHERE c.user_id = a.user_id AND c.event_type = 'signup')
  AND NOT EXISTS (SELECT 1 FROM events d
                  WHERE d.user_id = a.user_id AND d.event_type = 'error' AND d.value > 500)""",
    "sql_transform_d06_selfjoin": """
SELECT a.event_id, a.user_id, s.n_events, s.n_types FROM events a
JOIN (SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types
      FROM events GROUP BY user_id) s ON a.user_id = s.user_id
WHERE a.event_type = 'purchase'""",
    "sql_transform_d07": """
((SELECT user_id FROM events WHERE event_type = 'purchase'
  INTERSECT
  SELECT user_id FROM events WHERE event_type = 'signup')
 EXCEPT
 SELECT user_id FROM events WHERE event_type = 'error' AND value > 400)
UNION
SELECT user_id FROM events WHERE value > 550""",
    "sql_transform_d08": """
SELECT doc_id, upper(source) AS src, CAST(length(text) AS INTEGER) AS n_chars,
       CAST(length(text) - length(replace(text, '.', '')) AS INTEGER) AS n_periods,
       CAST(len(string_split(text, chr(10))) AS INTEGER) AS n_lines,
       concat_ws('-', lang, source) AS tag,
       regexp_replace(lower(lang), '[aeiou]', '*', 'g') AS masked_lang,
       lpad(CAST(doc_id AS VARCHAR), 8, '0') AS padded,
       CAST(position('the' IN text) AS INTEGER) AS first_the
FROM documents""",
    "sql_transform_d09": """
SELECT event_id,
       CAST(date_trunc('day', ts) AS DATE) AS day,
       CAST(date_trunc('month', ts) AS DATE) AS month,
       CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day_no,
       CAST(hour(ts) AS INTEGER) AS hour,
       CAST(isodow(ts) AS INTEGER) AS iso_dow,
       strftime(ts, '%Y-%m') AS ym,
       CAST(CAST(ts AS DATE) + 30 AS DATE) AS due
FROM events""",
    "sql_transform_d10": """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net,
       abs(l_quantity - 25) AS dist,
       CAST(power(l_linenumber, 2) AS DOUBLE) AS sq,
       TRY_CAST(l_returnflag AS INTEGER) AS flag_num,
       coalesce(nullif(l_returnflag, 'N'), 'none') AS flag,
       CAST(l_quantity AS BIGINT) AS qty_int,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS price_band,
       CAST(sign(l_quantity - 25) AS INTEGER) AS side
FROM lineitem""",
    "sql_transform_d11": """
SELECT event_id, props->>'$.k' AS k_text,
       CAST(json_extract(props, '$.k') AS INTEGER) AS k,
       struct_pack(t := event_type, u := user_id).t AS etype,
       unnest([user_id, event_id * 2]) AS item
FROM events""",
    "sql_transform_d12": """
SELECT l_returnflag, median(l_quantity) AS med_qty, quantile_cont(l_quantity, 0.9) AS p90_qty,
       count(*) AS n
FROM lineitem GROUP BY l_returnflag""",
    "sql_transform_d13": """
SELECT l_returnflag,
       sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS o,
       sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS f
FROM lineitem GROUP BY l_returnflag""",
    "sql_transform_d14": """
WITH daily AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
busy AS (SELECT user_id, count(*) AS active_days, max(n) AS peak FROM daily GROUP BY user_id),
ranked AS (SELECT * FROM busy WHERE active_days >= 10)
SELECT user_id, active_days, peak FROM ranked""",
    "sql_identity": "SELECT * FROM orders",
})

_MATCHED = """
m AS (
  SELECT l.log_id, l.user_id, l.node_id, r.transform_id, r.out_node_id, r.out_action, r.enabled,
         row_number() OVER (PARTITION BY l.log_id ORDER BY r.transform_id) AS rn
  FROM log l JOIN reg r ON l.user_id=r.user_id AND l.node_id=r.in_node_id AND l.action=r.in_action
  WHERE NOT l.processed),
work AS (SELECT DISTINCT user_id, node_id, transform_id, CAST(out_node_id AS BIGINT) AS out_node_id
         FROM m WHERE rn=1 AND enabled AND out_action='POST'),
act AS (SELECT event_id, user_id, CAST(CAST(props->>'$.k' AS INT) % 10 AS BIGINT) AS node_id,
               event_type, value FROM events)"""

_DISPATCH_PY = f"""
WITH {_LOG}, {_REG}, {_MATCHED},
p AS (SELECT w.user_id, w.node_id, w.transform_id, w.out_node_id, a.event_id, a.value
      FROM work w JOIN act a ON a.user_id = w.user_id AND a.node_id = w.node_id
      WHERE a.event_type = 'purchase')
SELECT user_id, node_id AS dataset_id, transform_id, event_id,
       value - min(value) OVER (PARTITION BY user_id, node_id, transform_id) AS value_delta,
       out_node_id AS out_dataset_id,
       'u' || CAST(user_id AS VARCHAR) || '_d' || CAST(node_id AS VARCHAR) || '.parquet' AS out_file
FROM p"""

ORACLES.update({
    "python_transform": """
WITH f AS (SELECT * FROM events WHERE event_type <> 'error')
SELECT event_id, event_type, value - (SELECT min(value) FROM f) AS value_delta,
       value / (SELECT max(value) FROM f) AS value_share
FROM f""",
    "python_identity": "SELECT * FROM events",
    "per_file_transform": """
SELECT event_id, event_type, value - min(value) OVER (PARTITION BY coalesce(event_id, -1) // 1000) AS value_delta
FROM events""",
    "native_transform": """
SELECT event_id, user_id, value * 2 AS value_x2 FROM events WHERE value > 100""",
    "scan_parquet": """
SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1995-01-01 00:00:00' AND l_quantity < 10""",
    "scan_csv": "SELECT * FROM orders",
    "scan_dataset": """
SELECT o_orderkey, o_orderstatus, o_totalprice,
       CASE WHEN o_orderstatus = 'F' THEN 'parquet' ELSE 'csv' END AS fmt
FROM orders""",
    "catalog_scan": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'",
    "sink_roundtrip": """
SELECT l_orderkey, l_linenumber, l_quantity, 'lineitem_copy.parquet' AS stored_as FROM lineitem""",
    "ingest": """
SELECT 'orders_' || o_orderstatus || '.parquet' AS file_name, o_orderkey, o_orderstatus,
       CAST(1 AS BIGINT) AS n_events
FROM orders""",
    "append_docs": """
SELECT sha256(CAST(to_json({'conv_id': conv_id, 'turn': turn}) AS VARCHAR)) AS _id,
       conv_id, turn, role, CAST(length(text) AS INTEGER) AS n_chars
FROM conversations""",
    "append_log": """
SELECT event_id AS log_id, ts AS created_timestamp,
       CASE event_type WHEN 'click' THEN 'PUT' WHEN 'error' THEN 'DELETE'
                       WHEN 'view' THEN 'GET' ELSE 'POST' END AS action,
       CAST(CAST(props->>'$.k' AS INT) % 10 AS BIGINT) AS dataset_id,
       false AS processed
FROM events""",
    "register_transform": f"""
WITH {_LOG}, {_REG}
SELECT 'reg ' || CAST(transform_id AS VARCHAR) AS name, user_id, in_node_id AS in_dataset_id,
       CAST(out_node_id AS BIGINT) AS out_dataset_id, in_action, out_action
FROM reg WHERE transform_id >= 1000000""",
    "dispatch_batch": _DISPATCH_PY,
    "dispatch_stream": _DISPATCH_PY,
    "dispatch_batch_sql": f"""
WITH {_LOG}, {_REG}, {_MATCHED}
SELECT a.event_id, a.event_type, a.value * 2 AS value2, w.out_node_id AS out_dataset_id,
       'identity.parquet' AS out_file
FROM (SELECT DISTINCT transform_id, out_node_id, user_id, node_id FROM work) w
JOIN act a ON a.user_id = w.user_id AND a.node_id = w.node_id
WHERE a.value > 100""",
})

ORACLES["dispatch_record"] = f"""
WITH {_LOG}, {_REG}, {_MATCHED}
SELECT DISTINCT user_id, out_node_id AS dataset_id, 'POST' AS action,
       'u' || CAST(user_id AS VARCHAR) || '_d' || CAST(node_id AS VARCHAR) || '.parquet' AS object_name,
       true AS is_transform_output
FROM work"""

ORACLES["trigger_report"] = f"""
WITH {_LOG}, {_REG},
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, in_node_id, in_action
                                        ORDER BY transform_id) AS rn FROM reg),
first AS (SELECT * FROM ranked WHERE rn = 1)
SELECT l.log_id, f.transform_id,
       CASE WHEN f.transform_id IS NULL THEN 'no_registration'
            WHEN NOT coalesce(f.enabled, false) THEN 'disabled'
            WHEN f.out_action <> 'POST' THEN 'output_not_post'
            ELSE 'dispatched' END AS status
FROM log l LEFT JOIN first f
  ON l.user_id = f.user_id AND l.node_id = f.in_node_id AND l.action = f.in_action
WHERE NOT l.processed"""

ORACLES["quality_transforms"] = f"""
WITH {_LOG}, {_REG},
r AS (SELECT 'transform t' || CAST(transform_id AS VARCHAR) || ' of user ' || CAST(user_id AS VARCHAR)
             || ' on dataset ' || CAST(in_node_id AS VARCHAR) || ' writing to dataset '
             || CAST(out_node_id AS VARCHAR) AS name,
             CAST(200 AS DECIMAL(4,0)) AS timeout FROM reg)
SELECT 'name_length' AS rule,
       count(*) FILTER (WHERE coalesce(length(name) BETWEEN 1 AND 64, false)) AS n_pass,
       count(*) FILTER (WHERE NOT coalesce(length(name) BETWEEN 1 AND 64, false)) AS n_fail FROM r
UNION ALL
SELECT 'timeout_bound', count(*) FILTER (WHERE coalesce(timeout <= 1500, false)),
       count(*) FILTER (WHERE NOT coalesce(timeout <= 1500, false)) FROM r
UNION ALL
SELECT 'name_distinct_chars',
       count(*) FILTER (WHERE coalesce(length(list_distinct(string_split(name, ''))) >= 5, false)),
       count(*) FILTER (WHERE NOT coalesce(length(list_distinct(string_split(name, ''))) >= 5, false)) FROM r"""

ORACLES["update_tags"] = f"""
WITH {_FILES}
SELECT CAST(regexp_extract(dataset, '(\\d+)$', 1) AS BIGINT) AS dataset_id, 'PUT' AS action, path,
       'de|reviewed|' || dataset AS tags
FROM files WHERE lang = 'de'"""

ORACLES["lake_flow"] = """
SELECT 'orders_' || o_orderstatus || '_' || (o_orderkey // 10000) || '.parquet' AS out_file,
       CAST(2 AS BIGINT) AS out_dataset_id, o_orderpriority, count(*) AS n, max(o_totalprice) AS max_price
FROM orders
GROUP BY o_orderstatus, o_orderkey // 10000, o_orderpriority"""

ORACLES["dispatch_sql_files"] = """
SELECT 'events_' || (event_id // 1000) || '.parquet' AS name, event_type, count(*) AS n, max(value) AS top,
       arg_max(event_id, (value, -event_id)) AS top_event
FROM events GROUP BY event_id // 1000, event_type"""

ORACLES["ledger_pending"] = f"""
WITH {_LOG}
SELECT log_id, user_id, action FROM log WHERE log_id > (SELECT max(log_id) // 2 FROM log)"""

ORACLES["ledger_flags"] = f"""
WITH {_LOG}, half AS (SELECT max(log_id) // 2 AS h FROM log)
SELECT log_id, log_id <= h + h // 2 AS processed FROM log, half"""

ORACLES["create_datasets"] = """
WITH req AS (SELECT c_custkey AS user_id, lower(c_mktsegment) AS name FROM customer
             UNION ALL
             SELECT c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer),
valid AS (SELECT * FROM req WHERE length(name) BETWEEN 3 AND 63),
win AS (SELECT name, min(user_id) AS user_id FROM valid GROUP BY name),
free AS (SELECT * FROM win WHERE name NOT IN ('building'))
SELECT user_id, name, 'created' AS outcome FROM free
UNION ALL
SELECT user_id, name, 'name_length' FROM req WHERE NOT coalesce(length(name) BETWEEN 3 AND 63, false)
UNION ALL
SELECT v.user_id, v.name, 'name_taken' FROM valid v
WHERE NOT EXISTS (SELECT 1 FROM free f WHERE f.name = v.name AND f.user_id = v.user_id)"""

ORACLES["delete_users"] = f"""
WITH {_LOG}, {_REG},
doomed AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment = 'AUTOMOBILE'),
regs_left AS (SELECT user_id, count(*) AS n_transforms FROM reg
              WHERE user_id NOT IN (SELECT user_id FROM doomed) GROUP BY user_id)
SELECT l.log_id, l.user_id, coalesce(r.n_transforms, 0) AS n_transforms
FROM log l LEFT JOIN regs_left r ON r.user_id = l.user_id
WHERE NOT EXISTS (SELECT 1 FROM doomed d WHERE d.user_id = l.user_id)"""

ORACLES.update({
    "sql_transform_d02b": """
SELECT event_type,
       CAST(count_if(value > 100) AS BIGINT) AS n_big,
       bool_and(value >= 0) AS all_non_negative,
       bool_or(value > 500) AS any_huge,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean_value,
       min(ts) AS first_ts, max(ts) AS last_ts,
       string_agg(DISTINCT props->>'$.k', ',' ORDER BY props->>'$.k') AS k_values
FROM events GROUP BY event_type""",
    "sql_transform_d09b": """
SELECT event_id,
       CAST(date_trunc('week', ts) AS DATE) AS week_start,
       make_date(year(ts), month(ts), 1) AS month_start,
       last_day(CAST(ts AS DATE)) AS month_end,
       CAST(dayofyear(ts) AS INTEGER) AS doy,
       ts + INTERVAL 36 HOUR AS due_ts
FROM events""",
    "sql_transform_d11b": """
SELECT doc_id,
       CAST(len(string_split(text, ' ')) AS INTEGER) AS n_tokens,
       CAST(list_sum(list_transform(string_split(text, ' '), lambda w: length(w))) AS INTEGER) AS token_chars,
       CAST(len(list_filter(string_split(text, ' '), lambda w: length(w) > 6)) AS INTEGER) AS n_long_tokens,
       list_contains(string_split(text, ' '), 'the') AS has_the
FROM documents""",
})

ORACLES.update({
    "sql_transform_d07b": """
(SELECT event_type, user_id FROM events WHERE value > 50
 INTERSECT ALL
 SELECT event_type, user_id FROM events WHERE value < 400)
EXCEPT ALL
SELECT event_type, user_id FROM events WHERE event_type = 'error'""",
    "sql_transform_d13b": """
SELECT l_orderkey, l_linenumber, 'quantity' AS measure, l_quantity AS amount FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'discount_pct', l_discount * 100 FROM lineitem
UNION ALL
SELECT l_orderkey, l_linenumber, 'tax_pct', l_tax * 100 FROM lineitem""",
})

ORACLES.update({
    "sql_transform_d04b": """
SELECT l_orderkey, l_linenumber, l_extendedprice,
       CAST(ntile(2) OVER (PARTITION BY l_orderkey
                           ORDER BY l_extendedprice, l_linenumber) AS BIGINT) AS half,
       percent_rank() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS pct_rank,
       first_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cheapest,
       last_value(l_extendedprice) OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice
           ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS dearest,
       lead(l_extendedprice) OVER (PARTITION BY l_orderkey
                                   ORDER BY l_extendedprice, l_linenumber) AS next_price,
       sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber
           RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS qty_last_two_lines
FROM lineitem""",
    "sql_transform_d05_page": """
SELECT o_orderkey, o_totalprice FROM orders
ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10""",
})

ORACLES["sql_transform_d10b"] = """
SELECT l_orderkey, l_linenumber,
       CAST(l_linenumber // 2 AS BIGINT) AS half_line,
       ((l_orderkey % 7) + 7) % 7 AS weekday_slot,
       l_orderkey & 15 AS low_bits,
       l_linenumber << 2 AS line_x4,
       greatest(l_tax, l_discount) AS max_rate,
       least(l_tax, l_discount) AS min_rate,
       CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil,
       sqrt(l_quantity) AS qty_sqrt,
       CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS tax_per_discount,
       coalesce(nullif(l_linestatus, 'O'), 'open') AS status
FROM lineitem"""

ORACLES["per_file_ordered"] = """
SELECT event_id, CAST(sum(cents) OVER f AS BIGINT) AS running, cents - lag(cents) OVER f AS change,
       min(event_id) OVER (PARTITION BY event_id // 1000) AS first_id
FROM (SELECT event_id, CAST(round(value * 100) AS BIGINT) AS cents FROM events) WINDOW f AS (PARTITION BY event_id // 1000 ORDER BY event_id)"""

ORACLES["scan_by_name"] = """
SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey * 2 END AS extra
FROM orders"""

_TWO_USERS = """
f AS (SELECT 1 + o_custkey % 2 AS user_id,
             'orders_' || o_orderstatus || '_' || (o_orderkey // 10000) || '.parquet' AS name, o_orderstatus,
             count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY ALL)"""

ORACLES["run_batch"] = f"""
WITH {_TWO_USERS}
SELECT user_id, name, n, top FROM f WHERE user_id = 2 OR o_orderstatus <> 'P'"""

ORACLES["dispatch_failures"] = f"""
WITH {_TWO_USERS}
SELECT user_id, CASE user_id WHEN 1 THEN 'status.py' ELSE 'total.sql' END AS src_file, name,
       user_id = 1 AND o_orderstatus = 'P' AS failed,
       CASE WHEN user_id = 2 OR o_orderstatus <> 'P' THEN CAST(1 AS BIGINT) END AS n_rows
FROM f"""

ORACLES["empty_rerun"] = """
SELECT 'orders_' || o_orderstatus || '_' || (o_orderkey // 10000) || '.parquet' AS name, o_orderkey FROM orders
WHERE o_custkey % 2 = 0 AND o_orderstatus <> 'F'"""

ORACLES["match_salted"] = f"SELECT log_id, transform_id FROM ({TRIGGER_MATCH})"

ORACLES["match_all"] = f"""
WITH {_LOG}, {_REG}
SELECT l.log_id, r.transform_id
FROM log l JOIN reg r ON l.user_id=r.user_id AND l.node_id=r.in_node_id AND l.action=r.in_action
WHERE NOT l.processed AND r.enabled AND r.out_action='POST'"""

ORACLES["json_nulls"] = """
SELECT o_orderkey,
       CAST(to_json({'o_orderkey': o_orderkey,
                     'status': CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END}) AS VARCHAR) AS details,
       strftime(o_orderdate, '%Y-%m-%d') AS day
FROM orders"""

ORACLES["sql_transform_d12_approx"] = """
SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(*) AS n, true AS parts_near, true AS median_near
FROM lineitem GROUP BY l_returnflag"""

ORACLES["update_datasets"] = """
SELECT c_custkey AS user_id, c_custkey + 1000000 AS dataset_id,
       CASE WHEN c_nationkey = 3 AND c_acctbal > 0 THEN 'x|y' ELSE c_mktsegment END AS tags,
       c_nationkey = 3 AS put
FROM customer"""

ORACLES["delete_datasets"] = """
SELECT o_custkey AS user_id, o_orderkey AS file_id FROM orders
WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"""

ORACLES["delete_files"] = """
SELECT o_custkey AS user_id, o_orderkey AS file_id FROM orders WHERE o_orderpriority <> '1-URGENT'"""

ORACLES["scan_declared"] = """
SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 4 = 3 THEN o_custkey * 2 END AS extra, NULL::VARCHAR AS absent
FROM orders"""

ORACLES["asof_events"] = """
WITH ev AS (SELECT event_id, event_type, value,
                   CASE user_id % 10 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS grp FROM events),
bought AS (SELECT * FROM ev WHERE event_type = 'purchase')
SELECT e.event_id, e.grp, b.event_id AS purchase_id, b.value AS purchase_value
FROM (SELECT * FROM ev WHERE event_type = 'error') e ASOF LEFT JOIN bought b
  ON e.grp = b.grp AND e.event_id >= b.event_id"""

ORACLES["merged_sketches"] = """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, true AS users_near, true AS median_near
FROM events GROUP BY event_type"""

ORACLES["registration_reach"] = f"""
WITH RECURSIVE {_LOG}, {_REG},
step AS (SELECT DISTINCT in_node_id AS s, out_node_id AS t FROM reg WHERE transform_id >= 1000000),
walk AS (SELECT s, t, 1 AS hops FROM step
         UNION SELECT w.s, e.t, w.hops + 1 FROM walk w JOIN step e ON e.s = w.t WHERE w.hops < 10)
SELECT s AS in_dataset_id, CAST(t AS BIGINT) AS out_dataset_id, min(hops) AS hops FROM walk GROUP BY ALL"""

ORACLES["variant_details"] = """
SELECT event_id, CAST(props->>'$.k' AS INT) AS k, props->>'$.k' AS k_text, NULL::VARCHAR AS missing,
       'OBJECT<k: BIGINT>' AS shape FROM events"""

ORACLES["csv_rejects"] = """
SELECT o_orderkey,
       CASE WHEN (o_orderkey % 7 = 2) <> (o_orderkey % 13 = 5) THEN 'columns'
            WHEN o_orderkey % 11 = 3 THEN 'type' ELSE 'read' END AS fate,
       CASE WHEN (o_orderkey % 7 = 2) = (o_orderkey % 13 = 5) AND o_orderkey % 11 <> 3 THEN o_totalprice END AS o_totalprice
FROM orders"""
