"""Acceptance scripts for the SQL transform.

Each entry is ``name -> (input table, Spark SQL script)``. The script sees
its input only as ``return_arrow_table``. Money is summed as DECIMAL and
cast to DOUBLE afterwards so results do not depend on summation order.
Window partitions are chosen on keys with bounded groups (line items of one
order), and per-key top-k relies on Spark's window group limit, which keeps
at most k rows per key in every map task before the shuffle.
"""

SCRIPTS = {
    # D1 projection, filter, CASE, LIKE / ILIKE, BETWEEN, IN
    "sql_transform_d01": ("events", """
SELECT event_id, user_id,
       CASE WHEN value >= 100 THEN 'high' WHEN value >= 10 THEN 'mid' ELSE 'low' END AS band,
       upper(event_type) AS etype
FROM return_arrow_table a
WHERE (event_type LIKE 'p%' OR event_type ILIKE 'CL%')
  AND value BETWEEN 5 AND 200
  AND event_type IN ('purchase', 'click', 'view')"""),
    # D2 group-by, HAVING, FILTER, count distinct
    "sql_transform_d02": ("events", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total_value,
       count(*) FILTER (WHERE value > 100) AS n_big
FROM return_arrow_table
GROUP BY event_type
HAVING count(*) > 10"""),
    # D3 rollup
    "sql_transform_d03": ("lineitem", """
SELECT l_returnflag, l_linestatus, count(*) AS n,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
       CAST(grouping(l_returnflag) AS INT) AS g_flag,
       CAST(grouping(l_linestatus) AS INT) AS g_status
FROM return_arrow_table
GROUP BY ROLLUP (l_returnflag, l_linestatus)"""),
    # D3 cube
    "sql_transform_d03_cube": ("lineitem", """
SELECT l_linestatus, year(l_shipdate) AS ship_year, count(*) AS n,
       CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue
FROM return_arrow_table
GROUP BY CUBE (l_linestatus, year(l_shipdate))"""),
    # D3 grouping sets
    "sql_transform_d03_sets": ("orders", """
SELECT o_orderstatus, o_orderpriority, count(*) AS n
FROM return_arrow_table
GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())"""),
    # D4 window ranking, analytic and frames (groups = line items of one order)
    "sql_transform_d04": ("lineitem", """
SELECT l_orderkey, l_linenumber,
       CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS BIGINT) AS rn,
       CAST(dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity) AS BIGINT) AS rk,
       CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) OVER (
            PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running_qty,
       lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice) AS prev_line,
       count(*) OVER (PARTITION BY l_orderkey) AS n_lines
FROM return_arrow_table"""),
    # D5 top-k per key
    "sql_transform_d05": ("lineitem", """
SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (
  SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice,
         row_number() OVER (PARTITION BY l_suppkey
                            ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
  FROM return_arrow_table) ranked
WHERE rn <= 3"""),
    # D5 global order + limit (a top-n report)
    "sql_transform_d05_topn": ("lineitem", """
SELECT l_orderkey, l_linenumber, l_extendedprice
FROM return_arrow_table
ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber
LIMIT 10"""),
    # D6 correlated subqueries: scalar, EXISTS, NOT EXISTS
    "sql_transform_d06": ("events", """
SELECT a.event_id, a.user_id, a.value
FROM return_arrow_table a
WHERE a.value >= (SELECT max(b.value) FROM return_arrow_table b
                  WHERE b.event_type = a.event_type AND b.user_id = a.user_id)
  AND EXISTS (SELECT 1 FROM return_arrow_table c
              WHERE c.user_id = a.user_id AND c.event_type = 'signup')
  AND NOT EXISTS (SELECT 1 FROM return_arrow_table d
                  WHERE d.user_id = a.user_id AND d.event_type = 'error' AND d.value > 500)"""),
    # D6 self-join against an aggregate of the same table
    "sql_transform_d06_selfjoin": ("events", """
SELECT a.event_id, a.user_id, s.n_events, s.n_types
FROM return_arrow_table a
JOIN (SELECT user_id, count(*) AS n_events, count(DISTINCT event_type) AS n_types
      FROM return_arrow_table GROUP BY user_id) s
  ON a.user_id = s.user_id
WHERE a.event_type = 'purchase'"""),
    # D7 union / intersect / except
    "sql_transform_d07": ("events", """
((SELECT user_id FROM return_arrow_table WHERE event_type = 'purchase'
  INTERSECT
  SELECT user_id FROM return_arrow_table WHERE event_type = 'signup')
 EXCEPT
 SELECT user_id FROM return_arrow_table WHERE event_type = 'error' AND value > 400)
UNION
SELECT user_id FROM return_arrow_table WHERE value > 550"""),
    # D8 string functions over whole texts
    "sql_transform_d08": ("documents", """
SELECT doc_id, upper(source) AS src, length(text) AS n_chars,
       length(text) - length(replace(text, '.', '')) AS n_periods,
       size(split(text, '\\n')) AS n_lines,
       concat_ws('-', lang, source) AS tag,
       regexp_replace(lower(lang), '[aeiou]', '*') AS masked_lang,
       lpad(CAST(doc_id AS STRING), 8, '0') AS padded,
       position('the' IN text) AS first_the
FROM return_arrow_table"""),
    # D9 date functions and truncation
    "sql_transform_d09": ("events", """
SELECT event_id,
       CAST(date_trunc('DAY', ts) AS DATE) AS day,
       CAST(date_trunc('MONTH', ts) AS DATE) AS month,
       datediff(CAST(ts AS DATE), DATE '2024-01-01') AS day_no,
       extract(HOUR FROM ts) AS hour,
       extract(DAYOFWEEK_ISO FROM ts) AS iso_dow,
       date_format(ts, 'yyyy-MM') AS ym,
       date_add(CAST(ts AS DATE), 30) AS due
FROM return_arrow_table"""),
    # D10 math, casts, null handling
    "sql_transform_d10": ("lineitem", """
SELECT l_orderkey, l_linenumber,
       CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS net,
       abs(l_quantity - 25) AS dist,
       power(l_linenumber, 2) AS sq,
       try_cast(l_returnflag AS INT) AS flag_num,
       coalesce(nullif(l_returnflag, 'N'), 'none') AS flag,
       CAST(l_quantity AS BIGINT) AS qty_int,
       CAST(floor(l_extendedprice / 1000) AS BIGINT) AS price_band,
       CAST(sign(l_quantity - 25) AS INT) AS side
FROM return_arrow_table"""),
    # D11 JSON and nested fields
    "sql_transform_d11": ("events", """
SELECT event_id, get_json_object(props, '$.k') AS k_text,
       from_json(props, 'k INT').k AS k,
       named_struct('t', event_type, 'u', user_id).t AS etype,
       item
FROM return_arrow_table
LATERAL VIEW explode(array(user_id, event_id * 2)) x AS item"""),
    # D12 exact quantiles (bounded state: counts per distinct quantity)
    "sql_transform_d12": ("lineitem", """
SELECT l_returnflag, median(l_quantity) AS med_qty, percentile(l_quantity, 0.9) AS p90_qty,
       count(*) AS n
FROM return_arrow_table
GROUP BY l_returnflag"""),
    # D12 approximate aggregates, within their error bounds of the exact ones
    "sql_transform_d12_approx": ("lineitem", """
WITH a AS (
  SELECT l_returnflag, approx_count_distinct(l_partkey, 0.02) AS approx_parts, count(DISTINCT l_partkey) AS parts,
         percentile_approx(l_quantity, 0.5, 10000) AS approx_med, count(*) AS n
  FROM return_arrow_table GROUP BY l_returnflag),
b AS (
  SELECT t.l_returnflag, count_if(t.l_quantity < a.approx_med) AS below, count_if(t.l_quantity <= a.approx_med) AS upto
  FROM return_arrow_table t JOIN a ON t.l_returnflag <=> a.l_returnflag GROUP BY t.l_returnflag)
SELECT a.l_returnflag, parts, n, abs(approx_parts - parts) <= 0.1 * parts AS parts_near,
       below <= 0.501 * n AND upto >= 0.499 * n AS median_near
FROM a JOIN b ON a.l_returnflag <=> b.l_returnflag"""),
    # D13 pivot
    "sql_transform_d13": ("lineitem", """
SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM return_arrow_table)
PIVOT (sum(l_quantity) FOR l_linestatus IN ('O' AS o, 'F' AS f))"""),
    # D14 CTE chain
    "sql_transform_d14": ("events", """
WITH daily AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n
  FROM return_arrow_table GROUP BY 1, 2),
busy AS (
  SELECT user_id, count(*) AS active_days, max(n) AS peak FROM daily GROUP BY user_id),
ranked AS (SELECT * FROM busy WHERE active_days >= 10)
SELECT user_id, active_days, peak FROM ranked"""),
    # D2 aggregate breadth: conditional counts, boolean aggregates, exact
    # mean, time range, ordered distinct list
    "sql_transform_d02b": ("events", """
SELECT event_type,
       count_if(value > 100) AS n_big,
       bool_and(value >= 0) AS all_non_negative,
       bool_or(value > 500) AS any_huge,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) / count(value) AS mean_value,
       min(ts) AS first_ts, max(ts) AS last_ts,
       listagg(DISTINCT get_json_object(props, '$.k'), ',')
         WITHIN GROUP (ORDER BY get_json_object(props, '$.k')) AS k_values
FROM return_arrow_table
GROUP BY event_type"""),
    # D9 more date functions: week truncation, month bounds, day of year,
    # interval arithmetic
    "sql_transform_d09b": ("events", """
SELECT event_id,
       CAST(date_trunc('WEEK', ts) AS DATE) AS week_start,
       make_date(year(ts), month(ts), 1) AS month_start,
       last_day(CAST(ts AS DATE)) AS month_end,
       dayofyear(ts) AS doy,
       ts + INTERVAL 36 HOURS AS due_ts
FROM return_arrow_table"""),
    # D11 arrays with higher-order functions over whole texts
    "sql_transform_d11b": ("documents", """
SELECT doc_id,
       size(split(text, ' ')) AS n_tokens,
       aggregate(transform(split(text, ' '), w -> length(w)), 0, (acc, x) -> acc + x) AS token_chars,
       size(filter(split(text, ' '), w -> length(w) > 6)) AS n_long_tokens,
       array_contains(split(text, ' '), 'the') AS has_the
FROM return_arrow_table"""),
    # D7 multiset set operations
    "sql_transform_d07b": ("events", """
(SELECT event_type, user_id FROM return_arrow_table WHERE value > 50
 INTERSECT ALL
 SELECT event_type, user_id FROM return_arrow_table WHERE value < 400)
EXCEPT ALL
SELECT event_type, user_id FROM return_arrow_table WHERE event_type = 'error'"""),
    # D13 unpivot
    "sql_transform_d13b": ("lineitem", """
SELECT l_orderkey, l_linenumber, measure, amount FROM (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount * 100 AS discount_pct,
         l_tax * 100 AS tax_pct
  FROM return_arrow_table)
UNPIVOT (amount FOR measure IN (l_quantity AS quantity, discount_pct, tax_pct))"""),
    # D4 more window functions and a RANGE frame (groups = one order's lines)
    "sql_transform_d04b": ("lineitem", """
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
FROM return_arrow_table"""),
    # D5 a page of a top-n report
    "sql_transform_d05_page": ("orders", """
SELECT o_orderkey, o_totalprice
FROM return_arrow_table
ORDER BY o_totalprice DESC, o_orderkey
LIMIT 10 OFFSET 10"""),
    # D10 integer and floating math, bit operations, null handling
    "sql_transform_d10b": ("lineitem", """
SELECT l_orderkey, l_linenumber,
       l_linenumber div 2 AS half_line,
       pmod(l_orderkey, 7) AS weekday_slot,
       l_orderkey & 15 AS low_bits,
       shiftleft(l_linenumber, 2) AS line_x4,
       greatest(l_tax, l_discount) AS max_rate,
       least(l_tax, l_discount) AS min_rate,
       CAST(ceil(l_extendedprice) AS BIGINT) AS price_ceil,
       sqrt(l_quantity) AS qty_sqrt,
       try_divide(l_tax, l_discount) AS tax_per_discount,
       nvl(nullif(l_linestatus, 'O'), 'open') AS status
FROM return_arrow_table"""),
    # The default (identity) SQL transform
    "sql_identity": ("orders", "SELECT * FROM return_arrow_table a"),
}
