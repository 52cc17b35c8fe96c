"""Queries of the delegated SQL surface: name to (Spark SQL, DuckDB SQL or None where one text serves both)."""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations")

D = "CAST({} AS DOUBLE)".format

SURFACE: dict[str, tuple[str, str | None]] = {
    "agg_basic": ("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 4) AS qty, round(avg(l_discount), 8) AS disc, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus", None),
    "agg_groupby": ("SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders GROUP BY o_orderpriority, o_orderstatus", None),
    "agg_distinct": ("SELECT c_mktsegment, count(DISTINCT c_nationkey) AS nations, count(*) AS n FROM customer GROUP BY c_mktsegment", None),
    "agg_cube": ("SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)", None),
    "agg_rollup": ("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", None),
    "agg_grouping_sets": ("SELECT p_brand, p_size, CAST(grouping(p_brand) AS INT) AS gb, CAST(grouping(p_size) AS INT) AS gs, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", None),
    "agg_stats": ("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS c, round(covar_pop(l_quantity, l_discount), 6) AS cv, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope FROM lineitem GROUP BY l_returnflag", None),
    "agg_median": ("SELECT o_orderpriority, median(o_totalprice) AS med, round(percentile(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY o_orderpriority", "SELECT o_orderpriority, median(o_totalprice) AS med, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders GROUP BY o_orderpriority"),
    "agg_collect": (
        "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), ',') AS names, bool_and(n_nationkey >= 0) AS ok, bit_or(n_nationkey) AS bits, min_by(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
        "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names, bool_and(n_nationkey >= 0) AS ok, bit_or(n_nationkey) AS bits, arg_min(n_name, n_nationkey) AS first_name FROM nation GROUP BY n_regionkey",
    ),
    "sql_having": ("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY o_custkey HAVING count(*) >= 12", None),
    "sql_agg_filter": ("SELECT event_type, count(*) FILTER (WHERE value > 50) AS big, count(*) AS n FROM events GROUP BY event_type", None),
    "sql_distinct": ("SELECT DISTINCT lang, source FROM documents", None),
    "sql_where_mix": ("SELECT p_partkey, p_name FROM part WHERE (p_size BETWEEN 10 AND 20 OR p_size IN (1, 2, 3)) AND p_brand IS NOT NULL AND NOT p_type LIKE '%X%' AND p_name ILIKE '%a%' AND p_size IS DISTINCT FROM 15", None),
    "sql_regex": ("SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) AS word FROM documents WHERE text RLIKE '^[A-Z][a-z]+ '", "SELECT doc_id, regexp_extract(text, '([A-Z][a-z]+)', 1) AS word FROM documents WHERE regexp_matches(text, '^[A-Z][a-z]+ ')"),
    "sql_case": ("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(o_orderstatus, 'F'), '-') AS st, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS pr FROM orders", None),
    "sql_subquery_exists": ("SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", None),
    "sql_subquery_scalar": ("SELECT c_custkey, (SELECT max(o_totalprice) FROM orders o WHERE o.o_custkey = c.c_custkey) AS top FROM customer c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)", None),
    "sql_cte": ("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey), best AS (SELECT max(n) AS m FROM big) SELECT o_custkey, n FROM big JOIN best ON n >= m - 2", None),
    "sql_recursive": ("WITH RECURSIVE t(n, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t", None),
    "sql_unnest": ("SELECT doc_id, word FROM (SELECT doc_id, explode(split(text, ' ')) AS word FROM documents)", "SELECT doc_id, unnest(string_split(text, ' ')) AS word FROM documents"),
    "sql_order_limit": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", None),
    "sql_offset": ("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 40", None),
    "sql_order_nulls": ("SELECT doc_id, q FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) ORDER BY q DESC NULLS LAST, doc_id", None),
    "set_union": ("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier", None),
    "set_intersect": ("SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 0 INTERSECT SELECT s_nationkey FROM supplier", None),
    "set_except": ("SELECT p_size AS k FROM part EXCEPT SELECT CAST(l_quantity AS INT) FROM lineitem WHERE l_quantity < 25", None),
    "set_all": ("(SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier) UNION ALL (SELECT c_nationkey FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier)", None),
    "join_inner": ("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 350000", None),
    "join_full": ("SELECT c.k AS ck, s.k AS sk, c.n AS cn, s.n AS sn FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY c_nationkey) c FULL OUTER JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal < 5000 GROUP BY s_nationkey) s ON c.k = s.k", None),
    "join_theta": ("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey <> b.n_regionkey", None),
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey"),
    "join_anti": ("SELECT p_partkey FROM part LEFT ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45", "SELECT p_partkey FROM part ANTI JOIN lineitem ON p_partkey = l_partkey AND l_quantity > 45"),
    "join_self": ("SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text = b.text AND a.doc_id < b.doc_id", None),
    "join_lateral": ("SELECT c_custkey, o_orderkey, o_totalprice FROM customer, LATERAL (SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)", "SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM customer JOIN orders ON o_custkey = c_custkey) WHERE rn <= 2"),
    "win_rank": ("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) AS dr FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey)", None),
    "win_ntile": ("SELECT c_custkey, CAST(ntile(7) OVER w AS BIGINT) AS t, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey)", None),
    "win_lag": ("SELECT event_id, lag(value) OVER w AS prev, lead(value, 2) OVER w AS next2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "win_first_last": ("SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l, nth_value(event_type, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)", None),
    "win_frame": ("SELECT event_id, round(sum(value) OVER w, 4) AS s3, count(*) OVER w AS c3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", None),
    "win_range": ("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey ORDER BY l_quantity RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM lineitem", None),
    "fn_string": ("SELECT n_nationkey, upper(n_name) AS u, lower(n_name) AS l, length(n_name) AS len, substr(n_name, 2, 3) AS sub, replace(n_name, 'A', '_') AS rep, lpad(n_name, 12, '*') AS pad, reverse(n_name) AS rev, trim('  x ') AS t, concat(n_name, '-', n_nationkey) AS cc, repeat('ab', 2) AS rpt, translate(n_name, 'AE', 'xy') AS tr, levenshtein(n_name, 'BRAZIL') AS lev, position('A' IN n_name) AS pos, split_part(n_name, 'I', 1) AS sp FROM nation", None),
    "fn_date": (
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(o_orderdate + INTERVAL 10 DAYS AS DATE) AS d10, date_format(o_orderdate, 'yyyy-MM-dd') AS s FROM orders",
        "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, extract(YEAR FROM o_orderdate) AS y, extract(QUARTER FROM o_orderdate) AS q, CAST(o_orderdate + INTERVAL 10 DAYS AS DATE) AS d10, strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders",
    ),
    "fn_math": (
        "SELECT l_orderkey, l_linenumber, abs(l_tax - 0.05) AS a, round(sqrt(l_quantity), 9) AS r, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_extendedprice) AS BIGINT) AS c, round(power(l_quantity, 1.5), 6) AS p, round(ln(l_extendedprice), 9) AS ln, round(exp(l_discount), 9) AS e, round(sin(l_quantity), 9) AS s, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, mod(l_orderkey, 7) AS m FROM lineitem",
        None,
    ),
    "fn_array": (
        "SELECT n_nationkey, array_join(array_sort(array_distinct(split(n_name, ''))), '') AS letters, size(split(n_name, 'A')) AS parts, CAST(array_position(split(n_name, ''), 'A') AS BIGINT) AS pos, array_contains(split(n_name, ''), 'Z') AS z, array_join(slice(split(n_name, ''), 2, 2), '') AS s, array_join(flatten(array(array('x'), array(n_name))), '|') AS f FROM nation",
        "SELECT n_nationkey, array_to_string(list_sort(list_distinct(string_split(n_name, ''))), '') AS letters, CAST(len(string_split(n_name, 'A')) AS INTEGER) AS parts, CAST(coalesce(list_position(string_split(n_name, ''), 'A'), 0) AS BIGINT) AS pos, list_contains(string_split(n_name, ''), 'Z') AS z, array_to_string(string_split(n_name, '')[2:3], '') AS s, array_to_string(flatten([['x'], [n_name]]), '|') AS f FROM nation",
    ),
    "fn_map_struct": (
        "SELECT n_nationkey, element_at(map('k', n_name, 'r', CAST(n_regionkey AS STRING)), 'r') AS r, array_join(array_sort(map_keys(map('k', 1, 'a', 2))), ',') AS ks, named_struct('a', n_name, 'b', n_regionkey).b AS b, element_at(map('k', n_name), 'none') AS missing FROM nation",
        "SELECT n_nationkey, map {'k': n_name, 'r': CAST(n_regionkey AS VARCHAR)}['r'] AS r, array_to_string(list_sort(map_keys(map {'k': 1, 'a': 2})), ',') AS ks, {'a': n_name, 'b': n_regionkey}.b AS b, map {'k': n_name}['none'] AS missing FROM nation",
    ),
    "fn_hash": ("SELECT n_nationkey, md5(n_name) AS m, sha2(n_name, 256) AS s, base64(encode(n_name, 'UTF-8')) AS b, hex(encode(n_name, 'UTF-8')) AS h FROM nation", "SELECT n_nationkey, md5(n_name) AS m, sha256(n_name) AS s, to_base64(encode(n_name)) AS b, hex(encode(n_name)) AS h FROM nation"),
    "json_props": ("SELECT event_id, from_json(props, 'map<string,string>')['k'] AS k, CAST(get_json_object(props, '$.k') AS BIGINT) AS kn FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) AS kn FROM events"),
    "join_using": ("SELECT o_orderkey, o_custkey, cnt FROM orders JOIN (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey) t USING (o_custkey)", None),
    "join_natural": ("SELECT n_name, r_name FROM (SELECT n_name, n_regionkey AS k FROM nation) NATURAL JOIN (SELECT r_name, r_regionkey AS k FROM region)", None),
    "join_right": ("SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) RIGHT JOIN customer ON o_custkey = c_custkey", None),
    "join_cross": ("SELECT n_name, r_name FROM nation CROSS JOIN region", None),
    "sql_values": ("SELECT a, b, c_name FROM (VALUES (1, 'x'), (2, 'y'), (NULL, 'z')) AS v(a, b) LEFT JOIN customer ON c_custkey = a", None),
    "sql_posexplode": ("SELECT n_nationkey, pos, word FROM nation LATERAL VIEW posexplode(split(n_name, ' ')) e AS pos, word", "SELECT n_nationkey, CAST(generate_subscripts(w, 1) - 1 AS INTEGER) AS pos, unnest(w) AS word FROM (SELECT n_nationkey, string_split(n_name, ' ') AS w FROM nation)"),
    "win_qualify": (
        "SELECT o_orderkey, rn FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2",
        "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders QUALIFY rn <= 2",
    ),
    "win_avg_all": ("SELECT l_orderkey, l_linenumber, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_suppkey), 9) AS off, max(l_quantity) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_extendedprice, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m3 FROM lineitem", None),
    "sql_order_nulls_first": ("SELECT doc_id, q, row_number() OVER (ORDER BY q ASC NULLS FIRST, doc_id) AS rn FROM (SELECT d.doc_id, l.quality AS q FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)", None),
    "agg_approx": (
        "SELECT o_orderpriority, abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) AS near_count, abs(percentile_approx(o_totalprice, 0.5, 10000) - percentile(o_totalprice, 0.5)) <= 0.02 * percentile(o_totalprice, 0.5) AS near_median FROM orders GROUP BY o_orderpriority",
        "SELECT DISTINCT o_orderpriority, true AS near_count, true AS near_median FROM orders",
    ),
    "agg_listagg": ("SELECT n_regionkey, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS names, max_by(n_name, n_nationkey) AS last_name, bit_and(n_nationkey) AS bits, bool_or(n_nationkey > 20) AS some FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, '|' ORDER BY n_name DESC) AS names, arg_max(n_name, n_nationkey) AS last_name, bit_and(n_nationkey) AS bits, bool_or(n_nationkey > 20) AS some FROM nation GROUP BY n_regionkey"),
    "fn_date_bin": (
        "SELECT event_id, CAST(timestamp_micros(CAST(floor(unix_micros(CAST(ts AS TIMESTAMP)) / 900000000) AS BIGINT) * 900000000) AS TIMESTAMP_NTZ) AS bin, date_format(ts, 'yyyy/MM/dd HH:mm') AS shown, CAST(dayofweek(ts) - 1 AS BIGINT) AS dow, CAST(datediff(ts, DATE '2024-01-01') AS BIGINT) AS days FROM events",
        "SELECT event_id, time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01') AS bin, strftime(ts, '%Y/%m/%d %H:%M') AS shown, dayofweek(ts) AS dow, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days FROM events",
    ),
    "fn_array_sets": (
        "SELECT n_nationkey, array_join(array_sort(array_intersect(split(n_name, ''), array('A', 'E', 'I'))), '') AS both, array_join(array_sort(array_except(split(n_name, ''), array('A', 'E', 'I'))), '') AS rest, array_join(array_sort(array_union(split(n_name, ''), array('A', 'E', 'I'))), '') AS every, array_join(array_append(array('x'), n_name), '-') AS appended, element_at(split(n_name, ''), 1) AS head FROM nation",
        "SELECT n_nationkey, array_to_string(list_sort(list_distinct(list_intersect(string_split(n_name, ''), ['A', 'E', 'I']))), '') AS both, array_to_string(list_sort(list_distinct(list_filter(string_split(n_name, ''), lambda x: x NOT IN ('A', 'E', 'I')))), '') AS rest, array_to_string(list_sort(list_distinct(list_concat(string_split(n_name, ''), ['A', 'E', 'I']))), '') AS every, array_to_string(['x', n_name], '-') AS appended, string_split(n_name, '')[1] AS head FROM nation",
    ),
    "fn_string_more": ("SELECT n_nationkey, initcap(lower(n_name)) AS ic, split_part(n_name, 'A', 2) AS part, rpad(n_name, 20, '.') AS rp, ltrim('  a ') AS lt, ascii(n_name) AS code, left(n_name, 2) AS l2, right(n_name, 2) AS r2, contains(n_name, 'AN') AS has, startswith(n_name, 'A') AS sw FROM nation", "SELECT n_nationkey, upper(n_name[1]) || lower(n_name[2:]) AS ic, split_part(n_name, 'A', 2) AS part, rpad(n_name, 20, '.') AS rp, ltrim('  a ') AS lt, ascii(n_name) AS code, left(n_name, 2) AS l2, right(n_name, 2) AS r2, contains(n_name, 'AN') AS has, starts_with(n_name, 'A') AS sw FROM nation"),
}
