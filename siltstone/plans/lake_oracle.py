"""DuckDB twins of the layer, upload, paging and stream queries."""

from __future__ import annotations

# Column lists of the driver tables, in file order.
COLUMNS = {
    "region": "r_regionkey,r_name",
    "nation": "n_nationkey,n_name,n_regionkey",
    "customer": "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment",
    "supplier": "s_suppkey,s_name,s_nationkey,s_acctbal",
    "part": "p_partkey,p_name,p_brand,p_type,p_size,p_retailprice",
    "orders": "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority",
    "lineitem": "l_orderkey,l_partkey,l_suppkey,l_linenumber,l_quantity,l_extendedprice,l_discount,l_tax,"
                "l_returnflag,l_linestatus,l_shipdate",
    "events": "event_id,ts,user_id,event_type,value,props",
    "documents": "doc_id,text,lang,source,n_chars",
    "embeddings": "vec_id,embedding,label",
    "pages": "page_id,url,html",
    "benchmark": "item_id,text",
    "labels": "doc_id,quality,toxic",
    "conversations": "conv_id,turn,role,text",
}


def _listing(template: str, tables: list[str]) -> str:
    return " UNION ALL ".join(template.format(table=t, columns=COLUMNS[t]) for t in tables)


_STATS = """
SELECT 'ORD.' || o_orderkey AS "Series_reference",
       CASE WHEN o_orderpriority <> '2-HIGH' THEN CAST(date_trunc('month', o_orderdate) AS DATE) END AS period_date,
       CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS "Data_value", o_orderstatus AS "STATUS",
       'Dollars' AS "UNITS", '6' AS "Magnitude", 'Orders' AS "Subject", o_orderpriority AS "Group",
       CAST(o_custkey AS VARCHAR) AS "Series_title_1", CAST(NULL AS VARCHAR) AS "Series_title_2",
       CAST(NULL AS VARCHAR) AS "Series_title_3", CAST(NULL AS VARCHAR) AS "Series_title_4",
       CAST(NULL AS VARCHAR) AS "Series_title_5"
FROM orders WHERE o_orderstatus <> 'O'
"""

_NAMES = """
SELECT origin, id, CASE WHEN kept = '' OR regexp_matches(kept, '^\\p{L}') THEN kept ELSE 'table_' || kept END AS name
FROM (SELECT origin, id, regexp_replace(replace(lower(text), ' ', '_'), '[^\\p{L}\\p{N}_]', '', 'g') AS kept FROM (
  SELECT 'part' AS origin, p_partkey AS id, p_name AS text FROM part
  UNION ALL SELECT 'customer', c_custkey, c_name FROM customer
  UNION ALL SELECT 'pages', page_id, url FROM pages
  UNION ALL SELECT 'benchmark', item_id, text FROM benchmark))
"""

_ORPHANS = " UNION ALL ".join(
    f"SELECT '{child}.{ck}>{parent}.{pk}' AS rule, count(DISTINCT {ck}) AS orphan_keys, count(*) AS orphan_rows "
    f"FROM {child} WHERE {ck} IS NOT NULL AND {ck} NOT IN (SELECT {pk} FROM {parent})"
    for child, ck, parent, pk in (
        ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("orders", "o_custkey", "customer", "c_custkey"),
        ("lineitem", "l_partkey", "part", "p_partkey"), ("events", "user_id", "customer", "c_custkey"),
        ("customer", "c_custkey", "orders", "o_custkey"), ("documents", "doc_id", "labels", "doc_id")))

_UNIQUE = " UNION ALL ".join(
    f"SELECT '{table}({keys})' AS rule, count(*) AS violations FROM "
    f"(SELECT {keys} FROM {table} GROUP BY {keys} HAVING count(*) > 1)"
    for table, keys in (("nation", "n_name,n_regionkey"), ("supplier", "s_name,s_nationkey"),
                        ("part", "p_name,p_brand"), ("lineitem", "l_orderkey,l_linenumber"),
                        ("events", "event_id"), ("documents", "text")))

_VALUE = "CASE WHEN event_type NOT IN ('click', 'signup') THEN value END"

_TRIPS = """
SELECT l_linenumber AS vendor, l_shipdate AS pickup, CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS dropoff,
       l_quantity AS passengers, l_extendedprice AS price, l_suppkey AS rate, l_returnflag AS flag, l_orderkey AS pu,
       l_partkey AS dol, CASE WHEN l_linestatus <> 'O' THEN l_linenumber END AS payment, l_discount AS extra,
       l_tax AS tax FROM lineitem
"""

ORACLE = {
    "silver_trips": f"""
        SELECT CAST(vendor AS INTEGER) AS vendor_id, CAST(pickup AS TIMESTAMP) AS pickup_ts,
               CAST(dropoff AS TIMESTAMP) AS dropoff_ts, passengers AS passenger_count, price AS trip_distance,
               CAST(rate AS INTEGER) AS ratecodeid, flag AS store_and_fwd_flag, CAST(pu AS INTEGER) AS pulocationid,
               CAST(dol AS INTEGER) AS dolocationid, CAST(payment AS INTEGER) AS payment_type, price AS fare_amount,
               extra, tax AS mta_tax, CAST(0.5 AS DOUBLE) AS tip_amount, CAST(NULL AS DOUBLE) AS tolls_amount,
               CAST(1 AS DOUBLE) AS improvement_surcharge, price AS total_amount,
               CAST(2.5 AS DOUBLE) AS congestion_surcharge, CAST(pickup AS DATE) AS pickup_date, true AS stamped
        FROM ({_TRIPS})""",
    "stream_trips": f"""
        SELECT CAST(vendor AS INTEGER) AS "VendorID", CAST(pickup AS TIMESTAMP) AS tpep_pickup_datetime,
               CAST(dropoff AS TIMESTAMP) AS tpep_dropoff_datetime, CAST(trunc(passengers) AS INTEGER)
                 AS passenger_count, price AS trip_distance, CAST(rate AS INTEGER) AS "RatecodeID",
               flag AS store_and_fwd_flag, CAST(pu AS INTEGER) AS "PULocationID",
               CAST(dol AS INTEGER) AS "DOLocationID", CAST(payment AS INTEGER) AS payment_type, price AS fare_amount,
               extra, tax AS mta_tax, CAST(0.5 AS DOUBLE) AS tip_amount, CAST(NULL AS DOUBLE) AS tolls_amount,
               CAST(1 AS DOUBLE) AS improvement_surcharge, price AS total_amount,
               CAST(2.5 AS DOUBLE) AS congestion_surcharge, true AS stamped
        FROM ({_TRIPS})""",
    "late_landing": """
        SELECT 'supplier' AS table_name, s_suppkey AS id, s_name AS label FROM supplier
        UNION ALL SELECT 'part', p_partkey, p_name FROM part
        UNION ALL SELECT 'nowhere', count(*), 'no landing order' FROM supplier""",
    "catalog_listing": _listing(
        "SELECT '{table}' AS table_name, count(*) AS row_count, '{columns}' AS columns FROM {table}",
        ["customer", "events", "orders"]),
    "pages_of_lines": """
        SELECT * EXCLUDE (position), CAST(position // 500 + 1 AS INTEGER) AS page
        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
              FROM lineitem)
        WHERE position // 500 + 1 IN (1, 2, 3, 7, 41, 120, 333)""",
    "page_untidy": "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders",
    "csv_string_scan": """
        SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
               CAST(o_totalprice AS VARCHAR) AS o_totalprice,
               strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""",
    "landing_by_date": """
        SELECT *, CASE WHEN o_orderstatus = 'F' THEN '20240101' ELSE '20240102' END AS process_date FROM orders""",
    "bronze_load": """
        SELECT l_returnflag, count(*) AS row_count, CAST(sum(l_quantity) AS BIGINT) AS quantity
        FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem) GROUP BY l_returnflag""",
    "silver_events": """
        SELECT CAST(event_id AS INTEGER) AS event_id, ts AS event_ts, CAST(user_id AS INTEGER) AS user_id, event_type,
               value AS amount, props, CAST(ts AS DATE) AS event_date FROM events""",
    "silver_typed_lines": """
        SELECT CAST(l_orderkey AS INTEGER) AS order_id, CAST(l_partkey AS INTEGER) AS part_id,
               CAST(l_suppkey AS INTEGER) AS supplier_id, CAST(l_linenumber AS INTEGER) AS line,
               CAST(trunc(l_quantity) AS INTEGER) AS units, l_extendedprice AS price, l_discount AS discount,
               l_tax AS tax, l_returnflag AS flag, l_linestatus AS status, l_shipdate AS ship_ts,
               CAST(l_shipdate AS DATE) AS ship_date FROM lineitem""",
    "silver_stats": _STATS,
    "gold_copy": _STATS,
    "insert_rows": """
        SELECT 1993 AS year, CAST(100.5 AS DOUBLE) AS revenue UNION ALL SELECT 1994, 200.25
        UNION ALL SELECT 1994, 200.25
        UNION ALL SELECT CAST(year(o_orderdate) AS INTEGER),
                         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) FROM orders GROUP BY 1""",
    "sanitize_names": _NAMES,
    "temporal_coerce": """
        SELECT event_id, CASE WHEN event_type <> 'error' THEN date_trunc('second', ts) END AS event_datetime,
               CAST(date_trunc('day', ts) AS TIMESTAMP) AS event_date, value AS uptime FROM events""",
    "upload_csv": """
        SELECT event_id, date_trunc('second', ts) AS event_datetime, user_id AS col_2nd_user, event_type AS type,
               CASE WHEN event_type <> 'error' THEN value END AS value_usd, props,
               CAST(event_id % 40 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN 'D' ELSE 'f' END AS seat_code
        FROM events""",
    "upload_event": _listing(
        "SELECT 'csv_uploaded' AS event_type, '{table}' AS table_name, '{table}.csv' AS filename, "
        "count(*) AS rows_count, '{columns}' AS columns, '/api/data/{table}' AS api_endpoint FROM {table}",
        list(COLUMNS)),
    "event_landing": """
        SELECT 'orders' AS table_name, o_orderkey AS id, o_orderpriority AS label, o_totalprice AS amount FROM orders
        UNION ALL SELECT 'customer', c_custkey, c_name, c_acctbal FROM customer""",
    "table_listing": _listing(
        "SELECT '{table}' AS table_name, count(*) AS row_count, '{columns}' AS columns FROM {table}", list(COLUMNS)),
    "source_readiness": _listing(
        "SELECT '{table}' AS table_name, count(*) AS row_count, '{columns}' AS columns, "
        "'/api/data/{table}' AS api_endpoint FROM {table}", ["lineitem"]),
    "page_fetch": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200",
    "page_seek": """
        WITH keys AS (SELECT unnest([min(o_orderkey), (min(o_orderkey) + max(o_orderkey)) // 2, max(o_orderkey)]) AS k
                      FROM orders),
        numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
                            l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
                     FROM lineitem),
        wanted AS (SELECT k, (SELECT count(*) FROM lineitem WHERE l_orderkey < k) // 250 + 1 AS page FROM keys)
        SELECT page, l_orderkey, l_linenumber, l_partkey, l_suppkey
        FROM wanted JOIN numbered ON position // 250 + 1 = page""",
    "page_resume": "SELECT * FROM lineitem",
    "repeated_events": """
        SELECT c_custkey, c_acctbal, step FROM customer, (SELECT unnest([0, 1, 2]) AS step)
        WHERE step < 2 OR c_acctbal > 5000""",
    "ledger_listing": """
        SELECT 'rows of orders' AS fact, CAST(count(*) AS DOUBLE) AS amount FROM orders
        UNION ALL SELECT 'rows of supplier', count(*) FROM supplier
        UNION ALL SELECT 'price', CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) FROM orders
        UNION ALL SELECT o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority""",
    "page_meta": """
        SELECT 3 AS page, 100 AS page_size, count(*) AS total_records,
               CAST(ceil(count(*) / 100.0) AS INTEGER) AS total_pages, 3 < ceil(count(*) / 100.0) AS has_next,
               true AS has_previous FROM orders""",
    "page_numbers": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, position, position // 500 + 1 AS page
        FROM (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
                l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS position
              FROM lineitem)""",
    "page_explode": "SELECT * FROM orders",
    "page_completeness": """
        SELECT 'lineitem' AS table_name, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS pages_found,
               CAST(ceil(count(*) / 1000.0) AS INTEGER) AS pages_announced, count(*) AS rows_found,
               count(*) AS rows_announced, true AS complete FROM lineitem""",
    "total_check": """
        SELECT l_orderkey, l_linenumber, l_partkey, CAST(expected AS DOUBLE) AS expected_total,
               expected = round(CAST(l_extendedprice AS DECIMAL(18,6)), 2) AS total_matches
        FROM (SELECT *, round(CAST(l_extendedprice AS DECIMAL(18,6)) - CAST(l_discount AS DECIMAL(18,6))
                              + CAST(l_tax AS DECIMAL(18,6)), 2) AS expected FROM lineitem)""",
    "orphan_report": _ORPHANS,
    "unique_checks": _UNIQUE,
    "stream_copy": """
        SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, props, true AS stamped
        FROM events""",
    "stream_tolerant": f"""
        SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, {_VALUE} AS value, props
        FROM events WHERE event_type <> 'error'""",
    "stream_by_type": """
        SELECT event_id, user_id, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
        FROM events WHERE event_type = 'purchase'""",
    "not_null_drop": """
        SELECT event_id, date_trunc('second', ts) AS ts, user_id, event_type, value, props
        FROM events WHERE event_type IN ('view', 'purchase')""",
}
