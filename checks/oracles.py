"""SQL for DuckDB that gives the registered queries' results from the same tables."""

from __future__ import annotations

from checks.queries import (
    CUTOFF,
    EARLIER_CUTOFF,
    FRESH_AS_OF,
    GATE_MB,
    MIN_REVENUE,
    NO_CATEGORY,
    NO_SEGMENT,
    NO_STATE,
    RATE_AS_OF,
)

# The views, as common table expressions.
WITH = """
WITH fact0 AS (
    SELECT l_orderkey * 10 + l_linenumber AS order_id, l_orderkey AS order_ref,
           o_custkey AS customer_id, l_partkey AS product_id, o_orderdate AS "timestamp",
           CAST(l_quantity AS BIGINT) AS quantity,
           CAST(CAST(l_extendedprice AS DECIMAL(18,2))
                * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS total_amount,
           CAST(l_tax AS DECIMAL(4,2)) AS tax, o_orderstatus AS order_status
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), fact AS (
    SELECT order_id, order_ref, customer_id, product_id, "timestamp", quantity, total_amount,
           CAST(0 AS DECIMAL(18,4)) AS shipping_cost,
           CAST(total_amount * tax AS DECIMAL(18,4)) AS tax_amount, order_status
    FROM fact0
), cust AS (
    SELECT c_custkey AS customer_id, c_name AS name, n_name AS state, c_mktsegment AS segment
    FROM customer JOIN nation ON c_nationkey = n_nationkey
), prod AS (
    SELECT p_partkey AS product_id, p_name AS name, p_type AS category, p_brand AS brand,
           p_retailprice AS list_price
    FROM part
), pay AS (
    SELECT event_id AS payment_id, event_id AS order_id,
           'm' || (event_id % 4) AS payment_method,
           CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status,
           value AS processing_time, ts AS "timestamp"
    FROM events
), minutes AS (
    SELECT event_id AS order_id, ts AS "timestamp",
           CAST(value AS DECIMAL(18,4)) AS total_amount
    FROM events
), dirty AS (
    SELECT order_id, "timestamp",
           CASE WHEN order_id % 97 <> 0 THEN customer_id END AS customer_id,
           CASE WHEN order_id % 89 = 0 THEN -total_amount ELSE total_amount END AS total_amount
    FROM fact
), j AS (
    SELECT f.order_id, f.order_ref, f."timestamp", f.total_amount, f.quantity,
           f.shipping_cost, f.tax_amount,
           c.customer_id, c.name AS customer_name, c.state AS customer_state,
           c.segment AS customer_segment, 'Unknown' AS customer_city,
           p.product_id, p.name AS product_name, p.category AS product_category,
           p.brand AS product_brand
    FROM fact f JOIN cust c ON f.customer_id = c.customer_id
                JOIN prod p ON f.product_id = p.product_id
), full15 AS (
    SELECT j.order_id, j."timestamp", total_amount, quantity, shipping_cost, tax_amount,
           customer_id, customer_state AS state, customer_segment AS segment, product_id,
           product_name, product_category AS category, payment_method,
           status AS payment_status, processing_time
    FROM j JOIN pay ON j.order_ref = pay.order_id
), by_minute AS (
    SELECT strftime("timestamp", '%Y-%m-%dT%H:%M') AS minute,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(*) AS order_count
    FROM minutes GROUP BY 1 ORDER BY 1 DESC LIMIT 60
), hot AS (
    SELECT printf('ORD_%08d', order_id) AS order_id,
           printf('CUST_%06d', customer_id) AS customer_id,
           printf('PROD_%05d', product_id) AS product_id, "timestamp",
           CAST(quantity AS INTEGER) AS quantity, CAST(total_amount AS DOUBLE) AS total_amount,
           total_amount AS amount, order_status, product_id AS product_number
    FROM fact
), hot_size AS (
    SELECT count(*) AS rows,
           CAST(sum(209 + strlen(order_id) + strlen(customer_id) + strlen(product_id)
                    + strlen(order_status)) AS BIGINT) AS bytes
    FROM hot
), left_size AS (
    SELECT count(*) AS rows,
           CAST(sum(209 + strlen(order_id) + strlen(customer_id) + strlen(product_id)
                    + strlen(order_status)) AS BIGINT) AS bytes
    FROM hot WHERE "timestamp" >= TIMESTAMP '{cutoff}'
), event AS (
    SELECT printf('ORD_%08d', j.order_id) AS order_id, product_brand AS brand,
           strftime(j."timestamp", '%Y-%m-%dT%H:%M:%S') AS "timestamp",
           CAST(total_amount AS DOUBLE) AS total_amount, CAST(quantity AS INTEGER) AS quantity,
           CAST(2.99 AS DOUBLE) AS shipping_cost, CAST(tax_amount AS DOUBLE) AS tax_amount,
           printf('CUST_%06d', customer_id) AS customer_id, customer_state AS state,
           customer_segment AS segment, printf('PROD_%05d', product_id) AS product_id,
           product_name, product_category AS category,
           coalesce(payment_method, 'm0') AS payment_method,
           coalesce(status, 'success') AS payment_status,
           coalesce(processing_time, 0.0) AS processing_time
    FROM j LEFT JOIN pay ON j.order_ref = pay.order_id
)
""".replace("{cutoff}", CUTOFF)

SUMMARY = """
    SELECT count(*) AS total_orders,
           CAST(round(sum(total_amount), 2) AS DOUBLE) AS total_revenue,
           round(CAST(sum(total_amount) AS DOUBLE) / count(*), 2) AS avg_order_value,
           count(DISTINCT customer_id) AS unique_customers,
           count(DISTINCT product_id) AS unique_products
    FROM j
"""

FULL_EVENT = """
    SELECT order_id, "timestamp", total_amount, quantity, shipping_cost, tax_amount,
           customer_id, state, segment, product_id, product_name, category, payment_method,
           payment_status, processing_time
    FROM event
"""


def state_category(least: float, no_state: str, no_category: str) -> str:
    return f"""
    SELECT customer_state, product_category, count(*) AS order_count,
           count(DISTINCT customer_id) AS unique_customers,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
           CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value
    FROM j
    WHERE customer_state <> '{no_state}' AND product_category <> '{no_category}'
    GROUP BY customer_state, product_category
    HAVING sum(total_amount) > {least}
    ORDER BY sum(total_amount) DESC, customer_state, product_category
    LIMIT 30
    """


def top_products(keys: str, source: str) -> str:
    return f"""
    SELECT {keys}, CAST(sum(quantity) AS BIGINT) AS total_quantity,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(*) AS order_count
    FROM {source} GROUP BY {keys} ORDER BY total_quantity DESC, {keys} LIMIT 10
    """


def by_state(state: str, source: str, where: str, average: bool) -> str:
    mean = ", CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value" if average else ""
    return f"""
    SELECT {state} AS state, count(*) AS order_count,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue {mean}
    FROM {source} {where} GROUP BY {state} ORDER BY order_count DESC, {state} LIMIT 20
    """


CATEGORIES = """
    SELECT product_category AS category, count(*) AS order_count,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
           CAST(sum(quantity) AS BIGINT) AS total_quantity
    FROM j GROUP BY product_category
"""

SEGMENTS = """
    SELECT customer_segment AS segment, count(DISTINCT customer_id) AS unique_customers,
           count(*) AS total_orders, CAST(sum(total_amount) AS DOUBLE) AS total_revenue,
           CAST(sum(total_amount) AS DOUBLE) / count(*) AS avg_order_value
    FROM j GROUP BY customer_segment
"""

ORDER_MINUTES = """
    SELECT strftime("timestamp", '%Y-%m-%dT%H:%M') AS minute,
           CAST(sum(total_amount) AS DOUBLE) AS total_revenue, count(*) AS order_count
    FROM j GROUP BY 1 ORDER BY 1 DESC LIMIT 60
"""

PAYMENT_METRICS = """
    SELECT payment_method, {status} AS payment_status, count(*) AS count,
           CAST(sum(CAST(processing_time AS DECIMAL(28,12))) AS DOUBLE)
               / count(processing_time) AS avg_processing_time
    FROM {source} GROUP BY payment_method, {status}
"""

DEFAULT_STATE_CATEGORY = state_category(50, "Unknown", "Unknown")
STATES = by_state("customer_state", "j", "WHERE customer_state <> 'Unknown'", True)
PRODUCTS = top_products("product_name, product_category, product_brand", "j")


def published(name: str, sql: str) -> str:
    return f"""
    SELECT '{name}' AS name, count(*) AS row_count,
           CAST(sum(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) AS revenue_total
    FROM ({sql})
    """


def cold_categories(extra: str = "") -> str:
    return f"""
    SELECT p.category, CAST(sum(h.amount) AS DOUBLE) AS total_revenue, count(*) AS order_count
    FROM hot h JOIN prod p ON h.product_number = p.product_id
    WHERE h."timestamp" < TIMESTAMP '{CUTOFF}'
    GROUP BY p.category ORDER BY sum(h.amount) DESC, p.category {extra}
    """


ORDER_ROWS = 'SELECT order_id, customer_id, "timestamp", quantity, total_amount FROM hot'


def upsert(key_name: str, key: str, always: str, first: str, sometimes: str, second: str) -> str:
    """The latest change by batch and then by order."""
    return f"""
    , change AS (
        SELECT {key} AS k, order_id, (product_id % 3) * 1000000000000 + order_id AS seq FROM fact
    )
    SELECT k AS {key_name}, arg_max_null({first}, seq) AS {always},
           arg_max_null(CASE WHEN order_id % 9 <> 0 THEN {second} END, seq)
               FILTER (WHERE order_id % 3 = 0) AS {sometimes}
    FROM change GROUP BY k
    """


BROKEN_REASON = """
    CASE brand WHEN 'Brand#1' THEN 'no order'
               WHEN 'Brand#2' THEN 'no payment'
               WHEN 'Brand#3' THEN 'bad order'
               WHEN 'Brand#4' THEN 'order lacks a field'
               WHEN 'Brand#5' THEN 'no product_id'
               ELSE 'kept' END
"""

ORACLES: dict[str, str] = {
    "scan_orders": """
        SELECT order_id, order_ref, customer_id, product_id, "timestamp", quantity,
               CAST(total_amount AS DOUBLE) AS total_amount,
               CAST(shipping_cost AS DOUBLE) AS shipping_cost,
               CAST(tax_amount AS DOUBLE) AS tax_amount, order_status
        FROM fact
    """,
    "scan_customers": "SELECT customer_id, name, state, segment FROM cust",
    "scan_products": "SELECT product_id, name, category, brand, list_price FROM prod",
    "scan_payments": """
        SELECT payment_id, order_id, payment_method, status, processing_time, "timestamp"
        FROM pay
    """,
    "flatten_event": FULL_EVENT,
    "ingest_decode": FULL_EVENT,
    "dim_defaults": f"""
        SELECT customer_id, name AS customer_name,
               CASE WHEN state <> '{NO_STATE}' THEN state ELSE 'Unknown' END AS customer_state,
               CASE WHEN segment <> '{NO_SEGMENT}' THEN segment ELSE 'Regular' END
                   AS customer_segment,
               'Unknown' AS customer_city
        FROM cust
    """,
    "derive_order_measures": """
        , line AS (
            SELECT l_orderkey AS order_ref, l_linenumber AS line, l_partkey AS product_id,
                   CAST(l_quantity AS INTEGER) AS quantity,
                   greatest(least(CAST(1.1 AS DECIMAL(4,2)) - CAST(l_discount AS DECIMAL(4,2))
                       * CAST(6.12345678 AS DECIMAL(9,8)), 1.0), 0.7) AS factor,
                   CAST(l_tax AS DECIMAL(4,2)) * CAST(1.01234567 AS DECIMAL(9,8)) AS tax_rate,
                   CAST(l_discount AS DECIMAL(18,4)) AS extra,
                   CAST(list_price AS DECIMAL(18,4)) AS list_price
            FROM lineitem JOIN prod ON l_partkey = product_id
        ), priced AS (
            SELECT *, round(CAST(list_price * factor AS DECIMAL(36,16)), 2) AS unit_price
            FROM line
        ), totalled AS (
            SELECT *, CAST(unit_price * quantity AS DECIMAL(18,2)) AS total_amount FROM priced
        )
        SELECT order_ref, line, product_id, CAST(unit_price AS DOUBLE) AS unit_price,
               CAST(total_amount AS DOUBLE) AS total_amount,
               CAST(round(total_amount * tax_rate, 2) AS DOUBLE) AS tax_amount,
               CAST(round(extra + 2.99, 2) AS DOUBLE) AS shipping_cost
        FROM totalled
    """,
    "order_text": """
        SELECT '{"order_id":"' || order_id || '","customer_id":"' || customer_id
               || '","product_id":"' || product_id || '","quantity":' || quantity
               || ',"order_status":"' || order_status || '"}' AS value
        FROM hot
    """,
    "iso_times": f"""
        SELECT order_id, strftime("timestamp", '%Y-%m-%dT%H:%M') AS minute,
               strftime("timestamp", '%Y-%m-%dT%H:%M:%S') AS shown,
               (epoch_us(TIMESTAMP '{FRESH_AS_OF}') - epoch_us("timestamp")) / 60e6
                   AS age_minutes
        FROM minutes
    """,
    "join_orders_customers": """
        SELECT order_id, c.customer_id, c.name AS customer_name, c.state AS customer_state
        FROM fact f JOIN cust c ON f.customer_id = c.customer_id
    """,
    "join_orders_products": """
        SELECT order_id, p.product_id, p.name AS product_name, p.brand AS product_brand
        FROM fact f JOIN prod p ON f.product_id = p.product_id
    """,
    "orders_joined": """
        SELECT order_id, "timestamp", CAST(total_amount AS DOUBLE) AS total_amount, quantity,
               customer_id, customer_name, customer_state, customer_segment, customer_city,
               product_id, product_name, product_category, product_brand
        FROM j
    """,
    "orders_full15": """
        SELECT * REPLACE (CAST(total_amount AS DOUBLE) AS total_amount,
                          CAST(shipping_cost AS DOUBLE) AS shipping_cost,
                          CAST(tax_amount AS DOUBLE) AS tax_amount)
        FROM full15
    """,
    "joined_view_sql": """
        SELECT customer_segment, product_category, count(*) AS order_count,
               count(DISTINCT customer_id) AS unique_customers
        FROM j GROUP BY customer_segment, product_category HAVING sum(total_amount) > 50
    """,
    "join_coverage": f"""
        SELECT count(*) AS loaded_orders,
               count(*) FILTER (WHERE customer_state <> '{NO_STATE}'
                                AND product_category <> '{NO_CATEGORY}') AS joined_orders,
               count(*) FILTER (WHERE customer_state = '{NO_STATE}') AS without_customer,
               count(*) FILTER (WHERE product_category = '{NO_CATEGORY}') AS without_product
        FROM j
    """,
    "kpi_summary": SUMMARY,
    "refresh_results": SUMMARY,
    "kpi_summary_orders": """
        SELECT count(*) AS total_orders,
               CAST(round(sum(total_amount), 2) AS DOUBLE) AS total_revenue,
               round(CAST(sum(total_amount) AS DOUBLE) / count(*), 2) AS avg_order_value
        FROM fact
    """,
    "revenue_state_category": state_category(MIN_REVENUE, NO_STATE, NO_CATEGORY),
    "stream_publish_kpis": DEFAULT_STATE_CATEGORY,
    "top_products": PRODUCTS,
    "top_products_by_name": top_products("product_name, category", "full15"),
    "orders_by_state": by_state(
        "customer_state", "j", f"WHERE customer_state <> '{NO_STATE}'", True
    ),
    "orders_by_state_all": by_state("state", "full15", "", False),
    "category_performance": CATEGORIES,
    "read_published": CATEGORIES,
    "segment_analysis": SEGMENTS,
    "payment_metrics": PAYMENT_METRICS.format(status="payment_status", source="full15"),
    "payment_success_rate": """
        , counts AS (
            SELECT count(*) AS total_payments,
                   count(*) FILTER (WHERE status = 'success') AS success_payments
            FROM pay
        )
        SELECT *, round(success_payments * 100.0 / total_payments, 2) AS payment_success_rate,
               round(success_payments * 100.0 / total_payments, 2) >= 95 AS target_met
        FROM counts
    """,
    "aov_vs_base": f"""
        SELECT avg_order_value, (avg_order_value - 100) / 100 * 100 AS percent_above_base
        FROM ({SUMMARY})
    """,
    "orders_by_peak_hour": """
        SELECT hour("timestamp") IN (10, 11, 12, 18, 19, 20) AS is_peak,
               count(*) AS order_count, CAST(sum(total_amount) AS DOUBLE) AS total_revenue
        FROM minutes GROUP BY 1
    """,
    "revenue_by_minute": "SELECT * FROM by_minute",
    "latest_minutes": "SELECT * FROM by_minute",
    "stream_revenue_by_minute": "SELECT * FROM by_minute",
    "revenue_velocity": """
        , pair AS (
            SELECT minute, total_revenue, lag(total_revenue) OVER (ORDER BY minute) AS previous
            FROM by_minute
        )
        SELECT minute, total_revenue AS latest_revenue, previous AS previous_revenue,
               CASE WHEN previous > 0 THEN (total_revenue - previous) / previous * 100
                    WHEN previous <= 0 THEN 0 END AS velocity_pct
        FROM pair ORDER BY minute DESC LIMIT 1
    """,
    "orders_per_minute_latest": """
        SELECT minute, order_count AS orders_per_minute FROM by_minute
        ORDER BY minute DESC LIMIT 1
    """,
    "avg_revenue_10min": """
        SELECT count(*) AS minutes,
               CAST(sum(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*)
                   AS avg_revenue
        FROM (SELECT * FROM by_minute ORDER BY minute DESC LIMIT 10)
    """,
    "revenue_last_30": "SELECT * FROM by_minute ORDER BY minute DESC LIMIT 30",
    "dq_duplicates": """
        SELECT count(*) AS duplicate_count
        FROM (SELECT order_id FROM fact GROUP BY order_id HAVING count(*) > 1)
    """,
    "dq_nulls": """
        SELECT count(*) FILTER (WHERE order_id IS NULL) AS null_orders,
               count(*) FILTER (WHERE customer_id IS NULL) AS null_customers
        FROM dirty
    """,
    "dq_invalid_amounts": """
        SELECT count(*) FILTER (WHERE total_amount <= 0) AS invalid_amounts FROM dirty
    """,
    "dq_freshness": f"""
        , age AS (
            SELECT max("timestamp") AS latest_order,
                   (epoch_us(TIMESTAMP '{FRESH_AS_OF}') - epoch_us(max("timestamp"))) / 60e6
                       AS age_minutes
            FROM minutes
        )
        SELECT *, age_minutes > 5 AS is_stale FROM age
    """,
    "dq_volume": "SELECT count(*) AS total_orders FROM fact",
    "dq_report": f"""
        , found AS (
            SELECT (SELECT count(*) FROM (SELECT order_id FROM dirty GROUP BY order_id
                                          HAVING count(*) > 1)) AS duplicate_count,
                   count(*) FILTER (WHERE order_id IS NULL) AS null_orders,
                   count(*) FILTER (WHERE customer_id IS NULL) AS null_customers,
                   count(*) FILTER (WHERE total_amount <= 0) AS invalid_amounts,
                   count(*) AS total_orders,
                   max("timestamp") < TIMESTAMP '{FRESH_AS_OF}' - INTERVAL 5 MINUTE AS stale
            FROM dirty
        )
        SELECT duplicate_count, null_orders, null_customers, invalid_amounts, total_orders,
               CAST(duplicate_count > 0 AS INTEGER) + CAST(null_orders > 0 AS INTEGER)
                   + CAST(null_customers > 0 AS INTEGER)
                   + CAST(invalid_amounts > 0 AS INTEGER) + CAST(stale AS INTEGER)
                   AS issues_count,
               TIMESTAMP '{FRESH_AS_OF}' AS last_check
        FROM found
    """,
    "flow_between_snapshots": f"""
        , counts AS (
            SELECT count(*) FILTER (WHERE "timestamp" < TIMESTAMP '{CUTOFF}') AS initial_count,
                   count(*) AS new_count
            FROM fact
        )
        SELECT *, new_count - initial_count AS new_orders,
               initial_count > 0 AND new_count > initial_count AS is_flowing
        FROM counts
    """,
    "recent_order_rate": f"""
        SELECT count(*) AS recent_orders, count(*) < 5 AS is_low FROM minutes
        WHERE "timestamp" >= TIMESTAMP '{RATE_AS_OF}' - INTERVAL 2 MINUTE
    """,
    "hot_size_band": f"""
        SELECT rows, bytes, round(bytes / 1048576.0, 2) AS size_mb,
               CASE WHEN bytes / 1048576.0 > {GATE_MB} THEN 'archive'
                    WHEN bytes / 1048576.0 > {GATE_MB / 2} THEN 'near' ELSE 'ok' END AS band,
               CAST(bytes AS DOUBLE) / 1048576.0 * 1024 / rows AS kb_per_row
        FROM hot_size
    """,
    "archive_gate": f"""
        SELECT rows, bytes, bytes / 1048576.0 >= {GATE_MB} AS needs_archiving FROM hot_size
    """,
    "storage_stats": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, CAST(1 AS BIGINT) AS file_count,"
        f" true AS has_size FROM {name}"
        for name in ("lineitem", "orders", "customer", "part", "nation", "events")
    ),
    "archive_candidates": f"""{ORDER_ROWS} WHERE "timestamp" < TIMESTAMP '{CUTOFF}'""",
    "archive_remainder": f"""{ORDER_ROWS} WHERE "timestamp" >= TIMESTAMP '{CUTOFF}'""",
    "archive_write": f"""
        SELECT CASE WHEN "timestamp" < TIMESTAMP '{EARLIER_CUTOFF}' THEN 'archive_1'
                    ELSE 'archive_2' END AS archive_id, order_id, total_amount
        FROM hot WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "archive_manifest": f"""
        SELECT 'archive_1' AS archive_id, 'hot_store' AS source,
               TIMESTAMP '{CUTOFF}' AS threshold_date, count(*) AS record_count,
               'parquet' AS format
        FROM hot WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "archive_ids": """
        SELECT order_id, 'archive_' || CAST(CAST(epoch("timestamp") AS BIGINT) AS VARCHAR)
                   AS archive_id
        FROM hot
    """,
    "archive_count": f"""
        SELECT count(DISTINCT "timestamp" < TIMESTAMP '{EARLIER_CUTOFF}') AS total_archives,
               count(DISTINCT "timestamp" < TIMESTAMP '{EARLIER_CUTOFF}')
                   FILTER (WHERE "timestamp" < TIMESTAMP '{EARLIER_CUTOFF}') AS after_first_run
        FROM hot WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "archive_catalog": f"""
        SELECT count(*) AS total_orders, CAST(round(sum(amount), 2) AS DOUBLE) AS total_revenue,
               round(CAST(sum(amount) AS DOUBLE) / count(*), 2) AS avg_order_value
        FROM hot WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "archive_report": """
        SELECT h.rows - l.rows AS archived_orders, l.rows AS remaining_orders,
               CAST(h.bytes AS DOUBLE) / 1048576 AS size_before_mb,
               CAST(l.bytes AS DOUBLE) / 1048576 AS size_after_mb,
               CAST(h.bytes AS DOUBLE) / 1048576 - CAST(l.bytes AS DOUBLE) / 1048576 AS saved_mb
        FROM hot_size h, left_size l
    """,
    "archive_inventory": f"""
        SELECT CAST(2 AS BIGINT) AS total_archives,
               count(*) + count(*) FILTER (WHERE "timestamp" < TIMESTAMP '{EARLIER_CUTOFF}')
                   AS total_records,
               true AS has_size
        FROM hot WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "cold_total": f"""
        SELECT count(*) AS total_archived_orders FROM hot
        WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "cold_total_sql": f"""
        SELECT count(*) AS total_archived_orders FROM hot
        WHERE "timestamp" < TIMESTAMP '{CUTOFF}'
    """,
    "cold_category_df": cold_categories(),
    "cold_category_flat": cold_categories(),
    "cold_category_sql": cold_categories("LIMIT 5"),
    "publish_kpis": " UNION ALL ".join(
        [
            published("summary", SUMMARY),
            published("state_category", DEFAULT_STATE_CATEGORY),
            published("top_products", PRODUCTS),
            published("orders_by_state", STATES),
            published("category_performance", CATEGORIES),
            published("revenue_by_minute", ORDER_MINUTES),
            published("segment_analysis", SEGMENTS),
            "SELECT 'payment_metrics' AS name, count(*) AS row_count, NULL AS revenue_total"
            f" FROM ({PAYMENT_METRICS.format(status='status', source='pay')})",
        ]
    ),
    "refresh_guard": """
        SELECT 'all' AS orders, count(*) > 0 AS published, count(*) AS total_orders FROM j
        UNION ALL
        SELECT 'none', count(*) > 0, count(*) FROM j WHERE "timestamp" < TIMESTAMP '1900-01-01'
    """,
    "last_updated": f"""
        SELECT *, TIMESTAMP '{FRESH_AS_OF}' AS last_updated FROM ({CATEGORIES})
    """,
    "published_figures": f"""
        , ranked AS (
            SELECT *, row_number() OVER (ORDER BY minute DESC) AS place FROM ({ORDER_MINUTES})
        )
        SELECT 'orders_per_minute' AS figure, CAST(order_count AS DOUBLE) AS value
        FROM ranked WHERE place = 1
        UNION ALL SELECT 'latest_revenue', total_revenue FROM ranked WHERE place = 1
        UNION ALL SELECT 'shown_minutes', CAST(count(*) AS DOUBLE) FROM ranked WHERE place <= 30
        UNION ALL
        SELECT 'avg_revenue',
               CAST(sum(CAST(total_revenue AS DECIMAL(28,4))) AS DOUBLE) / count(*)
        FROM ranked WHERE place <= 10
        UNION ALL
        SELECT 'percent_above_base', (avg_order_value - 100) / 100 * 100 FROM ({SUMMARY})
    """,
    "published_count": "SELECT CAST(8 AS BIGINT) AS result_sets",
    "published_or_compute": f"""
        SELECT s.*, c.from_cache
        FROM ({SUMMARY}) s, (SELECT true AS from_cache UNION ALL SELECT false) c
    """,
    "state_category_head": f"""
        SELECT customer_state || ' - ' || product_category AS state_category, total_revenue
        FROM ({DEFAULT_STATE_CATEGORY})
        ORDER BY total_revenue DESC, customer_state, product_category LIMIT 15
    """,
    "ingest_dead_letter": f"""
        SELECT {BROKEN_REASON} AS reason, count(*) AS events FROM event GROUP BY 1
    """,
    "stream_replay": ORDER_ROWS,
    "stream_ingest_orders": """
        SELECT h.order_id, h.customer_id, h.product_id, h."timestamp", h.quantity,
               list_price AS unit_price, h.total_amount, CAST(2.99 AS DOUBLE) AS shipping_cost,
               CAST(f.tax_amount AS DOUBLE) AS tax_amount, f.order_status
        FROM (SELECT *, printf('ORD_%08d', order_id) AS text_id FROM fact) f
        JOIN prod p ON f.product_id = p.product_id
        JOIN LATERAL (
            SELECT f.text_id AS order_id, printf('CUST_%06d', f.customer_id) AS customer_id,
                   printf('PROD_%05d', f.product_id) AS product_id, f."timestamp",
                   CAST(f.quantity AS INTEGER) AS quantity,
                   CAST(f.total_amount AS DOUBLE) AS total_amount
        ) h ON true
    """,
    "stream_ingest_customers": """
        SELECT printf('CUST_%06d', customer_id) AS customer_id, name,
               lower(name) || '@example.org' AS email, 'Springfield' AS city, state,
               'USA' AS country, DATE '2023-01-01' AS registration_date, segment
        FROM cust WHERE customer_id IN (SELECT customer_id FROM j)
    """,
    "upsert_customers": upsert(
        "customer_id",
        "printf('CUST_%06d', customer_id)",
        "name",
        "'name ' || order_id",
        "state",
        "'state ' || order_id",
    ),
    "upsert_products": upsert(
        "product_id",
        "printf('PROD_%05d', product_id)",
        "name",
        "'name ' || order_id",
        "list_price",
        "CAST(order_id AS DOUBLE)",
    ),
    "upsert_payments": upsert(
        "payment_id",
        "printf('PAY_%08d', order_ref)",
        "payment_method",
        "'m' || (order_id % 4)",
        "status",
        "'status ' || order_id",
    ),
}

ORACLES = {name: WITH + sql for name, sql in ORACLES.items()}
