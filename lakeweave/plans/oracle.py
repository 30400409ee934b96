"""DuckDB-side oracle SQL: the fixture derivations of FIXTURES.md §2 written
once more, independently, as common table expressions. ``with_ctes`` prefixes
a query body with exactly the CTEs it needs (dependencies first)."""

from __future__ import annotations

import re

RUN_TS_SQL = "TIMESTAMP '2024-02-01 00:00:00'"


def zpad(expr: str, n: int) -> str:
    s = f"CAST({expr} AS VARCHAR)"
    return f"(CASE WHEN length({s}) >= {n} THEN {s} ELSE lpad({s}, {n}, '0') END)"


def uuid(expr: str) -> str:
    h = f"md5({expr})"
    return (f"(substr({h},1,8) || '-' || substr({h},9,4) || '-' || substr({h},13,4) || '-' || "
            f"substr({h},17,4) || '-' || substr({h},21,12))")


def _tenant(n: str) -> str:
    return f"(CASE WHEN ({n}) % 3 = 0 THEN 'tenant_a' WHEN ({n}) % 3 = 1 THEN 'tenant_b' ELSE 'tenant_c' END)"


_M = "lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0')"
_D = "lpad(CAST(c_custkey % 28 + 1 AS VARCHAR), 2, '0')"
_STATUS = "(CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'O' THEN 'processing' WHEN 'F' THEN 'completed' END)"
_OWNER = _tenant("user_id + CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END")
_TBL = (f"(CASE event_type WHEN 'signup' THEN {_OWNER} || '.marts.customers' "
        f"WHEN 'purchase' THEN {_OWNER} || '.marts.orders' WHEN 'click' THEN {_OWNER} || '.staging.events' "
        f"WHEN 'view' THEN {_OWNER} || '.marts.products' ELSE {_OWNER} || '.raw.customers' END)")
_SQLTEXT = (f"('SELECT * FROM ' || {_TBL} || ' WHERE email = ''user' || CAST(user_id AS VARCHAR) "
            f"|| '@example.com'' AND k = ' || json_extract_string(props, '$.k'))")

CTES: dict[str, str] = {
    "nation_names": """
        SELECT n_nationkey, n_name, r_name FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
    "raw_customers": f"""
        SELECT 'CUST-' || {zpad('c_custkey', 6)} AS customer_id,
               CASE WHEN c_custkey % 60 = 0 THEN NULL
                    ELSE ' User' || CAST(c_custkey AS VARCHAR) || '@Example' || CAST(c_custkey % 5 + 1 AS VARCHAR) || '.com ' END AS email,
               ' ' || c_name AS first_name,
               c_mktsegment || ' ' AS last_name,
               lower(n_name) AS country,
               CASE WHEN c_custkey % 50 = 0 THEN 'n/a' ELSE '2020-' || {_M} || '-' || {_D} || ' 10:00:00' END AS created_at,
               CASE WHEN c_custkey % 50 = 25 THEN 'unknown' ELSE '2023-' || {_M} || '-15 08:30:00' END AS updated_at,
               {RUN_TS_SQL} AS _ingested_at
        FROM customer LEFT JOIN nation_names ON c_nationkey = n_nationkey""",
    "raw_orders": f"""
        SELECT o_orderkey AS order_id,
               'CUST-' || {zpad('o_custkey', 6)} AS customer_id,
               CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS order_date,
               CASE WHEN o_orderkey % 14 = 0 THEN upper({_STATUS})
                    WHEN o_orderkey % 14 = 7 THEN '  ' || {_STATUS} || ' ' ELSE {_STATUS} END AS status,
               o_totalprice AS total_amount,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 5 THEN ' eur ' ELSE 'usd' END AS currency,
               CAST(o_orderdate + INTERVAL 2 DAY AS VARCHAR) AS updated_at,
               o_orderdate + INTERVAL 1 DAY AS _ingested_at
        FROM orders""",
    "raw_products": f"""
        SELECT p_partkey AS product_id, p_name AS name, p_type AS category,
               CASE WHEN p_partkey % 40 = 0 THEN NULL WHEN p_partkey % 40 = 20 THEN -p_retailprice ELSE p_retailprice END AS price,
               CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE ' usd' END AS currency,
               CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 11 = 1 THEN ' Discontinued' ELSE 'ACTIVE' END AS status,
               {RUN_TS_SQL} AS _ingested_at
        FROM part""",
    "stg_customers": """
        SELECT trim(CAST(customer_id AS VARCHAR)) AS customer_id, lower(trim(email)) AS email,
               trim(first_name) AS first_name, trim(last_name) AS last_name,
               trim(first_name) || ' ' || trim(last_name) AS full_name, upper(trim(country)) AS country,
               TRY_CAST(created_at AS TIMESTAMP) AS created_at, TRY_CAST(updated_at AS TIMESTAMP) AS updated_at,
               _ingested_at
        FROM raw_customers WHERE customer_id IS NOT NULL AND email IS NOT NULL""",
    "stg_orders": """
        SELECT CAST(r.order_id AS VARCHAR) AS order_id, CAST(r.customer_id AS VARCHAR) AS customer_id,
               TRY_CAST(r.order_date AS DATE) AS order_date, lower(trim(r.status)) AS status,
               CAST(r.total_amount AS DOUBLE) AS total_amount_usd,
               upper(coalesce(trim(r.currency), 'USD')) AS currency,
               CAST(r.status AS VARCHAR) = 'completed' AS is_completed,
               TRY_CAST(r.updated_at AS TIMESTAMP) AS updated_at, r._ingested_at
        FROM raw_orders r WHERE r.order_id IS NOT NULL AND r.customer_id IS NOT NULL AND r.order_date IS NOT NULL""",
    "stg_products": """
        SELECT CAST(product_id AS VARCHAR) AS product_id, trim(name) AS name, trim(category) AS category,
               CAST(price AS DOUBLE) AS price, coalesce(trim(currency), 'USD') AS currency,
               lower(coalesce(trim(status), 'active')) AS status, _ingested_at
        FROM raw_products WHERE product_id IS NOT NULL AND name IS NOT NULL AND price IS NOT NULL AND price > 0""",
    "dim_customers": f"""
        SELECT md5(coalesce(CAST(customer_id AS VARCHAR), '_null_')) AS customer_key, customer_id, email,
               first_name, last_name, full_name, country, created_at, updated_at, {RUN_TS_SQL} AS _dbt_updated_at
        FROM stg_customers""",
    "fct_orders": """
        SELECT o.order_id, d.customer_key, o.customer_id, o.order_date, o.status, o.total_amount_usd, o.currency,
               o.is_completed, d.country, d.full_name AS customer_name, o.updated_at, o._ingested_at
        FROM stg_orders o LEFT JOIN dim_customers d ON o.customer_id = d.customer_id""",
    "order_items": """
        SELECT l_orderkey * 1000 + l_linenumber AS item_id, l_orderkey AS order_id, l_partkey AS product_id,
               l_linenumber AS line_number, l_quantity AS quantity, l_extendedprice / l_quantity AS unit_price,
               l_discount * 100 AS discount_pct, l_extendedprice * (1 - l_discount) AS total_price,
               l_shipdate AS updated_at
        FROM lineitem""",
    "raw_events": f"""
        SELECT {uuid('CAST(event_id AS VARCHAR)')} AS event_id, ts AS event_timestamp,
               CASE event_type WHEN 'signup' THEN 'crm' WHEN 'purchase' THEN 'pos' WHEN 'click' THEN 'web'
                    WHEN 'view' THEN 'mobile' ELSE 'partner_api' END AS source_system,
               ts + INTERVAL 1 MINUTE AS ingestion_timestamp, props AS payload
        FROM events""",
    "audit_queries": f"""
        SELECT {uuid("'q' || CAST(event_id AS VARCHAR)")} AS event_id, ts AS "timestamp",
               'sub-' || {zpad('user_id', 4)} AS user_sub, 'user' || CAST(user_id AS VARCHAR) AS username,
               {_tenant('user_id')} AS tenant_id, 'q_' || CAST(event_id AS VARCHAR) AS query_id,
               sha256({_SQLTEXT}) AS sql_text_hash, {_SQLTEXT} AS sql_text,
               CASE WHEN event_type = 'purchase' THEN [{_TBL}, {_OWNER} || '.marts.customers'] ELSE [{_TBL}] END AS tables_accessed,
               CAST(floor(value * 1000) AS BIGINT) AS rows_scanned, CAST(floor(value * 10) AS BIGINT) AS rows_returned,
               CAST(floor(value * 100) AS BIGINT) AS duration_ms,
               CASE WHEN event_type = 'error' THEN 'DENY' ELSE 'ALLOW' END AS ranger_decision,
               'cluster-' || CAST(event_id % 2 AS VARCHAR) AS "cluster",
               '10.0.' || CAST(user_id % 256 AS VARCHAR) || '.' || CAST(event_id % 250 + 1 AS VARCHAR) AS source_ip,
               event_type
        FROM events""",
    "metric_samples": """
        SELECT ts, event_type AS job, 'inst-' || CAST(user_id % 4 AS VARCHAR) AS instance,
               event_type = 'error' AS failed, value AS latency_s, event_id, user_id
        FROM events""",
    "order_changes": """
        SELECT order_id, m AS version,
               make_timestamp(CAST(1995 + floor((m - 1) / 12) AS BIGINT), CAST((m - 1) % 12 + 1 AS BIGINT), 28, 12, 0, 0) AS committed_at,
               op, customer_id, status, amount
        FROM (
          SELECT o_orderkey AS order_id, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS m, 'I' AS op,
                 o_custkey AS customer_id, o_orderstatus AS status, o_totalprice AS amount FROM orders
          UNION ALL
          SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 1, 'U', o_custkey, 'F', o_totalprice + 1
          FROM orders WHERE o_orderkey % 5 = 0
          UNION ALL
          SELECT o_orderkey, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) + 2, 'D', o_custkey, NULL, NULL
          FROM orders WHERE o_orderkey % 13 = 0)""",
}

_DEPS_CACHE: dict[str, list[str]] = {}


def _deps(name: str) -> list[str]:
    if name not in _DEPS_CACHE:
        body = CTES[name]
        _DEPS_CACHE[name] = [d for d in CTES if d != name and re.search(rf"\b{d}\b", body)]
    return _DEPS_CACHE[name]


def with_ctes(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it references (transitively)."""
    pool = dict(CTES)
    pool.update(extra or {})
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in [d for d in pool if d != n and re.search(rf"\b{d}\b", pool[n])]:
            visit(d)
        order.append(n)

    for n in pool:
        if re.search(rf"\b{n}\b", body):
            visit(n)
    if not order:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({pool[n]})" for n in order)
    m = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, flags=re.IGNORECASE)
    if m:  # the body brings its own CTEs: append them after ours
        return (head.replace("WITH ", "WITH RECURSIVE ", 1) if m[1] else head) + ",\n" + body[m.end():]
    return head + "\n" + body


def bucket(ts: str, seconds: int) -> str:
    return f"(epoch_us({ts}) // {seconds * 1_000_000})"


def bucket_start(b: str, seconds: int) -> str:
    return f"make_timestamp(({b}) * {seconds * 1_000_000})"


_LEVEL = "(CASE WHEN event_type = 'error' THEN 'ERROR' WHEN value > 40 THEN 'WARN' ELSE 'INFO' END)"
_SERVICE = ("(CASE WHEN event_type IN ('click', 'view') THEN 'trino' WHEN event_type = 'purchase' THEN 'airflow' "
            "WHEN event_type = 'signup' THEN 'keycloak' ELSE 'ranger-admin' END)")
CTES["log_lines"] = f"""
    SELECT event_id AS line_id, {_SERVICE} AS service,
           CASE WHEN event_id % 97 = 0 THEN '   '
                WHEN event_id % 89 = 0 THEN 'GET /metrics/prometheus 200 ' || CAST(event_id AS VARCHAR)
                WHEN {_SERVICE} = 'ranger-admin' THEN strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' ' || {_LEVEL}
                     || ' [worker-' || CAST(user_id % 8 AS VARCHAR) || '] io.lake.' || event_type || ' - event ' || CAST(event_id AS VARCHAR)
                ELSE '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || '","level":"' || {_LEVEL}
                     || '","logger":"io.lake.' || event_type || '","message":"query ' || CAST(event_id AS VARCHAR) || ' took '
                     || CAST(value AS VARCHAR) || '","event_type":"' || event_type || '","user_id":' || CAST(user_id AS VARCHAR) || '}}'
           END AS body
    FROM events"""
