"""Derived input tables, written once as projections and rendered for Spark and for the SQL oracle.

Placeholders: ``{STR}`` string type, ``{SHA:x}`` sha-256 hex of x, ``{DATE:fmt:x}`` formatted timestamp
(fmt is one of Y, M, D, ISO, YMD), ``{Q}`` a quote inside a string literal.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SPARK_FMT = {"Y": "yyyy", "M": "MM", "D": "dd", "YMD": "yyyy-MM-dd", "ISO": "yyyy-MM-dd\\'T\\'HH:mm:ss\\'Z\\'"}
_DUCK_FMT = {"Y": "%Y", "M": "%m", "D": "%d", "YMD": "%Y-%m-%d", "ISO": "%Y-%m-%dT%H:%M:%SZ"}


def _spark(expr: str) -> str:
    out = expr.replace("{STR}", "STRING").replace("{Q}", "\\'")
    out = re.sub(r"\{SHA:([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", r"sha2(\1, 256)", out)
    return re.sub(r"\{DATE:(\w+):(\w+)\}", lambda m: f"date_format({m[2]}, '{_SPARK_FMT[m[1]]}')", out)


def _duck(expr: str) -> str:
    out = expr.replace("{STR}", "VARCHAR").replace("{Q}", "''")
    out = re.sub(r"\{SHA:([^{}]*(?:\{[^{}]*\}[^{}]*)*)\}", r"sha256(\1)", out)
    return re.sub(r"\{DATE:(\w+):(\w+)\}", lambda m: f"strftime({m[2]}, '{_DUCK_FMT[m[1]]}')", out)


# name -> list of (FROM tables with equi-join conditions, [(column, expression), ...]); several entries are unioned
_T: dict[str, list[tuple[str, list[tuple[str, str]]]]] = {}

_T["session_logs"] = [("events", [
    ("session_id", "CAST(event_id AS {STR})"),
    ("family_id_hash", "substring({SHA:CAST(user_id AS {STR})}, 1, 16)"),
    ("child_id_hash", "substring({SHA:concat(CAST(user_id AS {STR}), '_', CAST(event_id % 3 AS {STR}))}, 1, 16)"),
    ("language", "CASE user_id % 5 WHEN 0 THEN 'en-GB' WHEN 1 THEN 'en-US' WHEN 2 THEN 'es-ES' WHEN 3 THEN 'fr-FR' ELSE 'de-DE' END"),
    ("region", "CASE user_id % 4 WHEN 0 THEN 'eu-west-1' WHEN 1 THEN 'eu-west-2' WHEN 2 THEN 'us-east-1' ELSE 'sa-east-1' END"),
    ("source", "CASE event_id % 4 WHEN 0 THEN 'mobile_app' WHEN 1 THEN 'web_app' WHEN 2 THEN 'alexa_skill' ELSE 'google_assistant' END"),
    ("stage", "'prod'"),
    ("timestamp", "{DATE:ISO:ts}"),
    ("duration_seconds", "CAST(5 + event_id % 296 AS INT)"),
    ("latency_ms", "CAST(CASE WHEN event_id % 50 = 0 THEN 0 ELSE 200 + (event_id * 37) % 1800 END AS INT)"),
    ("cost_usd", "CAST(CAST(value AS DECIMAL(18,6)) * CAST(0.001 AS DECIMAL(6,3)) AS DECIMAL(18,6))"),
    ("success", "event_type <> 'error'"),
    ("error_code", "CASE WHEN event_type <> 'error' THEN '' ELSE CASE event_id % 4 WHEN 0 THEN 'TIMEOUT' WHEN 1 THEN 'RATE_LIMIT' WHEN 2 THEN 'CONTENT_FILTER' ELSE 'MODEL_ERROR' END END"),
    ("model_provider", "CASE WHEN event_id % 20 = 0 THEN 'provider_b' ELSE 'provider_a' END"),
    ("model_name", "CASE WHEN event_id % 20 = 0 THEN 'model-mini' WHEN event_id % 10 = 1 THEN 'model-large' WHEN event_id % 4 = 2 THEN 'model-medium' ELSE 'model-small' END"),
    ("input_tokens", "CAST(50 + (event_id * 13) % 1450 AS INT)"),
    ("output_tokens", "CAST(30 + (event_id * 7) % 770 AS INT)"),
    ("year", "{DATE:Y:ts}"), ("month", "{DATE:M:ts}"), ("day", "{DATE:D:ts}"),
])]

_T["customers_pii"] = [("customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey", [
    ("id", "c_custkey"), ("name", "c_name"),
    ("email", "CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE concat(lower(replace(c_name, '#', '.')), '@', lower(c_mktsegment), '.example.com') END"),
    ("phone", "concat('+1-555-', lpad(CAST(c_custkey % 1000 AS {STR}), 3, '0'), '-', lpad(CAST(c_custkey % 10000 AS {STR}), 4, '0'))"),
    ("ssn", "concat(lpad(CAST(c_custkey % 1000 AS {STR}), 3, '0'), '-', lpad(CAST(c_custkey % 100 AS {STR}), 2, '0'), '-', lpad(CAST(c_custkey % 10000 AS {STR}), 4, '0'))"),
    ("card_number", "concat('4111-1111-', lpad(CAST(c_custkey % 10000 AS {STR}), 4, '0'), '-1111')"),
    ("api_key", "CASE WHEN c_custkey % 5 = 0 THEN 'k1' ELSE concat('key-', CAST(c_custkey AS {STR})) END"),
    ("address", "concat(CAST(1 + c_custkey % 999 AS {STR}), CASE c_custkey % 3 WHEN 0 THEN ' Main St' WHEN 1 THEN ' Oak Ave' ELSE ' River Road' END, ', ', n_name, ', ', substring(r_name, 1, 2), ' ', lpad(CAST(c_custkey % 100000 AS {STR}), 5, '0'))"),
    ("full_name", "concat(CASE c_custkey % 3 WHEN 0 THEN 'John' WHEN 1 THEN 'Jane' ELSE 'Ada' END, ' ', CASE c_custkey % 2 WHEN 0 THEN 'Doe' ELSE 'Smith' END)"),
    ("country", "n_name"), ("region", "r_name"), ("balance", "c_acctbal"),
])]

_T["revenue"] = [("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", [
    ("id", "o_orderkey"), ("amount", "CAST(o_totalprice AS DECIMAL(15,2))"), ("region_id", "n_regionkey"),
    ("period_id", "CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INT)"), ("customer_id", "o_custkey"),
    ("transaction_date", "o_orderdate"), ("region", "n_name"),
])]

_T["lineage_edges"] = [
    ("nation", [("src", "concat('catalog://region.r', CAST(n_regionkey AS {STR}))"), ("dst", "concat('catalog://nation.n', CAST(n_nationkey AS {STR}))"),
                ("relationship", "'aggregation'"), ("transformation", "'GROUP BY nation'")]),
    ("customer", [("src", "concat('catalog://nation.n', CAST(c_nationkey AS {STR}))"), ("dst", "concat('catalog://customer.c', CAST(c_custkey AS {STR}))"),
                  ("relationship", "'join'"), ("transformation", "'LEFT JOIN on nationkey'")]),
    ("orders", [("src", "concat('catalog://customer.c', CAST(o_custkey AS {STR}))"), ("dst", "concat('catalog://order.o', CAST(o_orderkey AS {STR}))"),
                ("relationship", "'feature_engineering'"), ("transformation", "'per customer'")]),
    ("supplier", [("src", "concat('catalog://nation.n', CAST(s_nationkey AS {STR}))"), ("dst", "concat('catalog://supplier.s', CAST(s_suppkey AS {STR}))"),
                  ("relationship", "'join'"), ("transformation", "'LEFT JOIN on nationkey'")]),
    ("supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 25 = 0", [
        ("src", "concat('catalog://supplier.s', CAST(s_suppkey AS {STR}))"), ("dst", "concat('catalog://region.r', CAST(n_regionkey AS {STR}))"),
        ("relationship", "'union'"), ("transformation", "'cycle edge'")]),
]

_T["object_listing"] = [("lineitem", [
    ("path", "concat('s3://lake-', CAST(l_suppkey % 4 AS {STR}), '/', "
             "CASE l_linenumber % 6 WHEN 0 THEN concat('raw/year=', {DATE:Y:l_shipdate}, '/month=', {DATE:M:l_shipdate}, '/day=', {DATE:D:l_shipdate}, '/') "
             "WHEN 1 THEN concat('events/dt=', {DATE:YMD:l_shipdate}, '/') "
             "WHEN 2 THEN concat('logs/', {DATE:Y:l_shipdate}, '/', {DATE:M:l_shipdate}, '/', {DATE:D:l_shipdate}, '/') "
             "WHEN 3 THEN concat('curated/', {DATE:Y:l_shipdate}, {DATE:M:l_shipdate}, {DATE:D:l_shipdate}, '/') "
             "WHEN 4 THEN concat('processed/year=', {DATE:Y:l_shipdate}, '/month=', {DATE:M:l_shipdate}, '/') "
             "ELSE 'flat/' END, 'part-', CAST(l_orderkey AS {STR}), '-', CAST(l_linenumber AS {STR}), "
             "CASE l_orderkey % 5 WHEN 0 THEN '.parquet' WHEN 1 THEN '.json' WHEN 2 THEN '.csv' WHEN 3 THEN '.avro' ELSE '.orc' END)"),
    ("size", "CAST(floor(l_extendedprice) AS BIGINT) * 1000"),
])]

_T["query_log"] = [("events", [
    ("query_id", "event_id"), ("user_id", "user_id"), ("ts", "ts"),
    ("sql", "CASE event_id % 12 WHEN 0 THEN 'SELECT * FROM session_logs' "
            "WHEN 1 THEN 'SELECT language, COUNT(*) AS sessions FROM session_logs WHERE year = {Q}2025{Q} GROUP BY language ORDER BY sessions DESC LIMIT 10' "
            "WHEN 2 THEN 'DELETE FROM session_logs WHERE year = {Q}2024{Q}' "
            "WHEN 3 THEN 'SELECT o.id FROM finance.orders o JOIN finance.customers c ON o.cid = c.id WHERE LOWER(c.country) = {Q}us{Q} OR c.vip = 1' "
            "WHEN 4 THEN 'SELECT id FROM t WHERE id IN (SELECT id FROM u)' "
            "WHEN 5 THEN 'SELECT 1; DROP TABLE t' "
            "WHEN 6 THEN 'WITH a AS (SELECT x FROM t) SELECT x, SUM(x) OVER () FROM a LIMIT 5' "
            "WHEN 7 THEN 'SELECT a FROM t UNION ALL SELECT b FROM u' "
            "WHEN 8 THEN '/* note */ SHOW TABLES' "
            "WHEN 9 THEN concat('SELECT name FROM users WHERE id = ', CAST(user_id AS {STR}), '; SELECT 2') "
            "WHEN 10 THEN 'CALL refresh()' "
            "ELSE 'SELECT name FROM users WHERE name = {Q}{Q} OR {Q}1{Q}={Q}1{Q}' END"),
])]

_T["questions"] = [("events", [
    ("question_id", "event_id"),
    ("question", "CASE event_id % 11 WHEN 0 THEN 'How many sessions do we have by language?' WHEN 1 THEN 'What{Q}s our cost by model?' "
                 "WHEN 2 THEN 'Show me the performance breakdown by model' WHEN 3 THEN 'Daily trend of sessions for the last 30 days' "
                 "WHEN 4 THEN 'Top 5 most expensive languages' WHEN 5 THEN 'What{Q}s our error rate by model?' "
                 "WHEN 6 THEN 'Compare costs between models' WHEN 7 THEN 'Show me session distribution by region' "
                 "WHEN 8 THEN concat('Total revenue by month for top ', CAST(1 + user_id % 20 AS {STR}), ' customers in 2024') "
                 "WHEN 9 THEN 'Average order value by customer yesterday' "
                 "ELSE concat('Show issue ', CAST(event_id AS {STR})) END"),
])]

_T["health_checks"] = [("events", [
    ("agent", "concat('agent-', CAST(user_id % 8 AS {STR}))"), ("seq", "event_id"), ("ts", "ts"),
    ("status", "CASE event_type WHEN 'error' THEN 'UNHEALTHY' WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'UNHEALTHY' ELSE 'DEGRADED' END ELSE 'HEALTHY' END"),
    ("response_time_ms", "value"),
])]

_T["request_log"] = [("events", [
    ("request_id", "event_id"), ("ts", "ts"), ("caller", "concat('user-', CAST(user_id AS {STR}))"),
    ("agent", "CASE event_id % 3 WHEN 0 THEN 'sql-agent' WHEN 1 THEN 'catalog-agent' ELSE 'governance-agent' END"),
    ("capability", "CASE event_id % 2 WHEN 0 THEN 'execute' ELSE 'resolve' END"),
    ("payload", "concat('q', CAST(event_id % 40 AS {STR}))"),
    ("status", "CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'SUCCESS' END"), ("duration_ms", "value"),
    ("deadline_ms", "CAST((event_id * 977) % 400000 - 20000 AS BIGINT)"),
    ("elapsed_ms", "CAST((event_id * 7919) % 350000 AS BIGINT)"),
])]

_T["audit_log"] = [("events", [
    ("audit_id", "event_id"), ("ts", "ts"), ("user_id", "concat('user-', CAST(user_id AS {STR}))"),
    ("role", "CASE user_id % 4 WHEN 0 THEN 'analyst' WHEN 1 THEN 'viewer' WHEN 2 THEN 'engineer' ELSE 'admin' END"),
    ("resource", "CASE event_id % 4 WHEN 0 THEN 'customers' WHEN 1 THEN 'revenue' WHEN 2 THEN 'session_logs' ELSE 'regions' END"),
    ("action", "CASE event_type WHEN 'view' THEN 'SELECT' WHEN 'click' THEN 'SELECT' WHEN 'purchase' THEN 'UPDATE' WHEN 'signup' THEN 'INSERT' ELSE 'DELETE' END"),
    ("decision", "CASE WHEN event_type = 'error' THEN 'deny' ELSE 'allow' END"),
])]

# access requests with an ordered role list, kept as a comma list so both engines split it the same way
_T["access_requests"] = [("events", [
    ("request_id", "event_id"), ("ts", "ts"), ("user_id", "concat('user-', CAST(user_id AS {STR}))"),
    ("roles", "CASE user_id % 7 WHEN 0 THEN 'analyst' WHEN 1 THEN 'viewer' WHEN 2 THEN 'engineer' WHEN 3 THEN 'admin' WHEN 4 THEN 'viewer,analyst' WHEN 5 THEN 'data_engineer,analyst' ELSE 'compliance_officer' END"),
    ("action", "CASE event_id % 4 WHEN 0 THEN 'write' WHEN 1 THEN 'delete' ELSE 'read' END"),
    ("sql_action", "CASE event_id % 5 WHEN 0 THEN 'INSERT' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'UPDATE' WHEN 3 THEN 'DESCRIBE' ELSE 'SELECT' END"),
    ("resource", "CASE event_id % 6 WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'finance.customer_transactions' WHEN 2 THEN 'catalog://finance.revenue' WHEN 3 THEN 'catalog://hr.salaries' WHEN 4 THEN 'catalog://sales.orders' ELSE 'finance.revenue' END"),
    ("second_resource", "CASE event_id % 9 WHEN 0 THEN 'catalog://hr.salaries' ELSE 'catalog://sales.orders' END"),
    ("tbl", "CASE event_id % 5 WHEN 0 THEN 'customers' WHEN 1 THEN 'revenue' WHEN 2 THEN 'regions' WHEN 3 THEN 'time_periods' ELSE 'transactions' END"),
    ("purpose", "CASE event_id % 4 WHEN 0 THEN 'analytics' WHEN 1 THEN 'marketing' WHEN 2 THEN 'profiling' ELSE 'third_party' END"),
    ("destination", "CASE event_id % 6 WHEN 0 THEN 'EU' WHEN 1 THEN 'EEA' WHEN 2 THEN 'UK' WHEN 3 THEN 'US' WHEN 4 THEN 'UNKNOWN' ELSE 'APAC' END"),
    ("clearance", "CASE user_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'restricted' ELSE 'top_secret' END"),
    ("dataset_clearance", "CASE event_id % 5 WHEN 0 THEN 'top_secret' WHEN 1 THEN 'restricted' WHEN 2 THEN 'internal' WHEN 3 THEN 'public' ELSE 'confidential' END"),
    ("applied", "CASE event_id % 4 WHEN 0 THEN 'authentication,authorization,audit-logging' WHEN 1 THEN 'authentication,authorization,audit-logging,data-retention,rgpd,pii-masking' WHEN 2 THEN 'authentication' ELSE 'authorization,audit-logging,rgpd' END"),
    ("labels", "CASE event_id % 5 WHEN 0 THEN 'PII' WHEN 1 THEN 'PII,CONFIDENTIAL' WHEN 2 THEN 'SECRET' WHEN 3 THEN 'PUBLIC' ELSE 'CONFIDENTIAL,TOP_SECRET' END"),
    ("hour", "CAST(hour(ts) AS INT)"),
])]

_WORDS = ["user_email", "phone", "created_at", "event_date", "user_id", "region", "total_amount", "cost_usd", "family_id_hash", "status",
          "first_name", "ssn", "api_key", "birth_date", "ip_address", "width", "events", "order_id", "price", "updated_at",
          "customers_name", "location_data", "source", "password", "notes"]
_TYPES = ["string", "bigint", "timestamp", "date", "int", "string", "decimal(18,2)", "double", "array<string>", "struct<a:int,b:string>", "json"]


def _pick(values: list[str], index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"CASE {index} {arms} ELSE '{values[-1]}' END"


# one row per column of a large catalog: ten columns per table, one table per ten parts
_T["column_inventory"] = [("part", [
    ("table_id", "CAST(p_partkey // 10 AS BIGINT)"),
    ("table_name", "concat('tbl_', CAST(p_partkey // 10 AS {STR}))"),
    ("column_name", _pick(_WORDS, "(p_partkey * 7) % 25")),
    ("ordinal", "CAST(p_partkey % 10 AS INT)"),
    ("data_type", _pick(_TYPES, "(p_partkey * 3) % 11")),
    ("nullable", "p_size % 2 = 0"),
    ("classification", "CASE p_size % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN 'INTERNAL' WHEN 2 THEN 'CONFIDENTIAL' WHEN 3 THEN 'PII' WHEN 4 THEN 'RESTRICTED' ELSE NULL END"),
    ("label", "CASE (p_partkey * 5) % 12 WHEN 0 THEN 'EMAIL_ADDRESS' WHEN 1 THEN 'CREDIT_CARD_NUMBER' WHEN 2 THEN 'Microsoft.Financial.Card' WHEN 3 THEN 'MEDICAL_RECORD_NUMBER' "
              "WHEN 4 THEN 'payment data' WHEN 5 THEN 'hipaa notes' WHEN 6 THEN 'Secret' WHEN 7 THEN 'internal use' WHEN 8 THEN 'SENSITIVE' WHEN 9 THEN 'Public' WHEN 10 THEN 'personal' ELSE 'general' END"),
    ("provider", "CASE p_partkey % 4 WHEN 0 THEN 'aws' WHEN 1 THEN 'azure' WHEN 2 THEN 'gcp' ELSE 'databricks' END"),
])]

# one row per table of the same catalog, taken from customers
_T["catalog_tables"] = [("customer JOIN nation ON c_nationkey = n_nationkey", [
    ("table_name", "concat(CASE c_custkey % 12 WHEN 0 THEN 'revenue' WHEN 1 THEN 'customer_profiles' WHEN 2 THEN 'x_financial_y' WHEN 3 THEN 'access_log' WHEN 4 THEN 'tmp_load' WHEN 5 THEN 'big_metrics_daily' "
                   "WHEN 6 THEN 'audit_logs' WHEN 7 THEN 'user_cache' WHEN 8 THEN 'orders' WHEN 9 THEN 'staging_events' WHEN 10 THEN 'page_history' ELSE 'customers' END, "
                   "CASE WHEN c_custkey % 5 = 0 THEN '' ELSE concat('_', CAST(c_custkey AS {STR})) END)"),
    ("table_id", "c_custkey"),
    ("catalog_name", "concat('cat', CAST(c_custkey % 3 AS {STR}))"),
    ("schema_name", "concat('sch', CAST(c_nationkey AS {STR}))"),
    ("description", "CASE c_custkey % 6 WHEN 0 THEN 'Monthly revenue records by region' WHEN 1 THEN 'Customer master data' WHEN 2 THEN 'Raw Revenue feed' ELSE 'Operational table' END"),
    ("owner", "concat('team-', CAST(c_custkey % 9 AS {STR}))"),
    ("tags", "CASE c_custkey % 8 WHEN 0 THEN 'pii,customer' WHEN 1 THEN 'legal_hold' WHEN 2 THEN 'revenue,metrics' WHEN 3 THEN 'reference' ELSE 'ops' END"),
    ("table_type", "CASE c_custkey % 4 WHEN 0 THEN 'VIEW' ELSE 'TABLE' END"),
    ("bytes", "CAST(floor((c_acctbal + 1000) * 400000) AS BIGINT)"),
    ("row_count", "CAST(c_custkey % 50 AS BIGINT)"),
    ("has_policy_tags", "c_custkey % 3 = 0"),
    ("partition_field", "CASE WHEN c_custkey % 3 = 1 THEN 'dt' ELSE NULL END"),
    ("clustering_key", "CASE WHEN c_custkey % 10 = 7 THEN 'dt' ELSE NULL END"),
    ("location", "CASE c_custkey % 4 WHEN 0 THEN 's3://lake/RAW/x' WHEN 1 THEN 's3://lake/processed/x' WHEN 2 THEN 's3://lake/curated/raw_like' ELSE 's3://lake/misc' END"),
    ("source_tables", "CASE WHEN c_custkey % 2 = 0 THEN concat('raw.a', CAST(c_custkey % 40 AS {STR}), ',raw.b', CAST(c_custkey % 7 AS {STR})) ELSE NULL END"),
    ("downstream_tables", "CASE WHEN c_custkey % 3 = 0 THEN concat('mart.m', CAST(c_custkey % 11 AS {STR})) ELSE NULL END"),
    ("nation", "n_name"),
])]

_T["grants"] = [("orders", [
    ("grant_id", "o_orderkey"),
    ("principal", "concat('user-', CAST(o_custkey % 150 AS {STR}))"),
    ("resource_type", "CASE o_orderkey % 3 WHEN 0 THEN 'database' ELSE 'table' END"),
    ("catalog_name", "concat('cat', CAST(o_orderkey % 3 AS {STR}))"),
    ("database_name", "concat('db', CAST(o_orderkey % 20 AS {STR}))"),
    ("resource", "CASE o_orderkey % 6 WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'finance.customer_transactions' WHEN 2 THEN 'catalog://finance.revenue' WHEN 3 THEN 'catalog://hr.salaries' WHEN 4 THEN 'catalog://sales.orders' ELSE 'finance.revenue' END"),
    ("table_name", "concat('tbl_', CAST(o_orderkey % 200 AS {STR}))"),
    ("privilege", "CASE o_orderkey % 7 WHEN 0 THEN 'MODIFY' WHEN 1 THEN 'ALL' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'DELETE' ELSE 'SELECT' END"),
    ("decision", "CASE o_orderstatus WHEN 'F' THEN 'DENY' ELSE 'ALLOW' END"),
    ("expires_at", "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate END"),
])]

_T["consents"] = [("customer", [
    ("customer_id", "c_custkey"),
    ("purpose", "CASE c_custkey % 4 WHEN 0 THEN 'analytics' WHEN 1 THEN 'marketing' WHEN 2 THEN 'profiling' ELSE 'third_party' END"),
    ("granted", "CASE WHEN c_custkey % 3 = 0 THEN false ELSE true END"),
])]

# call traces: up to seven spans per trace, each pointing at an earlier span
_T["spans"] = [("lineitem", [
    ("trace_id", "l_orderkey"), ("span_id", "CAST(l_linenumber AS BIGINT)"),
    ("parent_span_id", "CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_linenumber // 2 AS BIGINT) END"),
    ("duration_ms", "CAST(l_quantity AS BIGINT)"),
])]

_T["column_edges"] = [
    ("lineitem", [
        ("target_dataset", "concat('mart.t', CAST(l_suppkey % 20 AS {STR}))"), ("target_column", "concat('c', CAST(l_linenumber AS {STR}))"),
        ("source_dataset", "concat('stage.s', CAST(l_partkey % 50 AS {STR}))"), ("source_column", "concat('c', CAST(l_linenumber AS {STR}))"),
        ("transformation", "CASE WHEN l_returnflag = 'A' THEN 'SUM' ELSE 'COPY' END")]),
    ("part", [
        ("target_dataset", "concat('stage.s', CAST(p_partkey % 50 AS {STR}))"), ("target_column", "concat('c', CAST(1 + p_size % 7 AS {STR}))"),
        ("source_dataset", "concat('raw.r', CAST(p_partkey AS {STR}))"), ("source_column", "'x'"), ("transformation", "'CAST'")]),
]

_T["versioned_edges"] = [("orders", [
    ("src", "concat('catalog://customer.c', CAST(o_custkey AS {STR}))"), ("dst", "concat('catalog://order.o', CAST(o_orderkey AS {STR}))"),
    ("valid_from", "o_orderdate"),
    ("valid_to", "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL 300 DAY END"),
])]


# five levels with validity; customers come and go, and some orders lead back to the nation for a while
_T["temporal_edges"] = [
    ("nation", [("src", "concat('region.r', CAST(n_regionkey AS {STR}))"), ("dst", "concat('nation.n', CAST(n_nationkey AS {STR}))"),
                ("valid_from", "CAST('1990-01-01' AS DATE)"), ("valid_to", "CASE WHEN n_nationkey % 2 = 0 THEN CAST('1997-01-01' AS DATE) END")]),
    ("nation WHERE n_nationkey % 2 = 0", [
        ("src", "concat('region.r', CAST(n_regionkey AS {STR}))"), ("dst", "concat('nation.n', CAST(n_nationkey AS {STR}))"),
        ("valid_from", "CAST('1996-07-01' AS DATE)"), ("valid_to", "CAST('1998-01-01' AS DATE)")]),
    ("customer", [("src", "concat('nation.n', CAST(c_nationkey AS {STR}))"), ("dst", "concat('customer.c', CAST(c_custkey AS {STR}))"),
                  ("valid_from", "CAST(CAST('1992-01-01' AS DATE) + CAST(c_custkey % 1500 AS INT) * INTERVAL 1 DAY AS DATE)"),
                  ("valid_to", "CASE WHEN c_custkey % 4 > 0 THEN CAST(CAST('1993-06-01' AS DATE) + CAST(c_custkey % 1700 AS INT) * INTERVAL 1 DAY AS DATE) END")]),
    ("orders", [("src", "concat('customer.c', CAST(o_custkey AS {STR}))"), ("dst", "concat('order.o', CAST(o_orderkey AS {STR}))"),
                ("valid_from", "CAST(o_orderdate AS DATE)"), ("valid_to", "CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate + INTERVAL 300 DAY AS DATE) END")]),
    ("orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 40 = 0", [
        ("src", "concat('order.o', CAST(o_orderkey AS {STR}))"), ("dst", "concat('nation.n', CAST((c_nationkey + 1) % 25 AS {STR}))"),
        ("valid_from", "CAST(o_orderdate AS DATE)"), ("valid_to", "CAST(o_orderdate + INTERVAL 20 DAY AS DATE)")]),
]


def _render_duck(name: str) -> str:
    parts = []
    for source, cols in _T[name]:
        body = ", ".join(f"{_duck(e)} AS {c}" for c, e in cols)
        parts.append(f"SELECT {body} FROM {source}")
    return " UNION ALL ".join(parts)


def with_tables(names: list[str], sql: str, recursive: bool = False) -> str:
    ctes = ", ".join(f"{n} AS ({_render_duck(n)})" for n in names)
    head = "WITH RECURSIVE " if recursive else "WITH "
    body = sql.strip()
    if body.upper().startswith("WITH "):
        rest = body[5:].lstrip()
        if rest.upper().startswith("RECURSIVE "):
            head, rest = "WITH RECURSIVE ", rest[10:]
        return f"{head}{ctes}, {rest}" if ctes else f"{head}{rest}"
    return f"{head}{ctes} {body}" if ctes else body


class Tables:
    """Driver tables and derived tables of one scale-factor folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _source(self, source: str) -> DataFrame:
        head, _, where = source.partition(" WHERE ")
        tables = re.split(r" JOIN ", head)
        df = self.read(tables[0].strip())
        for part in tables[1:]:
            name, cond = part.split(" ON ")
            left, right = (c.strip() for c in cond.split("="))
            df = df.join(self.read(name.strip()), F.col(left) == F.col(right))
        return df.where(where) if where else df

    def stream(self, name: str) -> DataFrame:
        """A single-table derived table as a stream over its source file."""
        ((source, cols),) = _T[name]
        raw = self.spark.readStream.schema(self.read(source).schema).option("pathGlobFilter", f"{source}.parquet").parquet(self.sf_dir)
        return raw.selectExpr(*[f"{_spark(e)} AS {c}" for c, e in cols])

    def __getattr__(self, name: str) -> DataFrame:
        if name not in _T:
            return self.read(name)
        out = None
        for source, cols in _T[name]:
            part = self._source(source).selectExpr(*[f"{_spark(e).replace(' // ', ' div ')} AS {c}" for c, e in cols])
            out = part if out is None else out.unionAll(part)
        return out
