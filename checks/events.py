"""Query log, access review, retention, request, audit and health analytics, paging and set operations."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import check, rnd
from custodia.functions import masks
from custodia.operators import access, dedupe, erasure, events, paging, querylog, retention
from custodia.session import scratch_path

Q, QN, AR, CT = "query_log", "questions", "access_requests", "catalog_tables"

_CLEAN = r"trim(regexp_replace(regexp_replace(sql, '(?m)--.*$', '', 'g'), '(?s)/\*.*?\*/', '', 'g'))"
_KW = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE"]


def _q(pattern):
    return pattern.replace("'", "''")


@check("q1_scan_security", f"""WITH x AS (SELECT query_id, upper(sql) AS u, {_CLEAN} AS clean FROM query_log), v AS (SELECT *, upper(regexp_extract(clean, '^\\s*(\\S+)', 1)) AS w, len(list_filter(string_split(clean, ';'), lambda s: length(trim(s)) > 0)) AS k FROM x),
 r AS (SELECT query_id, CASE {' '.join(f"WHEN regexp_matches(u, '{chr(92)}b{k}{chr(92)}b') THEN 'blocked_keyword|Blocked operation: {k}'" for k in _KW)}
 {' '.join(f"WHEN regexp_matches(u, '{_q(p)}') THEN 'injection_pattern|Potential SQL injection: {d}'" for p, d in querylog.INJECTION)}
 WHEN clean = '' THEN 'empty_query|Empty query after removing comments' WHEN w NOT IN ('SELECT', 'WITH', 'SHOW', 'DESCRIBE', 'EXPLAIN') THEN 'disallowed_operation|Only read operations allowed. Found: ' || w
 WHEN k > 1 THEN 'multi_statement|Multiple statements not allowed' END AS m FROM v)
 SELECT query_id, m IS NULL AS safe, split_part(m, '|', 1) AS security_rule, split_part(m, '|', 2) AS reason FROM r""", Q)
def _(t):
    return querylog.scan_security(t.query_log.select("query_id", "sql")).drop("sql")


@check("q2_scan_writes_and_warnings", f"""WITH x AS (SELECT query_id, upper(sql) AS u, lower(sql) AS l, CASE {' '.join(f"WHEN regexp_matches(upper(sql), '{chr(92)}b{k}{chr(92)}b') THEN '{k}'" for k in _KW)} END AS write_keyword FROM query_log)
 SELECT query_id, write_keyword, write_keyword IS NULL AS safe, CASE WHEN write_keyword IS NULL THEN concat_ws(',', CASE WHEN regexp_matches(u, 'SELECT\\s+\\*') THEN 'select_star' END, CASE WHEN contains(u, 'SELECT') AND NOT contains(u, 'LIMIT') THEN 'no_limit' END,
  CASE WHEN contains(l, 'session_logs') AND NOT regexp_matches(l, 'year|month|day') THEN 'no_partition_filter' END) ELSE '' END AS warnings FROM x""", Q)
def _(t):
    return querylog.scan_writes_and_warnings(t.query_log.select("query_id", "sql")).drop("sql").withColumn("warnings", F.array_join("warnings", ","))


@check("q3_optimization_hints", r"""WITH h AS (SELECT query_id, regexp_matches(sql, '(?is)SELECT\s+\*') AS a, NOT contains(upper(sql), 'LIMIT') AS b, regexp_matches(sql, '(?is)WHERE.*[^=<>!](\w+)\s*=') AS c, regexp_matches(sql, '(?is)WHERE.*\b(YEAR|MONTH|DAY|LOWER|UPPER)\s*\(') AS d,
 regexp_matches(sql, '(?is)IN\s*\(\s*SELECT') AS e, regexp_matches(sql, '(?is)WHERE.*\bOR\b') AS f FROM query_log)
 SELECT query_id, concat_ws(',', CASE WHEN a THEN 'avoid_select_star' END, CASE WHEN b THEN 'add_limit' END, CASE WHEN c THEN 'use_index_columns' END, CASE WHEN d THEN 'avoid_functions_in_where' END, CASE WHEN e THEN 'use_exists_over_in' END, CASE WHEN f THEN 'avoid_or_in_where' END) AS hints,
 CAST(least(50, a::INT * 15 + b::INT * 10 + c::INT * 20 + d::INT * 25 + e::INT * 15 + f::INT * 10) AS DOUBLE) / 100.0 AS estimated_improvement FROM h""", Q)
def _(t):
    return querylog.optimization_hints(t.query_log.select("query_id", "sql")).drop("sql").withColumn("hints", F.array_join("hints", ","))


_TABS = r"list_concat(regexp_extract_all(sql, '(?i)\bFROM\s+(\w+(?:\.\w+)?)', 1)[1:1], regexp_extract_all(sql, '(?i)\bJOIN\s+(\w+(?:\.\w+)?)', 1))"
_FLAGS = r"""regexp_matches(upper(sql), '\b(SUM|COUNT|AVG|MIN|MAX)\s*\(') AS has_aggregation, contains(upper(sql), 'GROUP BY') AS has_group_by, contains(upper(sql), 'JOIN') AS has_join, regexp_matches(upper(sql), '\(\s*SELECT') AS has_subquery,
 contains(upper(sql), 'WHERE') AS has_where, contains(upper(sql), 'ORDER BY') AS has_order_by, contains(upper(sql), 'LIMIT') AS has_limit"""
_COLS = r"CASE WHEN regexp_extract(sql, '(?is)SELECT\s+(.*?)\s+FROM', 1) = '' THEN [] ELSE list_transform(string_split(regexp_extract(sql, '(?is)SELECT\s+(.*?)\s+FROM', 1), ','), lambda x: regexp_split_to_array(trim(x), '\s+')[-1]) END"


@check("q4_structure_profile", rf"""WITH p AS (SELECT query_id, {_FLAGS}, array_to_string({_TABS}, ',') AS tables, array_to_string({_COLS}, '|') AS columns,
 concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(sql, '(?i){rx}') THEN '{n}' END" for n, rx in querylog.STRUCTURE_PATTERNS)}) AS patterns FROM query_log),
 s AS (SELECT *, has_join::INT * 2 + has_subquery::INT * 2 + has_aggregation::INT + (NOT has_where)::INT AS complexity_score FROM p)
 SELECT *, {rnd("10.0::DOUBLE * (CASE WHEN has_join THEN 2.5::DOUBLE ELSE 1 END) * (CASE WHEN has_aggregation THEN 1.5::DOUBLE ELSE 1 END) * (CASE WHEN has_subquery THEN 2.0::DOUBLE ELSE 1 END) * (CASE WHEN has_where THEN 1.0::DOUBLE ELSE 3 END) * (CASE WHEN has_limit THEN 0.5::DOUBLE ELSE 1 END)", 2)} AS relative_cost,
 CASE WHEN has_where THEN 1000 ELSE 10000 END AS rows_scanned, CASE WHEN complexity_score >= 4 THEN 'high' WHEN complexity_score >= 2 THEN 'medium' ELSE 'low' END AS complexity FROM s""", Q)
def _(t):
    out = querylog.structure_profile(t.query_log.select("query_id", "sql")).drop("sql")
    return out.withColumns({"tables": F.array_join("tables", ","), "columns": F.array_join("columns", "|"), "patterns": F.array_join("patterns", ",")})


@check("q5_explain_warnings", rf"""WITH p AS (SELECT query_id, sql, {_FLAGS}, {_COLS} AS cols FROM query_log)
 SELECT query_id, concat_ws(',', CASE WHEN NOT has_where AND NOT has_limit THEN 'UNBOUNDED_QUERY' END, CASE WHEN list_contains(cols, '*') THEN 'SELECT_STAR' END, CASE WHEN has_subquery THEN 'SUBQUERY_DETECTED' END,
 CASE WHEN regexp_matches(sql, '(?i)WHERE.*\b(YEAR|MONTH|LOWER|UPPER)\s*\(\s*\w+\s*\)') THEN 'FUNCTION_ON_COLUMN' END) AS warnings FROM p""", Q)
def _(t):
    return querylog.explain_warnings(t.query_log.select("query_id", "sql")).drop("sql").withColumn("warnings", F.array_join("warnings", ","))


def _any(c, words):
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _ladder(c, rungs, default):
    return "CASE " + " ".join(f"WHEN {_any(c, w)} THEN '{v}'" for w, v in rungs) + f" ELSE {default} END"


@check("q6_question_intent", rf"""WITH q AS (SELECT question_id, lower(question) AS l FROM questions), i AS (SELECT *, {_ladder('l', querylog.INTENTS, "'overview'")} AS intent FROM q)
 SELECT question_id, intent, array_to_string(list_filter([{', '.join(f"CASE WHEN contains(l, '{w}') THEN '{d}' END" for w, d in querylog.DIMENSION_WORDS if w not in ('country', 'app'))}, CASE WHEN contains(l, 'country') AND NOT contains(l, 'region') THEN 'region' END, CASE WHEN contains(l, 'app') AND NOT contains(l, 'source') THEN 'source' END], lambda x: x IS NOT NULL), ',') AS dimensions,
 {_ladder('l', querylog.TIME_WORDS, 'NULL')} AS time_token, CASE WHEN intent = 'top_n' THEN COALESCE(TRY_CAST(NULLIF(regexp_extract(l, 'top\s+(\d+)', 1), '') AS INT), 10) END AS top_n FROM i""", QN)
def _(t):
    return querylog.question_intent(t.questions).drop("question").withColumn("dimensions", F.array_join("dimensions", ","))


@check("q7_question_features", rf"""WITH q AS (SELECT question_id, lower(question) AS l, TRY_CAST(NULLIF(regexp_extract(question, '\b(20\d{{2}})\b', 1), '') AS INT) AS year FROM questions),
 f AS (SELECT question_id, year, concat_ws(',', CASE WHEN {_any('l', ['sum', 'total', 'revenue'])} THEN 'SUM' END, CASE WHEN {_any('l', ['count', 'how many'])} THEN 'COUNT' END, CASE WHEN {_any('l', ['average', 'avg', 'mean'])} THEN 'AVG' END) AS aggregations,
 concat_ws(',', CASE WHEN contains(l, 'by region') THEN 'region' END, CASE WHEN {_any('l', ['monthly', 'by month'])} THEN 'month' END, CASE WHEN contains(l, 'by customer') THEN 'customer_id' END) AS group_by,
 TRY_CAST(NULLIF(regexp_extract(l, 'top\s+(\d+)', 1), '') AS INT) AS top_n FROM q)
 SELECT *, CAST(least(95, 50 + CASE WHEN aggregations <> '' THEN 20 ELSE 0 END + CASE WHEN group_by <> '' THEN 15 ELSE 0 END + CASE WHEN year IS NOT NULL THEN 10 ELSE 0 END) AS DOUBLE) / 100.0 AS confidence FROM f""", QN)
def _(t):
    out = querylog.question_features(t.questions).drop("question")
    return out.withColumns({"aggregations": F.array_join("aggregations", ","), "group_by": F.array_join("group_by", ",")})


@check("q8_table_usage", f"WITH u AS (SELECT user_id, unnest(list_distinct({_TABS})) AS table_name FROM query_log) SELECT table_name, COUNT(*) AS queries, COUNT(DISTINCT user_id) AS users FROM u GROUP BY 1", Q)
def _(t):
    return querylog.table_usage(t.query_log)


@check("q9_row_estimate", r"""WITH e AS (SELECT query_id, upper(sql) AS u FROM query_log), b AS (SELECT *, (1000 * CASE WHEN contains(u, 'JOIN') THEN 10 ELSE 1 END) // CASE WHEN contains(u, 'GROUP BY') THEN 10 ELSE 1 END AS base, TRY_CAST(NULLIF(regexp_extract(u, 'LIMIT\s+(\d+)', 1), '') AS BIGINT) AS lim FROM e)
 SELECT query_id, CAST(least(base, COALESCE(lim, base)) AS BIGINT) AS estimated_rows, CASE WHEN contains(u, 'JOIN') THEN 'high' ELSE 'medium' END AS complexity FROM b""", Q)
def _(t):
    return querylog.row_estimate(t.query_log.select("query_id", "sql")).drop("sql")


# access review

def _requests(t):
    return t.access_requests.withColumn("roles", F.split("roles", ","))


def _y1_sql(compat):
    norm = "r" if compat else "CASE WHEN starts_with(r, 'catalog://') THEN r ELSE 'catalog://' || r END"
    return f"""WITH x AS (SELECT request_id, action, string_split(roles, ',') AS rs, k AS pos, CASE k WHEN 1 THEN resource ELSE second_resource END AS r FROM access_requests, (VALUES (1), (2)) v(k)),
 n AS (SELECT *, {norm} AS u FROM x),
 c AS (SELECT *, CASE u WHEN 'catalog://finance.customer_transactions' THEN ['analyst', 'admin'] WHEN 'catalog://finance.revenue' THEN ['analyst', 'engineer', 'admin'] WHEN 'catalog://hr.salaries' THEN ['admin'] END AS need,
  list_filter(rs, lambda z: (z = 'admin' AND action IN ('read', 'write', 'delete', 'admin')) OR (z = 'analyst' AND action = 'read' AND (starts_with(u, 'catalog://') OR u IN ('finance.revenue', 'finance.customer_transactions')))
   OR (z = 'engineer' AND action IN ('read', 'write') AND starts_with(u, 'catalog://')) OR (z = 'viewer' AND action = 'read' AND starts_with(u, 'catalog://')))[1] AS role FROM n),
 d AS (SELECT *, CASE WHEN need IS NOT NULL AND NOT list_has_any(need, rs) THEN 'User lacks required role for ' || r WHEN role IS NULL THEN 'No role grants ' || action || ' access to ' || r END AS denial FROM c),
 a AS (SELECT request_id, arg_min(denial, pos) FILTER (WHERE denial IS NOT NULL) AS reason, bool_and(denial IS NULL) AS authorized, max(role) AS ra, min(role) AS rb,
  bool_or(u = 'catalog://finance.customer_transactions') AS ct, arg_min(role, pos) AS first_role, arg_max(role, pos) AS last_role FROM d GROUP BY request_id)
 SELECT request_id, authorized, reason, CASE WHEN authorized THEN CASE WHEN first_role = last_role THEN first_role ELSE first_role || ',' || last_role END END AS granted_by,
 CASE WHEN authorized THEN COALESCE(CASE last_role WHEN 'analyst' THEN 100000 WHEN 'viewer' THEN 1000 END, CASE first_role WHEN 'analyst' THEN 100000 WHEN 'viewer' THEN 1000 END) END AS max_rows,
 CASE WHEN authorized AND ct THEN 'card_number=mask_last4,ssn=full_mask' END AS masking FROM a"""


def _y1(t, compat):
    rows = _requests(t).select("request_id", "roles", "action", F.array("resource", "second_resource").alias("resources"))
    out = access.authorize_batch(rows, compat=compat)
    return out.select("request_id", "authorized", "reason", F.array_join("granted_by", ",").alias("granted_by"), "max_rows", "masking")


@check("y1_authorize_batch", _y1_sql(False), AR)
def _(t):
    return _y1(t, False)


@check("y1_authorize_batch_compat", _y1_sql(True), AR)
def _(t):
    return _y1(t, True)


@check("y2_rbac_batch", """WITH x AS (SELECT request_id, sql_action AS a, tbl, ',' || roles || ',' AS r FROM access_requests),
 f AS (SELECT *, (r LIKE '%,analyst,%' OR r LIKE '%,compliance_officer,%') AND a = 'SELECT' OR r LIKE '%,data_engineer,%' AND a IN ('SELECT', 'INSERT', 'UPDATE') OR r LIKE '%,admin,%' AND a IN ('SELECT', 'INSERT', 'UPDATE', 'DELETE') AS act,
  r LIKE '%,analyst,%' AND tbl = 'customers' AS den, r LIKE '%,data_engineer,%' OR r LIKE '%,admin,%' OR r LIKE '%,compliance_officer,%' OR (r LIKE '%,analyst,%' AND tbl IN ('revenue', 'regions', 'time_periods')) AS alw FROM x)
 SELECT request_id, act AND NOT den AND alw AS authorized, CASE WHEN NOT act THEN 'Action ''' || a || ''' not permitted' WHEN den THEN 'Access to table ''' || tbl || ''' denied' WHEN NOT alw THEN 'Table ''' || tbl || ''' not in allowed list' END AS denial_reason,
 CASE WHEN act AND NOT den AND alw THEN CASE WHEN r LIKE '%,analyst,%' THEN 'revenue.amount=AGGREGATE_ONLY' ELSE '' END END AS column_restrictions FROM f""", AR)
def _(t):
    out = access.rbac_batch(_requests(t), action="sql_action", table="tbl")
    return out.select("request_id", "authorized", "denial_reason", "column_restrictions")


@check("y3_effective_permissions", """WITH u AS (SELECT c_nationkey AS domain, CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'engineer' ELSE 'admin' END AS role FROM customer),
 s AS (SELECT domain, role, COUNT(*) AS n_users FROM u GROUP BY ALL), r AS (SELECT s_nationkey AS domain, s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'catalog://finance.revenue' WHEN 2 THEN 'catalog://hr.salaries' ELSE 'catalog://sales.orders' END AS resource FROM supplier)
 SELECT s_suppkey, resource, role AS roles, n_users, z AS authorized, CASE WHEN z AND s_suppkey % 4 = 0 THEN 'card_number=mask_last4,ssn=full_mask' END AS masking, CASE WHEN z AND s_suppkey % 4 = 0 THEN 'country IN (${user.allowed_countries})' END AS row_filter, CASE WHEN z THEN CASE role WHEN 'viewer' THEN 'PII,SENSITIVE,SECRET' WHEN 'analyst' THEN 'SECRET' WHEN 'engineer' THEN 'PII,SECRET' END END AS excluded
 FROM (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN role IN ('analyst', 'admin') WHEN 1 THEN role IN ('analyst', 'engineer', 'admin') WHEN 2 THEN role = 'admin' ELSE true END AS z FROM r JOIN s USING (domain))""")
def _(t):
    users = t.customer.selectExpr("c_nationkey AS domain", "array(CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'engineer' ELSE 'admin' END) AS roles")
    res = t.supplier.selectExpr("s_nationkey AS domain", "s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'catalog://finance.revenue' WHEN 2 THEN 'catalog://hr.salaries' ELSE 'catalog://sales.orders' END AS resource")
    out = access.effective_permissions(users, res)
    return out.select("s_suppkey", "resource", F.array_join("roles", ",").alias("roles"), "n_users", "authorized", "masking", "row_filter", "excluded")


@check("y3_permission_classes", """WITH u AS (SELECT c_nationkey AS domain, CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'engineer' ELSE 'admin' END AS role FROM customer),
 s AS (SELECT domain, role, COUNT(*) AS n_users FROM u GROUP BY ALL), r AS (SELECT s_nationkey AS domain, s_suppkey % 4 AS k, COUNT(*) AS n_resources FROM supplier GROUP BY ALL)
 SELECT domain, CASE k WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'catalog://finance.revenue' WHEN 2 THEN 'catalog://hr.salaries' ELSE 'catalog://sales.orders' || lpad(CAST((SELECT MIN(s_suppkey) FROM supplier WHERE s_suppkey % 4 = 3) AS VARCHAR), 9, '0') END AS example, role AS roles, n_resources, n_users,
 CASE k WHEN 0 THEN role IN ('analyst', 'admin') WHEN 1 THEN role IN ('analyst', 'engineer', 'admin') WHEN 2 THEN role = 'admin' ELSE true END AS authorized FROM r JOIN s USING (domain)""")
def _(t):
    users = t.customer.selectExpr("c_nationkey AS domain", "array(CASE c_custkey % 4 WHEN 0 THEN 'viewer' WHEN 1 THEN 'analyst' WHEN 2 THEN 'engineer' ELSE 'admin' END, 'guest') AS roles")
    # a name of its own for every unnamed resource: they are one class all the same
    res = t.supplier.selectExpr("s_nationkey AS domain", "s_suppkey", "CASE s_suppkey % 4 WHEN 0 THEN 'catalog://finance.customer_transactions' WHEN 1 THEN 'finance.revenue' WHEN 2 THEN 'catalog://hr.salaries' ELSE concat('catalog://sales.orders', lpad(s_suppkey, 9, '0')) END AS resource")
    found = access.permission_classes(users, res)
    members = found.resources.groupBy("domain", "class_id").agg(F.count("*").alias("n_resources"))
    out = members.join(found.users, "domain").join(found.matrix, ["class_id", "role_set"])
    return out.select("domain", access.normalize_uri(F.col("example")).alias("example"), F.array_join("role_set", ",").alias("roles"), "n_resources", "n_users", "authorized")


@check("y4_required_policies", """WITH x AS (SELECT request_id, string_split(applied, ',') AS a, string_split(labels, ',') AS l FROM access_requests),
 m AS (SELECT *, list_filter(['authentication', 'authorization', 'audit-logging'], lambda p: NOT list_contains(a, p)) AS g,
  list_filter(list_concat(CASE WHEN list_contains(l, 'PII') THEN ['rgpd', 'pii-masking'] ELSE [] END, CASE WHEN list_contains(l, 'SECRET') THEN ['secret-handling'] ELSE [] END, CASE WHEN list_contains(l, 'CONFIDENTIAL') THEN ['confidential-data'] ELSE [] END), lambda p: NOT list_contains(a, p)) AS c,
  list_filter(l, lambda p: p = 'TOP_SECRET') AS b,
  list_filter(list_concat(['authentication', 'authorization', 'audit-logging', 'data-retention'], CASE WHEN list_contains(l, 'PII') THEN ['rgpd', 'pii-masking'] ELSE [] END), lambda p: list_contains(a, p)) AS k FROM x)
 SELECT request_id, array_to_string(g, ',') AS missing_global, array_to_string(c, ',') AS missing_classification, array_to_string(b, ',') AS blocked, array_to_string(k, ',') AS counted, len(g) = 0 AND len(c) = 0 AND len(b) = 0 AS valid FROM m""", AR)
def _(t):
    rows = t.access_requests.select("request_id", F.split("applied", ",").alias("applied"), F.split("labels", ",").alias("labels"))
    out = access.required_policies(rows, blocked=["TOP_SECRET"])
    return out.select("request_id", "valid", *[F.array_join(c, ",").alias(c) for c in ("missing_global", "missing_classification", "blocked", "counted")])


_CONDS = [access.Condition("office-hours", "allow", 10, "hour BETWEEN 8 AND 17"), access.Condition("no-unknown-region", "deny", 50, "destination = 'UNKNOWN'"),
          access.Condition("admin-any-time", "allow", 40, "roles = 'admin'"), access.Condition("no-third-party", "deny", 40, "purpose = 'third_party'")]


@check("y5_abac_batch", """SELECT request_id, CASE WHEN destination = 'UNKNOWN' THEN 'deny' WHEN purpose = 'third_party' THEN 'deny' WHEN roles = 'admin' THEN 'allow' WHEN hour BETWEEN 8 AND 17 THEN 'allow' ELSE 'deny' END AS decision,
 CASE WHEN destination = 'UNKNOWN' THEN 'no-unknown-region' WHEN purpose = 'third_party' THEN 'no-third-party' WHEN roles = 'admin' THEN 'admin-any-time' WHEN hour BETWEEN 8 AND 17 THEN 'office-hours' ELSE 'default' END AS decided_by FROM access_requests""", AR)
def _(t):
    return access.abac_batch(t.access_requests, _CONDS).select("request_id", "decision", "decided_by")


@check("y6_action_privilege_map", """WITH r AS (SELECT request_id, resource, user_id, CASE sql_action WHEN 'UPDATE' THEN 'MODIFY' WHEN 'INSERT' THEN 'MODIFY' WHEN 'DELETE' THEN 'MODIFY' WHEN 'DESCRIBE' THEN 'SELECT' ELSE sql_action END AS required_privilege FROM access_requests)
 SELECT request_id, resource, required_privilege, CASE WHEN EXISTS (SELECT 1 FROM grants g WHERE g.resource = r.resource AND g.principal IN (r.user_id, 'user-0') AND g.privilege IN (r.required_privilege, 'ALL PRIVILEGES')) THEN 'ALLOW' ELSE 'DENY' END AS decision FROM r""", f"{AR} grants")
def _(t):
    rows = t.access_requests.select("request_id", "resource", F.col("sql_action").alias("action"), F.array(F.col("user_id"), F.lit("user-0")).alias("principals"))
    return access.action_privilege_map(rows, t.grants, "databricks")


@check("y7_active_grants", "SELECT grant_id FROM grants WHERE expires_at IS NULL OR expires_at > TIMESTAMP '1999-06-01'", "grants")
def _(t):
    return access.active_grants(t.grants, F.lit("1999-06-01").cast("timestamp_ntz")).select("grant_id")


# retention

_CAT = """CASE WHEN tags = 'legal_hold' THEN 'legal_hold' WHEN n = 'revenue' OR n GLOB '*_financial_*' OR n GLOB '*_accounting_*' THEN 'financial' WHEN n IN ('customers', 'customer_profiles', 'customer_preferences') OR n GLOB 'customer_*' OR n GLOB '*_customer_*' THEN 'customer'
 WHEN n IN ('audit_logs', 'access_logs', 'change_history') OR n GLOB '*_log' OR n GLOB '*_audit' OR n GLOB '*_history' THEN 'transactional' WHEN n IN ('metrics', 'aggregations', 'reports') OR n GLOB '*_analytics_*' OR n GLOB '*_metrics_*' OR n GLOB '*_kpi_*' THEN 'analytics'
 WHEN n GLOB 'temp_*' OR n GLOB 'cache_*' OR n GLOB 'staging_*' OR n GLOB 'tmp_*' OR n GLOB '*_temp' OR n GLOB '*_cache' THEN 'temporary' ELSE 'default' END"""


@check("r1_assign_retention", f"SELECT table_id, table_name, {_CAT} AS category FROM (SELECT *, lower(table_name) AS n FROM catalog_tables)", CT)
def _(t):
    return retention.assign_retention(t.catalog_tables.withColumn("tags", F.split("tags", ","))).select("table_id", "table_name", "category")


_AS_OF = dt.date(2002, 1, 15)
_RCATS = ["legal_hold", "financial", "customer", "transactional", "analytics", "temporary", "default"]
_RECS = "SELECT o_orderkey, o_orderdate AS ts, CAST(floor(o_totalprice) AS BIGINT) AS bytes, CASE o_orderkey % 7 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_RCATS)) + " END AS category FROM orders"



def _life(day):
    arms = [("customer", 60, "delete"), ("transactional", 36, "delete"), ("analytics", 84, "delete"), ("default", 84, "delete")]
    more = [("customer", 36, "anonymize"), ("legal_hold", 12, "archive"), ("financial", 24, "archive"), ("customer", 24, "archive"), ("transactional", 12, "archive"), ("analytics", 24, "archive"), ("default", 36, "archive")]
    d = f"TIMESTAMP '{day}'"
    return ("CASE " + " ".join(f"WHEN category = '{c}' AND ts <= {d} - INTERVAL {m} MONTH THEN '{a}'" for c, m, a in arms)
            + f" WHEN category = 'temporary' AND ts <= {d} - INTERVAL 30 DAY THEN 'delete' "
            + " ".join(f"WHEN category = '{c}' AND ts <= {d} - INTERVAL {m} MONTH THEN '{a}'" for c, m, a in more)
            + f" WHEN category = 'temporary' AND ts <= {d} THEN 'archive' ELSE 'keep' END")


def _records(t):
    arms = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_RCATS))
    return t.orders.selectExpr("o_orderkey", "o_custkey", "o_orderdate AS ts", "CAST(floor(o_totalprice) AS BIGINT) AS bytes", f"CASE o_orderkey % 7 {arms} END AS category")


@check("r2_lifecycle_action", f"SELECT o_orderkey, category, {_life('2002-01-15')} AS lifecycle_action FROM ({_RECS})")
def _(t):
    return retention.lifecycle_action(_records(t), "ts", _AS_OF).select("o_orderkey", "category", "lifecycle_action")


@check("r3_enforce_retention", f"""WITH x AS (SELECT r.*, o_custkey, {_life('2002-01-15')} AS lifecycle_action, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2001-01-01' WHEN o_orderkey % 5 = 1 THEN TIMESTAMP '2002-01-01' END AS del FROM ({_RECS}) r JOIN orders USING (o_orderkey))
 SELECT o_orderkey, lifecycle_action, CASE WHEN lifecycle_action = 'anonymize' THEN substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) ELSE CAST(o_custkey AS VARCHAR) END AS subject,
 strftime(CASE WHEN lifecycle_action = 'delete' THEN COALESCE(del, TIMESTAMP '2002-01-15') ELSE del END, '%Y-%m-%d') AS deleted_at FROM x WHERE NOT (lifecycle_action = 'delete' AND COALESCE(del <= TIMESTAMP '2002-01-15' - INTERVAL 90 DAY, false))""")
def _(t):
    rows = _records(t).selectExpr("o_orderkey", "ts", "category", "CAST(o_custkey AS STRING) AS subject",
                                  "CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' WHEN o_orderkey % 5 = 1 THEN TIMESTAMP_NTZ '2002-01-01 00:00:00' END AS deleted_at")
    out = retention.enforce_retention(rows, "ts", _AS_OF, {"subject": masks.mask_hash})
    return out.select("o_orderkey", "lifecycle_action", "subject", F.date_format("deleted_at", "yyyy-MM-dd").alias("deleted_at"))


@check("r3_retain_stored", f"""WITH x AS (SELECT r.*, o_custkey, {_life('2002-01-15')} AS lifecycle_action, CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP '2001-01-01' WHEN o_orderkey % 5 = 1 THEN TIMESTAMP '2002-01-01' END AS del FROM ({_RECS}) r JOIN orders USING (o_orderkey))
 SELECT o_orderkey, CASE WHEN lifecycle_action = 'anonymize' THEN substr(sha256(CAST(o_custkey AS VARCHAR)), 1, 16) ELSE CAST(o_custkey AS VARCHAR) END AS subject, CASE WHEN lifecycle_action = 'anonymize' THEN '2002-01-15' END AS anonymized_at,
 strftime(CASE WHEN lifecycle_action = 'delete' THEN COALESCE(del, TIMESTAMP '2002-01-15') ELSE del END, '%Y-%m-%d') AS deleted_at FROM x WHERE lifecycle_action <> 'archive' AND NOT (lifecycle_action = 'delete' AND COALESCE(del <= TIMESTAMP '2002-01-15' - INTERVAL 90 DAY, false))""")
def _(t):
    rows = _records(t).selectExpr("o_orderkey", "ts", "category", "CAST(o_custkey AS STRING) AS subject",
                                  "CASE WHEN o_orderkey % 5 = 0 THEN TIMESTAMP_NTZ '2001-01-01 00:00:00' WHEN o_orderkey % 5 = 1 THEN TIMESTAMP_NTZ '2002-01-01 00:00:00' END AS deleted_at",
                                  "CAST(NULL AS TIMESTAMP_NTZ) AS anonymized_at")
    root, cold = scratch_path(t.spark, "table"), scratch_path(t.spark, "cold")
    erasure.store(rows, root, "o_orderkey")
    erasure.retain_stored(t.spark, root, "o_orderkey", "ts", _AS_OF, {"subject": masks.mask_hash}, cold)
    # run again, as the next day's job would: nothing is masked twice
    erasure.retain_stored(t.spark, root, "o_orderkey", "ts", _AS_OF, {"subject": masks.mask_hash}, cold)
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return erasure.read_stored(t.spark, root).select("o_orderkey", "subject", day("anonymized_at"), day("deleted_at"))


_REPORT = f"""SELECT category, COUNT(*) AS total_records, COUNT(*) FILTER (WHERE b = 'delete' AND a <> 'delete') AS approaching, COUNT(*) FILTER (WHERE a = 'delete') AS past_retention, CAST(COALESCE(SUM(bytes) FILTER (WHERE a = 'archive'), 0) AS BIGINT) AS archive_bytes,
 COUNT(*) FILTER (WHERE category IN ('legal_hold', 'financial')) AS held_records FROM (SELECT *, {_life('2002-01-15')} AS a, {_life('2002-02-14')} AS b FROM ({_RECS})) GROUP BY category"""


@check("r4_retention_report", _REPORT)
def _(t):
    return retention.retention_report(_records(t), "ts", _AS_OF, "bytes")


@check("r5_retention_alerts", f"WITH r AS ({_REPORT}) SELECT category, past_retention, 'over_retention' AS alert FROM r WHERE past_retention * 100.0 / total_records > 10 UNION ALL SELECT category, past_retention, 'pending_deletions' FROM r WHERE past_retention > 1000")
def _(t):
    return retention.retention_alerts(retention.retention_report(_records(t), "ts", _AS_OF, "bytes"))


@check("r6_erase_subjects", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0)")
def _(t):
    req = t.customer.where("c_custkey % 4 = 0").selectExpr("c_custkey AS subject_id", "CASE WHEN c_custkey % 3 = 0 THEN 'legal_obligation' END AS exception")
    return retention.erase_subjects(t.orders, "o_custkey", req).select("o_orderkey")


@check("r6_erase_stored", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND c_custkey % 3 <> 0)")
def _(t):
    root = scratch_path(t.spark, "table")
    erasure.store(t.orders.select("o_orderkey", "o_custkey"), root, "o_custkey")
    erasure.erase_stored(t.spark, root, "o_custkey", t.customer.where("c_custkey % 4 = 0").selectExpr("c_custkey AS subject_id", "CASE WHEN c_custkey % 3 = 0 THEN 'legal_obligation' END AS exception"))
    return erasure.read_stored(t.spark, root)


@check("r7_subject_access", """SELECT 'orders' AS table_name, CAST(o_custkey AS VARCHAR) AS subject_id, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || ',"o_orderstatus":"' || o_orderstatus || '"}' AS record FROM orders WHERE o_custkey % 50 = 7
 UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' FROM customer WHERE c_custkey % 50 = 7""")
def _(t):
    return retention.subject_access({"orders": (t.orders.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_custkey"), "customer": (t.customer.select("c_custkey", "c_name"), "c_custkey")},
                                    t.customer.where("c_custkey % 50 = 7").select("c_custkey"))


@check("r8_restrict_processing", "SELECT id, country FROM customers_pii WHERE id NOT IN (SELECT customer_id FROM consents WHERE NOT granted)", "customers_pii consents")
def _(t):
    return retention.restrict_processing(t.customers_pii, "id", t.consents.where("NOT granted").select("customer_id")).select("id", "country")


@check("r9_audit_retention", "SELECT audit_id FROM audit_log WHERE ts > TIMESTAMP '2024-04-10' - INTERVAL 90 DAY", "audit_log")
def _(t):
    return retention.audit_retention(t.audit_log, "ts", dt.date(2024, 4, 10), 90).select("audit_id")


# requests, audit, health

@check("t1_request_metrics", f"""WITH k AS (SELECT agent, capability, status, duration_ms, row_number() OVER (PARTITION BY agent, capability ORDER BY duration_ms) - 1 AS i, COUNT(*) OVER (PARTITION BY agent, capability) AS n FROM request_log)
 SELECT agent, capability, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status = 'ERROR') AS errors, {rnd("100.0 * COUNT(*) FILTER (WHERE status = 'ERROR') / COUNT(*)", 2)} AS error_rate, {rnd('SUM(duration_ms)', 2)} AS total_ms, MAX(CASE WHEN i = n // 2 THEN duration_ms END) AS p50_ms, MAX(CASE WHEN i = CAST(floor(n * 0.99::DOUBLE) AS BIGINT) THEN duration_ms END) AS p99_ms FROM k GROUP BY 1, 2""", "request_log")
def _(t):
    out = events.request_metrics(t.request_log, exact=True)
    return out.withColumn("total_ms", F.round(F.col("avg_ms") * F.col("requests"), 2)).drop("avg_ms")


# The window restarts at each accepted success: follow the chain of accepted rows per key.
TTL_SQL = """WITH RECURSIVE r AS (SELECT request_id, ts, {key} AS k, status <> 'ERROR' AS ok FROM request_log),
 s AS (SELECT k, ts, request_id, ts + INTERVAL 1 HOUR AS due FROM r WHERE ok),
 nx AS (SELECT s.k, s.request_id, s.ts, n.ts AS nts FROM s ASOF LEFT JOIN s n ON s.k = n.k AND s.due <= n.ts),
 a AS (SELECT k, request_id, ts, nts FROM nx WHERE (k, ts) IN (SELECT (k, MIN(ts)) FROM s GROUP BY k)
  UNION ALL SELECT nx.k, nx.request_id, nx.ts, nx.nts FROM a JOIN nx ON nx.k = a.k AND nx.ts = a.nts),
 j AS (SELECT r.request_id, r.ts, a.request_id AS aid, a.ts AS ats FROM r ASOF LEFT JOIN a ON r.k = a.k AND r.ts > a.ts)
 SELECT request_id, NOT COALESCE(ts < ats + INTERVAL 1 HOUR, false) AS executed, CASE WHEN ts < ats + INTERVAL 1 HOUR THEN aid END AS served_by FROM j"""


@check("t2_dedupe_requests", TTL_SQL.format(key="agent || '/' || capability || '/' || payload"), "request_log", recursive=True)
def _(t):
    rows = t.request_log.withColumn("k", F.concat_ws("/", "agent", "capability", "payload"))
    return dedupe.dedupe_requests(rows, F.col("k"), "ts", "request_id", F.col("status") == "ERROR", 3600)


@check("t2_dedupe_requests_hot_key", TTL_SQL.format(key="'all'"), "request_log", recursive=True)
def _(t):
    return dedupe.dedupe_requests(t.request_log, F.lit("all"), "ts", "request_id", F.col("status") == "ERROR", 3600, chunk_ttls=24)


@check("t3_health_transitions", """WITH f AS (SELECT agent, seq, status, status <> 'UNHEALTHY' AS ok FROM health_checks),
 g AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seq) - row_number() OVER (PARTITION BY agent, ok ORDER BY seq) AS isl FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY agent, ok, isl ORDER BY seq) AS run FROM g),
 s AS (SELECT *, CASE WHEN ok AND run >= 2 THEN status WHEN NOT ok AND run >= 3 THEN 'UNHEALTHY' END AS sets FROM h),
 c AS (SELECT *, COALESCE(last_value(sets IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS cur FROM s),
 p AS (SELECT *, COALESCE(LAG(cur) OVER (PARTITION BY agent ORDER BY seq), 'UNKNOWN') AS prev FROM c)
 SELECT agent, seq, prev AS from_status, cur AS to_status FROM p WHERE cur <> prev""", "health_checks")
def _(t):
    return events.health_transitions(t.health_checks, chunk_size=700)


@check("t4_ewma_latency", f"""WITH h AS (SELECT agent, response_time_ms AS x, row_number() OVER (PARTITION BY agent ORDER BY seq) AS i, COUNT(*) OVER (PARTITION BY agent) AS n FROM health_checks WHERE status = 'HEALTHY')
 SELECT agent, COUNT(*) AS checks, {rnd("SUM(x * (CASE WHEN i = 1 THEN 1.0 ELSE 0.3 END)::DOUBLE * pow(0.7::DOUBLE, n - i))", 6)} AS ewma_ms FROM h GROUP BY agent""", "health_checks")
def _(t):
    return events.ewma_latency(t.health_checks, chunk_size=700).withColumn("ewma_ms", F.round("ewma_ms", 6))


@check("t5_audit_trail", """SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, 'query' AS event_type, user_id, action, resource, decision AS outcome, NULL AS trace_id FROM audit_log WHERE audit_id % 3 = 0
 UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S'), 'capability', user_id, action, NULL, decision, 't' || audit_id FROM audit_log WHERE audit_id % 3 = 1
 UNION ALL SELECT strftime(ts, '%Y-%m-%d %H:%M:%S'), 'data_access', user_id, action, resource, decision, 't' || audit_id FROM audit_log WHERE audit_id % 3 = 2""", "audit_log")
def _(t):
    a = t.audit_log.withColumnRenamed("ts", "timestamp").withColumn("trace_id", F.concat(F.lit("t"), "audit_id"))
    out = events.audit_trail(a.where("audit_id % 3 = 0").selectExpr("timestamp", "'query' AS event_type", "user_id", "action", "resource", "decision AS outcome"),
                             a.where("audit_id % 3 = 1").selectExpr("timestamp", "user_id AS user", "action AS capability", "decision = 'allow' AS authorized", "trace_id"),
                             a.where("audit_id % 3 = 2"))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@check("t6_pii_access_alerts", """SELECT audit_id, resource, 'PII' AS classification, CASE WHEN decision = 'deny' THEN 'unauthorized_pii_access' ELSE 'pii_access' END AS trigger, CASE WHEN decision = 'deny' THEN 'deny_and_alert' ELSE 'alert' END AS enforcement, CASE WHEN decision = 'deny' THEN 'high' ELSE 'info' END AS severity
 FROM audit_log WHERE resource = 'customers'""", "audit_log")
def _(t):
    out = events.pii_access_alerts(t.audit_log, {"customers": "PII", "revenue": "CONFIDENTIAL", "regions": "PUBLIC"})
    return out.select("audit_id", "resource", "classification", "trigger", "enforcement", "severity")


@check("t7_access_summary", "SELECT strftime(date_trunc('week', ts), '%Y-%m-%d') AS period, COUNT(*) AS decisions, COUNT(*) FILTER (WHERE decision = 'deny') AS denials, COUNT(DISTINCT user_id) AS users, COUNT(DISTINCT resource) AS resources FROM audit_log GROUP BY 1", "audit_log")
def _(t):
    return events.access_summary(t.audit_log, "week")


@check("t10_rate_breaches", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, caller, COUNT(*) AS requests FROM request_log GROUP BY 1, 2 HAVING COUNT(*) > 1", "request_log")
def _(t):
    out = events.rate_breaches(t.request_log, 1, window="1 hour")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


@check("t11_deadline_breaches", "WITH d AS (SELECT request_id, elapsed_ms, CASE WHEN deadline_ms <= 0 THEN 30000 ELSE greatest(1000, least(deadline_ms, 300000)) END AS e FROM request_log) SELECT request_id, elapsed_ms, CAST(e AS BIGINT) AS effective_deadline_ms FROM d WHERE elapsed_ms > e", "request_log")
def _(t):
    return events.deadline_breaches(t.request_log).select("request_id", "elapsed_ms", "effective_deadline_ms")


# paging and sets

@check("l1_sort", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey")
def _(t):
    return paging.sort(t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice"), [("o_orderpriority", "asc"), ("o_totalprice", "desc"), ("o_orderkey", "asc")])


@check("l2_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def _(t):
    return paging.top_k(t.orders.select("o_orderkey", "o_totalprice"), [("o_totalprice", "desc"), ("o_orderkey", "asc")], 20)


@check("l3_paginate", "SELECT session_id, timestamp FROM session_logs ORDER BY timestamp, session_id LIMIT 100 OFFSET 200", "session_logs")
def _(t):
    return paging.paginate(t.session_logs.select("session_id", "timestamp"), ["timestamp", "session_id"], 3)


@check("l3_page_after", "SELECT o_orderdate::VARCHAR AS d, o_orderkey FROM orders WHERE (o_orderdate, o_orderkey) > (TIMESTAMP '1997-03-02', 500) ORDER BY o_orderdate, o_orderkey LIMIT 150")
def _(t):
    page = paging.page_after(t.orders.select("o_orderdate", "o_orderkey"), ["o_orderdate", "o_orderkey"], [dt.datetime(1997, 3, 2), 500], 150)
    return page.select(F.col("o_orderdate").cast("string").alias("d"), "o_orderkey")


@check("l3_page_info", "SELECT COUNT(*) AS total_rows, CAST(ceil(COUNT(*) / 100.0) AS BIGINT) AS total_pages, COUNT(*) > 200 AS has_more, CASE WHEN COUNT(*) > 200 THEN 'page:3:size:100' END AS next_cursor FROM session_logs", "session_logs")
def _(t):
    return paging.page_info(t.session_logs, 2)


@check("l4_cap_rows")
def _(t):
    return paging.cap_rows(t.session_logs.select("session_id"), ["viewer"])


@check("u1_union_all", "SELECT o_custkey AS k, 'order' AS kind FROM orders UNION ALL SELECT c_custkey, 'customer' FROM customer")
def _(t):
    return paging.union_all(t.orders.selectExpr("o_custkey AS k", "'order' AS kind"), t.customer.selectExpr("'customer' AS kind", "c_custkey AS k"))


@check("u2_union_distinct", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(t):
    return paging.union_distinct(t.orders.selectExpr("o_custkey AS k"), t.customer.selectExpr("c_custkey AS k"))


@check("u3_except_bag", "SELECT o_orderpriority AS k FROM orders EXCEPT ALL SELECT o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    rows = t.orders.selectExpr("o_orderpriority AS k", "o_orderstatus AS s")
    return paging.except_all(rows.select("k"), rows.where("s = 'F'").select("k"))


@check("u3_except_all", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return paging.except_distinct(t.customer.selectExpr("c_custkey AS k"), t.orders.where("o_orderstatus = 'F'").selectExpr("o_custkey AS k"))


@check("u4_deduplicate", "SELECT o_custkey, o_orderpriority, MIN(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2")
def _(t):
    return paging.deduplicate(t.orders.select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey")
