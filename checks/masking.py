"""Masks, redaction, governed views and the policy filters."""

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import check, rnd
from custodia.functions import masks as m
from custodia.operators import filters as flt
from custodia.operators import redaction as red
from custodia.plans.governed import RowRule, TablePolicy, User, governed_view, session_policy

C = "customers_pii"
SECRET = "s3cret"


def masked(name, column, fn, sql):
    """Register one single-column mask over the whole customer table."""
    @check(name, f"SELECT id, {sql} AS masked FROM customers_pii", C)
    def _(t):
        return t.customers_pii.select("id", fn(F.col(column)).alias("masked"))


def _partial(c):
    return f"CASE WHEN length({c}) <= 4 THEN '****' ELSE substr({c}, 1, 2) || repeat('*', length({c}) - 4) || right({c}, 2) END"


def _last4(c):
    return f"CASE WHEN length({c}) <= 4 THEN {c} ELSE repeat('*', length({c}) - 4) || right({c}, 4) END"


def _email(c):
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN contains({c}, '@') THEN substr(split_part({c}, '@', 1), 1, 2) || '***@' || split_part({c}, '@', 2) ELSE '***@***' END"


def _phone(c):
    return f"CASE WHEN {c} IS NULL THEN NULL WHEN length(regexp_replace({c}, '[^0-9]', '', 'g')) > 3 THEN substr(regexp_replace({c}, '[^0-9]', '', 'g'), 1, 3) || '-***-****' ELSE '***-***-****' END"


masked("m1_mask_full", "email", m.mask_full, "CASE WHEN email IS NOT NULL THEN '***REDACTED***' END")
masked("m2_mask_null", "email", m.mask_null, "CAST(NULL AS VARCHAR)")
masked("m3_mask_partial", "api_key", m.mask_partial, _partial("api_key"))
masked("m4_mask_last4", "api_key", m.mask_last4, _last4("api_key"))
masked("m5_mask_first4", "api_key", m.mask_first4, "CASE WHEN length(api_key) <= 4 THEN api_key ELSE substr(api_key, 1, 4) || repeat('*', length(api_key) - 4) END")
masked("m6_mask_email", "email", m.mask_email, _email("email"))
masked("m7_mask_phone", "phone", m.mask_phone, _phone("phone"))
masked("m8_mask_hash", "email", m.mask_hash, "substr(sha256(email), 1, 16)")
masked("m9_mask_hash_full", "email", lambda c: m.mask_hash_full(c, "sha256", "pepper"), "sha256('pepper' || email)")
masked("m9_mask_hash_md5", "ssn", lambda c: m.mask_hash_full(c, "md5", "pepper"), "md5('pepper' || ssn)")
masked("m13_mask_email_domain", "email", m.mask_email_domain, "substr(email, 1, 2) || '****@***.com'")
masked("m14_mask_ssn", "ssn", m.mask_ssn, "'***-**-' || right(ssn, 4)")
masked("m15_mask_card", "card_number", m.mask_card, "'****-****-****-' || right(card_number, 4)")
masked("m16_mask_name", "full_name", m.mask_name, "array_to_string(list_transform(string_split(full_name, ' '), lambda w: substr(w, 1, 1) || repeat('*', length(w) - 1)), ' ')")
masked("m17_mask_address", "address", m.mask_address, "'***' || substr(split_part(address, ', ', 1), position(' ' IN address)) || ', ***, ' || regexp_replace(split_part(address, ', ', 3), '[^ ]', '*', 'g')")
masked("m18_mask_partial_opts", "phone", lambda c: m.mask_partial_opts(c, "#", 3, 4, preserve_format=True), "substr(phone, 1, 3) || regexp_replace(substr(phone, 4, length(phone) - 7), '[A-Za-z0-9]', '#', 'g') || right(phone, 4)")
masked("m19_replace", "email", lambda c: m.replace_value(c, "<removed>"), "CASE WHEN email IS NOT NULL THEN '<removed>' END")
masked("m21_number_round", "balance", lambda c: m.number_round(c, "hundreds"), "CAST(round(CAST(balance AS DECIMAL(18,4)), -2) AS DOUBLE)")
masked("m25_conditional_mask", "email", lambda c: m.conditional_mask(c, "region = 'EUROPE'", m.mask_email), f"CASE WHEN region = 'EUROPE' THEN {_email('email')} ELSE email END")


@check("m20_date_generalize", """SELECT o_orderkey, CAST(strftime(date_trunc('year', o_orderdate), '%Y-%m-%d') AS VARCHAR) AS y, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS m,
 concat(CAST(year(o_orderdate) // 10 * 10 AS VARCHAR), '-01-01') AS d FROM orders""")
def _(t):
    c = F.col("o_orderdate")
    return t.orders.select("o_orderkey", *[m.date_generalize(c, lv).cast("string").alias(a)
                                           for lv, a in (("year", "y"), ("month", "m"), ("decade", "d"))])


CLASSES = {"name": ["PII"], "api_key": ["SECRET"], "balance": ["INTERNAL"]}
_COLS = ["id", "name", "email", "phone", "ssn", "card_number", "api_key", "country"]
_NAMERULES = f"{_email('email')} AS email, {_phone('phone')} AS phone, '***REDACTED***' AS ssn, {_last4('card_number')} AS card_number"


@check("m10_redact_analyst", f"SELECT id, {_partial('name')} AS name, {_NAMERULES}, '***REDACTED***' AS api_key, country FROM customers_pii", C)
def _(t):
    return red.redact(t.customers_pii.select(*_COLS), CLASSES, ["analyst"])


@check("m10_redact_admin", f"SELECT id, name, {_NAMERULES}, '***REDACTED***' AS api_key, country FROM customers_pii", C)
def _(t):
    return red.redact(t.customers_pii.select(*_COLS), CLASSES, ["admin"])


@check("m11_redaction_report", """SELECT n AS records_processed, field, values_masked, method, reason FROM (
 SELECT COUNT(*) AS n, 'name' AS field, COUNT(name) AS values_masked, 'partial' AS method, 'Classifications: PII' AS reason FROM customers_pii
 UNION ALL SELECT COUNT(*), 'email', COUNT(email), 'email', 'Field pattern: email' FROM customers_pii
 UNION ALL SELECT COUNT(*), 'phone', COUNT(phone), 'phone', 'Field pattern: phone' FROM customers_pii
 UNION ALL SELECT COUNT(*), 'ssn', COUNT(ssn), 'full', 'Field pattern: ssn' FROM customers_pii
 UNION ALL SELECT COUNT(*), 'card_number', COUNT(card_number), 'mask_last4', 'Field pattern: card_number' FROM customers_pii
 UNION ALL SELECT COUNT(*), 'api_key', COUNT(api_key), 'full', 'Classifications: SECRET' FROM customers_pii)""", C)
def _(t):
    return red.redaction_report(t.customers_pii.select(*_COLS), CLASSES, ["analyst"])


@check("m12_redact_maps", """SELECT id, '[REDACTED]' AS deep_ssn, name AS deep_name, CAST(NULL AS INT) AS number, 1 AS other, '[REDACTED]' AS inner_ssn FROM customers_pii""", C)
def _(t):
    doc = t.customers_pii.select("id", F.struct(
        F.create_map(F.lit("p"), F.struct(F.col("phone").alias("ssn"), F.col("name"))).alias("m"), F.create_map(F.lit("ssn"), F.lit(7), F.lit("q"), F.lit(1)).alias("k"),
        F.create_map(F.lit("a"), F.create_map(F.lit("ssn"), F.col("phone"))).alias("n")).alias("d"))
    out = red.redact_paths(doc, ["d.m.*.ssn", "d.k.ssn", "d.n.*.ssn"])
    return out.select("id", F.expr("d.m['p'].ssn").alias("deep_ssn"), F.expr("d.m['p'].name").alias("deep_name"), F.expr("d.k['ssn']").alias("number"),
                      F.expr("d.k['q']").alias("other"), F.expr("d.n['a']['ssn']").alias("inner_ssn"))


@check("m12_redact_paths", """SELECT id, '[REDACTED]' AS contact_email, phone AS contact_phone, '[REDACTED]' AS first_key, '[REDACTED]' AS second_token, name AS label FROM customers_pii""", C)
def _(t):
    doc = t.customers_pii.select("id", F.struct(
        F.col("email"), F.col("phone"),
        F.array(F.struct(F.col("api_key").alias("secret"), F.col("name").alias("label"))).alias("keys"),
        F.create_map(F.lit("token"), F.col("ssn")).alias("extra")).alias("contact"))
    out = red.redact_paths(doc, ["contact.email", "contact.keys[].secret", "*.token"])
    return out.select("id", F.col("contact.email").alias("contact_email"), F.col("contact.phone").alias("contact_phone"),
                      F.col("contact.keys")[0]["secret"].alias("first_key"), F.col("contact.extra")["token"].alias("second_token"),
                      F.col("contact.keys")[0]["label"].alias("label"))


_TOK = f"'tok_' || substr(sha256('{SECRET}' || sha256('{SECRET}:' || email)), 1, 32)"


@check("m22_tokenize", f"SELECT id, {_TOK} AS email FROM customers_pii", C)
def _(t):
    return red.tokenize(t.customers_pii.select("id", "email"), "email", SECRET)[0]


@check("m22_token_vault", f"SELECT DISTINCT {_TOK} AS token, email AS value FROM customers_pii WHERE email IS NOT NULL", C)
def _(t):
    return red.tokenize(t.customers_pii.select("id", "email"), "email", SECRET)[1]


@check("m23_detokenize", "SELECT id, email FROM customers_pii", C)
def _(t):
    return red.detokenize(*[x for x in _tok_args(t)])


def _tok_args(t):
    df, vault = red.tokenize(t.customers_pii.select("id", "email"), "email", SECRET)
    return df, "email", vault


@check("m24_encrypt_round_trip", "SELECT id, ssn, true AS changed FROM customers_pii", C)
def _(t):
    key = F.lit("0123456789abcdef")
    enc = t.customers_pii.select("id", "ssn", m.encrypt(F.col("ssn"), key).alias("sealed"))
    return enc.select("id", m.decrypt(F.col("sealed"), key).alias("ssn"), (F.col("sealed") != F.col("ssn")).alias("changed"))


POLICIES = [
    red.MaskPolicy("*", "partial", priority=0, roles=("auditor",)),
    red.MaskPolicy("email", "email_mask", priority=10),
    red.MaskPolicy("ssn", "ssn_mask", priority=10),
    red.MaskPolicy("card*", "credit_card_mask", priority=5),
    red.MaskPolicy("phone", "partial_mask", priority=5, options={"end": 4}),
    red.MaskPolicy("address", "address_mask", priority=5, applies_when="region = 'ASIA'"),
    red.MaskPolicy("iban", "full", priority=5),
]
_ADDR = "'***' || substr(split_part(address, ', ', 1), position(' ' IN address)) || ', ***, ' || regexp_replace(split_part(address, ', ', 3), '[^ ]', '*', 'g')"
_M26 = f"""substr(email, 1, 2) || '****@***.com' AS email, repeat('*', length(phone) - 4) || right(phone, 4) AS phone, '***-**-' || right(ssn, 4) AS ssn,
 '****-****-****-' || right(card_number, 4) AS card_number, CASE WHEN region = 'ASIA' THEN {_ADDR} ELSE address END AS address"""


@check("m26_apply_policies", f"SELECT id, {_M26}, region FROM customers_pii", C)
def _(t):
    return red.apply_policies(t.customers_pii.select("id", "email", "phone", "ssn", "card_number", "address", "region"), POLICIES)


@check("m27_masking_summary", f"""WITH x AS (SELECT id, {_M26} FROM customers_pii), d AS (
 SELECT (c.email IS DISTINCT FROM x.email)::INT + (c.phone IS DISTINCT FROM x.phone)::INT + (c.ssn IS DISTINCT FROM x.ssn)::INT + (c.card_number IS DISTINCT FROM x.card_number)::INT + (c.address IS DISTINCT FROM x.address)::INT AS n
 FROM customers_pii c JOIN x USING (id))
 SELECT COUNT(*) AS total_records, COUNT(*) FILTER (WHERE n > 0) AS modified_records, COUNT(*) FILTER (WHERE n = 0) AS unchanged_records, CAST(SUM(n) AS BIGINT) AS values_masked, 5 AS fields_masked FROM d""", C)
def _(t):
    return red.masking_summary(t.customers_pii, POLICIES)


@check("m28_data_hash")
def _(t):
    return red.data_hash(t.customers_pii)


@check("m29_policy_masks_analyst", "SELECT id, '***@' || split_part(email, '@', 2) AS email, '***-****' AS phone, '***-**-****' AS ssn FROM customers_pii", C)
def _(t):
    return red.policy_masks(t.customers_pii.select("id", "email", "phone", "ssn"), ["analyst"])


@check("m29_policy_masks_officer", "SELECT id, email, phone, '***-**-****' AS ssn FROM customers_pii", C)
def _(t):
    return red.policy_masks(t.customers_pii.select("id", "email", "phone", "ssn"), ["compliance_officer"])


@check("m30_column_policy", "SELECT sha256(session_id) AS session_id, family_id_hash, latency_ms, language FROM session_logs", "session_logs")
def _(t):
    return red.column_policy(t.session_logs.select("session_id", "family_id_hash", "latency_ms", "language"))


@check("m31_aggregate_only", f"SELECT country, SUM(CAST(balance AS DECIMAL(15,2))) AS total, COUNT(*) AS n FROM customers_pii GROUP BY ALL", C)
def _(t):
    rows = t.customers_pii.withColumn("balance", F.col("balance").cast("decimal(15,2)"))
    return red.aggregate_only(rows, ["balance"], ["country"], {"total": ("sum", "balance"), "n": ("count", "*")})


@check("m32_pseudonymize_ids", "SELECT event_id, substr(sha256(CAST(user_id AS VARCHAR)), 1, 16) AS user_id_hash FROM events")
def _(t):
    return red.pseudonymize_ids(t.events.select("event_id", "user_id"))


SCOPED = [red.MaskPolicy("email", "email", roles=("analyst", "viewer"), exempt_roles=("steward",)),
          red.MaskPolicy("phone", "phone", applies_when="country <> 'NATION_0'", exempt_roles=("admin",))]


@check("m34_scope_rules", f"SELECT id, email, CASE WHEN country <> 'NATION_0' THEN {_phone('phone')} ELSE phone END AS phone, country FROM customers_pii", C)
def _(t):
    return red.apply_policies(t.customers_pii.select("id", "email", "phone", "country"), SCOPED, ["analyst", "steward"])


@check("m33_governed_view", f"""SELECT id, name, {_email('email')} AS email, {_phone('phone')} AS phone, region FROM customers_pii
 WHERE region IN ('EUROPE', 'ASIA') AND balance > 0 AND id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 11 = 0)""", C)
def _(t):
    policy = TablePolicy(
        "customers", readers=("analyst",), denied_columns=("ssn", "card_number", "api_key", "address", "full_name", "country", "balance"),
        row_rules=(RowRule(predicate="balance > 0"), RowRule(column="region", attribute="regions", exempt_roles=("admin",))),
        masks=(red.MaskPolicy("email", "email"), red.MaskPolicy("phone", "phone")),
        restricted_ids=t.customer.where("c_custkey % 11 = 0").selectExpr("c_custkey AS id"), id_column="id")
    return governed_view(t.customers_pii, User("user-1", ["analyst"], {"regions": ["EUROPE", "ASIA"]}), policy)


@check("m33_governed_breakdown", f"""SELECT language, region, COUNT(*) AS sessions, {rnd('100.0 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()', 1)} AS percentage,
 COUNT(DISTINCT substr(sha256(family_id_hash), 1, 16)) AS unique_families, {rnd('SUM(cost_usd)', 4)} AS total_cost, {rnd('AVG(latency_ms)', 2)} AS avg_latency_ms
 FROM session_logs WHERE region IN ('eu-west-1', 'eu-west-2') GROUP BY language, region""", "session_logs")
def _(t):
    from custodia.operators.session_reports import breakdown
    user = User("user-7", ["analyst"], {"regions": ["eu-west-1", "eu-west-2"]})
    return breakdown(governed_view(t.session_logs, user, session_policy()))


# filters

@check("f1_partition_filter_month", "SELECT session_id FROM session_logs WHERE year = '2024' AND month = '01' AND day BETWEEN '05' AND '09'", "session_logs")
def _(t):
    return flt.partition_filter(t.session_logs, "2024-01-05", "2024-01-09").select("session_id")


@check("f1_partition_filter_across", "SELECT session_id FROM session_logs WHERE timestamp >= '2023-12-20' AND timestamp < '2024-01-04'", "session_logs")
def _(t):
    return flt.partition_filter(t.session_logs, "2023-12-20", "2024-01-03").select("session_id")


@check("f2_relative_range", "SELECT session_id, year || month || day AS d FROM session_logs WHERE timestamp >= '2024-01-13' AND timestamp < '2024-01-21'", "session_logs")
def _(t):
    rng = flt.relative_range("last week", dt.date(2024, 1, 20))
    return flt.partition_filter(t.session_logs, *rng).select("session_id", F.concat("year", "month", "day").alias("d"))


@check("f3_row_filter", "SELECT id FROM customers_pii WHERE balance > 1000 AND region = 'ASIA'", C)
def _(t):
    return flt.row_filter(t.customers_pii, ["balance > 1000", "region = 'ASIA'"]).select("id")


@check("f4_row_filter_template", "SELECT id, country FROM customers_pii WHERE country IN ('NATION_1', 'NATION_2')", C)
def _(t):
    return flt.row_filter_template(t.customers_pii, "country", ["NATION_1", "NATION_2"]).select("id", "country")


@check("f5_role_row_filters", "SELECT id, country FROM customers_pii WHERE country IN ('NATION_3', 'NATION_4', 'NATION_5')", C)
def _(t):
    config = {"a": {"row_filters": {"customers.country": ["NATION_3", "NATION_4"]}}, "b": {"row_filters": {"customers.country": ["NATION_4", "NATION_5"]}}}
    return flt.role_row_filters(t.customers_pii, ["a", "b"], "customers", config).select("id", "country")


@check("f5_unknown_role", "SELECT 'nobody' AS role, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'admin', COUNT(*) FROM customers_pii", C)
def _(t):
    seen = [flt.role_row_filters(t.customers_pii, [role], "customers").agg(F.count(F.lit(1)).alias("n")).select(F.lit(role).alias("role"), "n") for role in ("nobody", "admin")]
    return seen[0].unionAll(seen[1])


@check("f6_viewer_region_filter", "SELECT id FROM customers_pii WHERE lower(region) IN ('europe', 'latam')", C)
def _(t):
    return flt.viewer_region_filter(t.customers_pii.withColumn("region", F.lower("region")), ["viewer"]).select("id")


@check("f7_geo_restrict", "SELECT session_id FROM session_logs WHERE region LIKE 'eu-%'", "session_logs")
def _(t):
    geo = {"eu-west-1": "EU", "eu-west-2": "EU", "us-east-1": "US", "sa-east-1": "LATAM"}
    return flt.geo_restrict(t.session_logs, "analyst", geo).select("session_id")


@check("f8_purpose_filter_marketing", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT customer_id FROM consents WHERE purpose = 'marketing' AND granted)", "consents")
def _(t):
    return flt.purpose_filter(t.orders.withColumnRenamed("o_custkey", "customer_id"), t.consents, "marketing").select("o_orderkey")


@check("f8_purpose_filter_analytics", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT customer_id FROM consents WHERE purpose = 'analytics' AND NOT granted)", "consents")
def _(t):
    return flt.purpose_filter(t.orders.withColumnRenamed("o_custkey", "customer_id"), t.consents, "analytics").select("o_orderkey")


@check("f9_role_purpose_check", """SELECT request_id, purpose, (purpose = 'analytics' AND roles SIMILAR TO '.*(analyst|compliance_officer).*')
 OR (purpose IN ('profiling', 'marketing') AND contains(roles, 'compliance_officer')) AS purpose_allowed FROM access_requests""", "access_requests")
def _(t):
    return flt.role_purpose_check(t.access_requests.withColumn("roles", F.split("roles", ","))).select("request_id", "purpose", "purpose_allowed")


@check("f10_cross_border_filter", "SELECT request_id, destination, CASE destination WHEN 'UK' THEN 'adequacy_decision' WHEN 'US' THEN 'standard_contractual_clauses' ELSE 'internal' END AS mechanism FROM access_requests WHERE destination NOT IN ('UNKNOWN', 'APAC')", "access_requests")
def _(t):
    return flt.cross_border_check(flt.cross_border_filter(t.access_requests)).select("request_id", "destination", "mechanism")


@check("f11_column_deny", "SELECT id, name, country FROM customers_pii", C)
def _(t):
    return flt.column_deny(t.customers_pii.select("id", "name", "ssn", "email", "country"), ["ssn", "email"], "people", ["customers"])


@check("f12_exclude_classifications", "SELECT id, country FROM customers_pii", C)
def _(t):
    tags = {"ssn": ["PII", "SECRET"], "email": ["PII"], "api_key": ["SECRET"]}
    return flt.exclude_classifications(t.customers_pii.select("id", "ssn", "email", "api_key", "country"), tags, ["engineer"])


@check("f13_clearance_filter", """WITH r AS (SELECT *, list_position(['public','internal','confidential','restricted','top_secret'], clearance) AS a, list_position(['public','internal','confidential','restricted','top_secret'], dataset_clearance) AS b FROM access_requests)
 SELECT request_id, clearance, dataset_clearance FROM r WHERE a >= b""", "access_requests")
def _(t):
    return flt.clearance_filter(t.access_requests).select("request_id", "clearance", "dataset_clearance")


@check("f14_dedupe_sources", """SELECT provider, host, database, seq FROM (SELECT o_orderpriority AS provider, o_orderstatus AS host, o_custkey AS database, o_orderkey AS seq FROM orders)
 QUALIFY row_number() OVER (PARTITION BY provider, host, database ORDER BY seq) = 1""")
def _(t):
    rows = t.orders.selectExpr("o_orderpriority AS provider", "o_orderstatus AS host", "o_custkey AS database", "o_orderkey AS seq")
    return flt.dedupe_sources(rows, "seq")


@check("f15_filter_lineage", """SELECT table_id FROM catalog_tables WHERE schema_name IN ('sch1', 'sch2', 'sch3', 'sch4') AND schema_name <> 'sch3' AND (',' || tags || ',' LIKE '%,pii,%' OR ',' || tags || ',' LIKE '%,ops,%') AND owner IN ('team-1', 'team-2', 'team-4')""", "catalog_tables")
def _(t):
    nodes = t.catalog_tables.withColumn("tags", F.split("tags", ",")).withColumnRenamed("schema_name", "domain")
    return flt.filter_lineage(nodes, ["sch1", "sch2", "sch3", "sch4"], ["sch3"], ["pii", "ops"], ["team-1", "team-2", "team-4"]).select("table_id")


@check("e1_custom_mask", "SELECT id, reverse(api_key) AS api_key FROM customers_pii", C)
def _(t):
    m.register_mask("reversed", F.reverse)
    return red.apply_policies(t.customers_pii.select("id", "api_key"), [red.MaskPolicy("api_key", "reversed")])


@check("e2_sql_mask_function", "SELECT id, CASE WHEN country = 'NATION_1' THEN email ELSE '***' END AS email FROM customers_pii", C)
def _(t):
    fn = m.sql_mask(t.spark, "mask_unless_home", "value STRING, country STRING", "CASE WHEN country = 'NATION_1' THEN value ELSE '***' END")
    return t.customers_pii.select("id", fn(F.col("email"), F.col("country")).alias("email"))
