"""Catalog, classification, profiling, quality and storage layout."""

from pyspark.sql import functions as F

from checks.registry import check, rnd
from custodia.functions import masks
from custodia.operators import catalog as cat
from custodia.operators.ordered import top_per_key
from custodia.operators import layout as lay
from custodia.operators import profiling as prof

CT, CI, OL = "catalog_tables", "column_inventory", "object_listing"


def _tags(t):
    return t.catalog_tables.withColumn("tags", F.split("tags", ","))


@check("c1_search_catalog", """WITH s AS (SELECT table_name, description, least(1.0, (CASE WHEN lower(table_name) LIKE '%revenue%' THEN 0.8 ELSE 0 END) + (CASE WHEN lower(description) LIKE '%revenue%' THEN 0.5 ELSE 0 END)
 + (CASE WHEN tags LIKE '%revenue%' THEN 0.3 ELSE 0 END)) AS score FROM catalog_tables)
 SELECT table_name, 'table' AS type, description, CAST(score AS DOUBLE) AS score FROM s WHERE score > 0 ORDER BY score DESC, table_name LIMIT 10""", CT)
def _(t):
    return cat.search_catalog(_tags(t), "Revenue", 10)


@check("c2_search_glob", "SELECT table_id, table_name FROM catalog_tables WHERE catalog_name = 'cat0' AND lower(table_name) GLOB '*_log_?*'", CT)
def _(t):
    return cat.search_glob(t.catalog_tables, "*_LOG_?*", "cat0").select("table_id", "table_name")


@check("c3_search_substring", "SELECT t.table_id, t.table_name, COUNT(c.table_id) AS column_count FROM catalog_tables t LEFT JOIN column_inventory c USING (table_id) WHERE lower(t.table_name) LIKE '%customer%' GROUP BY ALL", f"{CT} {CI}")
def _(t):
    return cat.search_substring(t.catalog_tables, t.column_inventory, "Customer").select("table_id", "table_name", "column_count")


@check("c4_flatten_catalog", "SELECT 'catalog://' || schema_name || '.' || t.table_name AS uri, column_name, ordinal, data_type, COALESCE(column_name = partition_field, false) AS is_partition FROM catalog_tables t JOIN column_inventory c USING (table_id)", f"{CT} {CI}")
def _(t):
    return cat.flatten_catalog(t.catalog_tables, t.column_inventory)


@check("c4_build_catalog", """SELECT 'catalog://' || v AS uri, 'default' AS database, v AS table_name, c AS column_name, CAST(o AS INT) AS ordinal, k AS data_type, n AS rows_of_table FROM (VALUES
 ('c4_nation', 'n_nationkey', 0, 'bigint'), ('c4_nation', 'n_name', 1, 'string'), ('c4_region', 'r_regionkey', 0, 'bigint'), ('c4_region', 'r_name', 1, 'string')) x(v, c, o, k)
 JOIN (SELECT 'c4_nation' AS t, COUNT(*) AS n FROM nation UNION ALL SELECT 'c4_region', COUNT(*) FROM region) ON t = v""")
def _(t):
    views = {"c4_nation": t.nation.selectExpr("CAST(n_nationkey AS BIGINT) AS n_nationkey", "n_name"), "c4_region": t.region.selectExpr("CAST(r_regionkey AS BIGINT) AS r_regionkey", "r_name")}
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    found = cat.build_catalog(t.spark, ["default"]).where(F.col("table_name").isin(list(views)))
    counts = None
    for name, df in views.items():
        one = df.agg(F.count(F.lit(1)).alias("rows_of_table")).select(F.lit(name).alias("table_name"), "rows_of_table")
        counts = one if counts is None else counts.unionAll(one)
        t.spark.catalog.dropTempView(name)
    return found.join(counts, "table_name").select("uri", "database", "table_name", "column_name", "ordinal", "data_type", "rows_of_table")


@check("c5_normalize_types", """SELECT table_id, ordinal, data_type, CASE regexp_extract(data_type, '^[^(<]*') WHEN 'string' THEN 'STRING' WHEN 'int' THEN 'INTEGER' WHEN 'bigint' THEN 'BIGINT' WHEN 'double' THEN 'DOUBLE' WHEN 'timestamp' THEN 'TIMESTAMP'
 WHEN 'date' THEN 'DATE' WHEN 'decimal' THEN 'DECIMAL' WHEN 'array' THEN 'ARRAY' WHEN 'struct' THEN 'STRUCT' ELSE upper(data_type) END AS sql_type FROM column_inventory""", CI)
def _(t):
    return cat.normalize_types(t.column_inventory.select("table_id", "ordinal", "data_type"))


@check("c6_accessible_resources", "SELECT grant_id, resource FROM grants WHERE decision = 'ALLOW' AND principal = 'user-7' AND resource_type = 'table' AND catalog_name = 'cat1'", "grants")
def _(t):
    return cat.accessible_resources(t.grants, "user-7", "table", "cat1").select("grant_id", "resource")


_KW = [("revenue", "revenue"), ("sales", "revenue"), ("income", "revenue"), ("region", "regions"), ("geography", "regions"), ("country", "regions"),
       ("time", "time_periods"), ("month", "time_periods"), ("year", "time_periods"), ("quarter", "time_periods"), ("customer", "customers"),
       ("client", "customers"), ("transaction", "transactions"), ("purchase", "transactions"), ("order", "transactions")]


@check("c7_resolve_tables_from_text", "SELECT DISTINCT question_id, table_name FROM questions JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _KW) + ") k(word, table_name) ON contains(lower(question), word)", "questions")
def _(t):
    return cat.resolve_tables_from_text(t.questions)


@check("j1_star_join", "SELECT r_name, n_name, COUNT(*) AS orders, SUM(amount) AS total FROM revenue JOIN region ON region_id = r_regionkey JOIN customer ON customer_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL", "revenue")
def _(t):
    from custodia.operators.revenue import star_join
    out = star_join(t.revenue.select("amount", "region_id", "customer_id"), [(t.region, "region_id", "r_regionkey"), (t.customer, "customer_id", "c_custkey")])
    return out.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.sum("amount").alias("total"))


@check("j2_table_columns", "SELECT t.table_id, t.table_name, t.schema_name, c.column_name, c.data_type, c.nullable FROM catalog_tables t LEFT JOIN column_inventory c USING (table_id)", f"{CT} {CI}")
def _(t):
    return cat.table_columns(t.catalog_tables, t.column_inventory)


@check("j3_table_relationships", "SELECT a.table_name AS from_table, b.table_name AS to_table, o_orderpriority AS relationship FROM orders JOIN catalog_tables a ON a.table_id = o_custkey JOIN catalog_tables b ON b.table_id = o_orderkey % 140", CT)
def _(t):
    rel = t.orders.selectExpr("o_custkey AS from_table_id", "o_orderkey % 140 AS to_table_id", "o_orderpriority AS relationship")
    return cat.table_relationships(rel, t.catalog_tables)


_JOINS = "SELECT table_name || '.id' AS from_column, 'x_' || schema_name || '.key' AS to_column FROM catalog_tables"


@check("j4_relevant_joins", f"WITH j AS ({_JOINS}) SELECT * FROM j WHERE contains(from_column, 'orders') OR contains(to_column, 'orders') OR contains(from_column, 'sch7') OR contains(to_column, 'sch7')", CT)
def _(t):
    j = t.catalog_tables.selectExpr("concat(table_name, '.id') AS from_column", "concat('x_', schema_name, '.key') AS to_column")
    return cat.relevant_joins(j, ["orders", "sch7"])


@check("j4_relevant_joins_exact", f"WITH j AS ({_JOINS}) SELECT * FROM j WHERE split_part(from_column, '.', 1) IN ('orders', 'revenue') OR split_part(to_column, '.', 1) IN ('orders', 'revenue')", CT)
def _(t):
    j = t.catalog_tables.selectExpr("concat(table_name, '.id') AS from_column", "concat('x_', schema_name, '.key') AS to_column")
    return cat.relevant_joins(j, ["orders", "revenue"], exact=True)


_CATALOG = [("lake-0", "raw/"), ("lake-0", "events/"), ("lake-1", "raw/year=1996"), ("lake-1", "curated/1997"), ("lake-2", "")]
_CATSQL = "(VALUES " + ", ".join(f"('{b}', '{p}')" for b, p in _CATALOG) + ") k(kb, kp)"
_PFX = "SELECT DISTINCT regexp_extract(path, '^[a-z0-9]+://([^/]+)/', 1) AS bucket, regexp_extract(path, '^[a-z0-9]+://[^/]+/(.*/)?[^/]*$', 1) AS prefix FROM object_listing"


def _catalog(t):
    return t.spark.createDataFrame(_CATALOG, "bucket string, prefix string")


@check("j5_uncatalogued_prefixes", f"WITH p AS ({_PFX}) SELECT bucket, prefix FROM p WHERE NOT EXISTS (SELECT 1 FROM {_CATSQL} WHERE kb = bucket AND starts_with(prefix, kp))", OL)
def _(t):
    return lay.uncatalogued_prefixes(lay.prefixes(t.object_listing), _catalog(t))


_TARGETS = ["s3://lake-0/raw/year=1997/", "s3://lake-1/logs/", "s3://lake-2/curated/19980101/deep/inside", "s3://lake-3/events/dt=1999"]


@check("j6_not_covered", f"""WITH p AS ({_PFX}), q AS (SELECT 's3://' || bucket || '/' || prefix AS path FROM p)
 SELECT path FROM q WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{x}')" for x in _TARGETS)}) k(tp) WHERE starts_with(path, tp) OR starts_with(tp, path))""", OL)
def _(t):
    found = lay.prefixes(t.object_listing).select(F.concat(F.lit("s3://"), "bucket", F.lit("/"), "prefix").alias("path"))
    return lay.not_covered(found, t.spark.createDataFrame([(x,) for x in _TARGETS], "path string"))


_CONT = "SELECT 'acct' || CAST(p_partkey % 97 AS VARCHAR) AS account, CASE WHEN p_size % 9 = 0 THEN '$root' WHEN p_size % 9 = 1 THEN 'insights-logs' ELSE replace(p_name, ' ', '-') || '-' || CAST(p_partkey % 11 AS VARCHAR) END AS container, p_partkey AS position FROM part"
_SCAN = "SELECT 'src:HTTPS://Acct' || CAST(p_partkey % 97 AS VARCHAR) || '.blob.core.windows.net/' || replace(p_name, ' ', '-') || '-' || CAST(p_partkey % 11 AS VARCHAR) || '/f' AS qualified_name FROM part WHERE p_partkey % 3 = 0"


@check("j6_containers_to_scan", f"""WITH c AS ({_CONT}), s AS ({_SCAN}), f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY account ORDER BY position) <= 5),
 u AS (SELECT *, 'https://' || account || '.blob.core.windows.net/' || container AS path FROM f WHERE NOT starts_with(container, '$') AND container <> 'insights-logs')
 SELECT account, container, position, path FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(qualified_name), lower(path)))""")
def _(t):
    c = t.part.selectExpr("concat('acct', CAST(p_partkey % 97 AS STRING)) AS account",
                          "CASE WHEN p_size % 9 = 0 THEN '$root' WHEN p_size % 9 = 1 THEN 'insights-logs' ELSE concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey % 11 AS STRING)) END AS container", "p_partkey AS position")
    s = t.part.where("p_partkey % 3 = 0").selectExpr("concat('src:HTTPS://Acct', CAST(p_partkey % 97 AS STRING), '.blob.core.windows.net/', replace(p_name, ' ', '-'), '-', CAST(p_partkey % 11 AS STRING), '/f') AS qualified_name")
    # the reference's own cut, five containers of each account before anything else
    return lay.containers_to_scan(top_per_key(c, ["account"], [F.col("position"), F.col("container")], 5), s)


@check("j6_containers_to_scan_all", f"""WITH c AS ({_CONT}), s AS ({_SCAN}),
 u AS (SELECT *, 'https://' || account || '.blob.core.windows.net/' || container AS path FROM c WHERE NOT starts_with(container, '$') AND container <> 'insights-logs')
 SELECT account, container, position, path FROM u WHERE NOT EXISTS (SELECT 1 FROM s WHERE contains(lower(qualified_name), lower(path)))""")
def _(t):
    c = t.part.selectExpr("concat('acct', CAST(p_partkey % 97 AS STRING)) AS account",
                          "CASE WHEN p_size % 9 = 0 THEN '$root' WHEN p_size % 9 = 1 THEN 'insights-logs' ELSE concat(replace(p_name, ' ', '-'), '-', CAST(p_partkey % 11 AS STRING)) END AS container", "p_partkey AS position")
    s = t.part.where("p_partkey % 3 = 0").selectExpr("concat('src:HTTPS://Acct', CAST(p_partkey % 97 AS STRING), '.blob.core.windows.net/', replace(p_name, ' ', '-'), '-', CAST(p_partkey % 11 AS STRING), '/f') AS qualified_name")
    return lay.containers_to_scan(c, s)


_MAP = {"gcp:EMAIL_ADDRESS": "PII", "azure:Microsoft.Financial.Card": "PCI", "aws:payment data": "PCI", "databricks:SENSITIVE": "CONFIDENTIAL"}


@check("j7_normalize_classifications", "SELECT table_id, ordinal, provider, label, CASE " + " ".join(f"WHEN provider || ':' || label = '{k}' THEN '{v}'" for k, v in _MAP.items()) + " ELSE label END AS unified FROM column_inventory", CI)
def _(t):
    return cat.normalize_classifications(t.column_inventory.select("table_id", "ordinal", "provider", "label"), _MAP)


@check("j8_enrich_left", "SELECT c_custkey, c_mktsegment, customer_id, purpose, granted FROM customer LEFT JOIN consents ON c_custkey = customer_id AND granted", "consents")
def _(t):
    from custodia.operators.revenue import enrich_left
    left = t.customer.select("c_custkey", "c_mktsegment", F.col("c_custkey").alias("k"))
    right = t.consents.where("granted").withColumn("k", F.col("customer_id"))
    return enrich_left(left, right, "k").drop("k")


@check("j9_pii_columns_accessible", "SELECT table_name, column_name, classification FROM column_inventory WHERE classification IN ('PII', 'PHI', 'PCI') AND table_name IN (SELECT table_name FROM grants WHERE principal = 'user-8' AND decision = 'ALLOW' AND privilege IN ('SELECT', 'ALL'))", f"{CI} grants")
def _(t):
    return cat.pii_columns_accessible(t.column_inventory, t.grants, "user-8").select("table_name", "column_name", "classification")


@check("j10_foreign_key_check", "SELECT l_orderkey AS key, COUNT(*) AS orphan_rows FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY ALL")
def _(t):
    return cat.foreign_key_check(t.lineitem, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey")


# classification

_PII = " OR ".join(f"contains(column_name, '{w}')" for w in prof.PII_NAMES)
_SENS = " OR ".join(f"contains(column_name, '{w}')" for w in prof.SENSITIVE_NAMES)


@check("p1_classify_by_name", f"SELECT table_id, ordinal, column_name, concat_ws('+', CASE WHEN {_PII} THEN 'PII' END, CASE WHEN {_SENS} THEN 'SENSITIVE' END) AS tags FROM column_inventory", CI)
def _(t):
    return prof.classify_by_name(t.column_inventory.select("table_id", "ordinal", "column_name")).withColumn("tags", F.array_join("tags", "+"))


@check("p2_classify_by_suffix", """WITH c AS (SELECT table_id, ordinal, column_name, CASE WHEN ends_with(column_name, '_id') THEN 'PII' WHEN ends_with(column_name, '_hash') THEN 'PSEUDONYMIZED'
 WHEN regexp_matches(column_name, '^(cost|price|amount|revenue)') THEN 'FINANCIAL' ELSE 'GENERAL' END AS classification FROM column_inventory)
 SELECT *, CASE classification WHEN 'PII' THEN 'high' WHEN 'GENERAL' THEN 'low' ELSE 'medium' END AS sensitivity FROM c""", CI)
def _(t):
    return prof.classify_by_suffix(t.column_inventory.select("table_id", "ordinal", "column_name"))


@check("p3_classify_tables", "SELECT table_name, COALESCE((['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'PII', 'RESTRICTED'])[MAX(CASE classification WHEN 'PUBLIC' THEN 1 WHEN 'INTERNAL' THEN 2 WHEN 'CONFIDENTIAL' THEN 3 WHEN 'PII' THEN 4 WHEN 'RESTRICTED' THEN 5 END)], 'UNCLASSIFIED') AS classification FROM column_inventory WHERE ordinal < 3 GROUP BY table_name", CI)
def _(t):
    return prof.classify_tables(t.column_inventory.where("ordinal < 3"))


@check("p3_classify_tables_all", "SELECT table_name, COALESCE((['PUBLIC', 'INTERNAL', 'CONFIDENTIAL', 'PII', 'RESTRICTED'])[MAX(CASE classification WHEN 'PUBLIC' THEN 1 WHEN 'INTERNAL' THEN 2 WHEN 'CONFIDENTIAL' THEN 3 WHEN 'PII' THEN 4 WHEN 'RESTRICTED' THEN 5 END)], 'UNCLASSIFIED') AS classification FROM column_inventory GROUP BY table_name", CI)
def _(t):
    return prof.classify_tables(t.column_inventory)


@check("p4_infer_levels", """SELECT table_id, ordinal, provider, label, CASE provider
 WHEN 'aws' THEN CASE WHEN regexp_matches(l, 'pii|personal|ssn|email') THEN 'PII' WHEN regexp_matches(l, 'phi|health|medical') THEN 'PHI' WHEN regexp_matches(l, 'pci|card|payment') THEN 'PCI' WHEN regexp_matches(l, 'restricted|secret|credential') THEN 'RESTRICTED'
  WHEN regexp_matches(l, 'confidential|financial') THEN 'CONFIDENTIAL' WHEN contains(l, 'internal') THEN 'INTERNAL' ELSE 'PUBLIC' END
 WHEN 'azure' THEN CASE WHEN starts_with(l, 'microsoft.personal') THEN 'PII' WHEN starts_with(l, 'microsoft.financial') THEN 'CONFIDENTIAL' WHEN regexp_matches(l, 'pii|personal|ssn|email') THEN 'PII' WHEN regexp_matches(l, 'phi|health') THEN 'PHI'
  WHEN regexp_matches(l, 'pci|card|payment') THEN 'PCI' WHEN contains(l, 'confidential') THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END
 WHEN 'gcp' THEN CASE WHEN l = 'email_address' THEN 'PII' WHEN l = 'credit_card_number' THEN 'PCI' WHEN l = 'medical_record_number' THEN 'PHI' WHEN regexp_matches(l, 'pii|personal') THEN 'PII' WHEN regexp_matches(l, 'phi|health') THEN 'PHI' WHEN regexp_matches(l, 'pci|card|payment') THEN 'PCI'
  WHEN regexp_matches(l, 'restricted|secret') THEN 'RESTRICTED' WHEN contains(l, 'confidential') THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END
 ELSE CASE WHEN l = 'sensitive' THEN 'CONFIDENTIAL' WHEN l = 'secret' THEN 'RESTRICTED' WHEN l = 'public' THEN 'PUBLIC' WHEN regexp_matches(l, 'pii|personal|ssn|social security') THEN 'PII' WHEN regexp_matches(l, 'phi|health|medical|hipaa') THEN 'PHI'
  WHEN regexp_matches(l, 'pci|credit card|payment') THEN 'PCI' WHEN regexp_matches(l, 'restricted|secret|credential') THEN 'RESTRICTED' WHEN regexp_matches(l, 'confidential|sensitive') THEN 'CONFIDENTIAL' ELSE 'INTERNAL' END END AS level
 FROM (SELECT *, lower(label) AS l FROM column_inventory)""", CI)
def _(t):
    return prof.infer_levels(t.column_inventory.select("table_id", "ordinal", "provider", "label"))


@check("p5_sensitive_columns", "SELECT table_id, column_name FROM column_inventory WHERE classification IN ('PII', 'RESTRICTED') AND ordinal > 0", CI)
def _(t):
    rows = t.column_inventory.selectExpr("table_id", "CASE WHEN ordinal > 0 THEN column_name END AS column_name", "classification")
    return prof.sensitive_columns(rows.where("classification IN ('PII', 'RESTRICTED')")).select("table_id", "column_name")


_LUHN = """(list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(d, 17 - i, 1) AS INT) * 2 % 10 + CAST(substr(d, 17 - i, 1) AS INT) * 2 // 10 ELSE CAST(substr(d, 17 - i, 1) AS INT) END)) % 10 = 0)"""


def _scan(detector, pattern):
    if detector == "CREDIT_CARD_NUMBER":
        n = f"len(list_filter(list_transform(regexp_extract_all(text, '{pattern}'), lambda m: regexp_replace(m, '[^0-9]', '', 'g')), lambda d: {_LUHN}))"
    else:
        n = f"len(regexp_extract_all(text, '{pattern}'))"
    return f"SELECT 'text' AS column_name, '{detector}' AS detector, COUNT(*) FILTER (WHERE n > 0) AS rows_matched, CAST(SUM(n) AS BIGINT) AS matches FROM (SELECT {n} AS n FROM documents)"


@check("p6_scan_sensitive_values", " UNION ALL ".join(_scan(d, p) for d, p in prof.DETECTORS.items()))
def _(t):
    return prof.scan_sensitive_values(t.documents, ["text"])


@check("p7_classify_by_policy", """SELECT table_name, column_name, CASE WHEN column_name IN ('email', 'phone', 'ssn') THEN 'RESTRICTED' WHEN table_name = 'customers' AND column_name = 'name' THEN 'RESTRICTED'
 WHEN column_name IN ('birth_date', 'ip_address', 'location_data') THEN 'SENSITIVE' END AS handling
 FROM (SELECT CASE WHEN table_id % 7 = 0 THEN 'customers' ELSE table_name END AS table_name, CASE column_name WHEN 'customers_name' THEN 'name' WHEN 'user_email' THEN 'email' ELSE column_name END AS column_name FROM column_inventory)""", CI)
def _(t):
    rows = t.column_inventory.selectExpr("CASE WHEN table_id % 7 = 0 THEN 'customers' ELSE table_name END AS table_name",
                                         "CASE column_name WHEN 'customers_name' THEN 'name' WHEN 'user_email' THEN 'email' ELSE column_name END AS column_name")
    return prof.classify_by_policy(rows)


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]


def _stat(c):
    v = f"CAST({c} AS DOUBLE)"
    return f"""SELECT '{c}' AS column_name, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count, {rnd(f'100.0 * (COUNT(*) - COUNT({c})) / COUNT(*)', 4)} AS null_percentage, MIN({v}) AS min_value, MAX({v}) AS max_value,
 {rnd(f'AVG({v})', 4)} AS mean, {rnd(f'stddev_samp({v})', 4)} AS stddev, COUNT(DISTINCT {c}) AS distinct_count, {rnd(f'quantile_cont({v}, 0.5)', 4)} AS median FROM s"""


@check("p8_column_statistics", "WITH s AS (SELECT l_quantity, l_linenumber, l_discount, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_extendedprice END AS l_extendedprice FROM lineitem) " + " UNION ALL ".join(_stat(c) for c in _NUM))
def _(t):
    rows = t.lineitem.withColumn("l_extendedprice", F.expr("CASE WHEN l_tax > 0.07 THEN NULL ELSE l_extendedprice END"))
    out = prof.column_statistics(rows, _NUM, exact=True)
    return out.select("column_name", "row_count", "null_count", "null_percentage", "min_value", "max_value", "distinct_count",
                      *[F.round(c, 4).alias(c) for c in ("mean", "stddev", "median")])


@check("p9_sample_values", """SELECT 'country' AS column_name, COUNT(DISTINCT country) AS cardinality, array_to_string(list_sort(list_distinct(list(country)))[1:4], ',') AS samples FROM customers_pii
 UNION ALL SELECT 'ssn', COUNT(DISTINCT ssn), array_to_string(list_transform(list_sort(list_distinct(list(ssn)))[1:4], lambda x: '***-**-' || right(x, 4)), ',') FROM customers_pii""", "customers_pii")
def _(t):
    return prof.sample_values(t.customers_pii, ["country", "ssn"], 4, {"ssn": masks.mask_ssn}).withColumn("samples", F.array_join("samples", ","))


_RULES = [prof.Constraint("l_quantity", "min", 2), prof.Constraint("l_discount", "max", 0.09), prof.Constraint("l_returnflag", "allowed", ["A", "N", "R"]),
          prof.Constraint("l_linestatus", "pattern", "^[OF]$"), prof.Constraint("l_tax", "not_null")]


@check("p10_quality_metrics", f"""WITH l AS (SELECT l_orderkey, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS l_tax, l_quantity, l_discount, l_returnflag, l_linestatus, l_shipdate FROM lineitem)
 SELECT {rnd('100.0 * (COUNT(l_orderkey) + COUNT(l_tax) + COUNT(l_quantity) + COUNT(l_discount) + COUNT(l_returnflag) + COUNT(l_linestatus) + COUNT(l_shipdate)) / (COUNT(*) * 7)', 4)} AS completeness,
 {rnd("100.0 * COUNT(*) FILTER (WHERE NOT (l_quantity < 2 OR l_discount > 0.09 OR l_returnflag NOT IN ('A', 'N', 'R') OR l_linestatus NOT IN ('O', 'F') OR l_tax IS NULL)) / COUNT(*)", 4)} AS accuracy,
 {rnd("(epoch(TIMESTAMP '2002-01-01') - epoch(MAX(l_shipdate))) / 3600.0", 4)} AS freshness_hours,
 {rnd("100.0 * COUNT(*) FILTER (WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) / COUNT(l_orderkey)", 4)} AS consistency FROM l""")
def _(t):
    rows = t.lineitem.selectExpr("l_orderkey", "CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS l_tax", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    return prof.quality_metrics(rows, _RULES, "l_orderkey", t.orders.where("o_orderstatus <> 'P'"), "o_orderkey", "l_shipdate", F.lit("2002-01-01").cast("timestamp_ntz"))


@check("p11_validate_constraints", """SELECT 'l_quantity:min' AS rule, COUNT(*) FILTER (WHERE l_quantity < 2) AS violations FROM lineitem UNION ALL SELECT 'l_discount:max', COUNT(*) FILTER (WHERE l_discount > 0.09) FROM lineitem
 UNION ALL SELECT 'l_returnflag:allowed', COUNT(*) FILTER (WHERE l_returnflag NOT IN ('A', 'N', 'R')) FROM lineitem UNION ALL SELECT 'l_linestatus:pattern', COUNT(*) FILTER (WHERE NOT regexp_matches(l_linestatus, '^[OF]$')) FROM lineitem
 UNION ALL SELECT 'l_tax:not_null', COUNT(*) FILTER (WHERE l_tax IS NULL) FROM lineitem""")
def _(t):
    return prof.validate_constraints(t.lineitem, _RULES)


@check("p11_violating_rows", "SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN l_quantity < 2 THEN 'l_quantity:min' END, CASE WHEN l_discount > 0.09 THEN 'l_discount:max' END) AS violations FROM lineitem WHERE l_quantity < 2 OR l_discount > 0.09")
def _(t):
    return prof.violating_rows(t.lineitem, _RULES).select("l_orderkey", "l_linenumber", F.array_join("violations", ",").alias("violations"))


_OLD = "SELECT DISTINCT table_name, column_name, data_type FROM column_inventory WHERE ordinal < 8 QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY data_type) = 1"
_NEW = "SELECT DISTINCT table_name, column_name, CASE WHEN ordinal % 3 = 0 THEN 'string' ELSE data_type END AS data_type FROM column_inventory WHERE ordinal > 1 QUALIFY row_number() OVER (PARTITION BY table_name, column_name ORDER BY data_type) = 1"


@check("p12_schema_diff", f"""WITH a AS ({_OLD}), b AS ({_NEW}), x AS (SELECT COALESCE(a.table_name, b.table_name) AS table_name, COALESCE(a.column_name, b.column_name) AS column_name, a.data_type AS old_type, b.data_type AS new_type
 FROM a FULL JOIN b ON a.table_name = b.table_name AND a.column_name = b.column_name)
 SELECT *, CASE WHEN old_type IS NULL THEN 'added' WHEN new_type IS NULL THEN 'removed' ELSE 'type_changed' END AS change FROM x WHERE old_type IS DISTINCT FROM new_type""", CI)
def _(t):
    old = t.column_inventory.where("ordinal < 8").groupBy("table_name", "column_name").agg(F.min("data_type").alias("data_type"))
    new = t.column_inventory.where("ordinal > 1").withColumn("data_type", F.expr("CASE WHEN ordinal % 3 = 0 THEN 'string' ELSE data_type END")).groupBy("table_name", "column_name").agg(F.min("data_type").alias("data_type"))
    return prof.schema_diff(old, new)


@check("p13_catalog_rollup", """WITH n AS (SELECT table_id, COUNT(*) AS k FROM column_inventory GROUP BY 1)
 SELECT catalog_name, schema_name, CAST(GROUPING(catalog_name) * 2 + GROUPING(schema_name) AS BIGINT) AS level_id, COUNT(*) AS datasets, COUNT(*) FILTER (WHERE table_type = 'TABLE') AS tables, COUNT(*) FILTER (WHERE table_type = 'VIEW') AS views,
 CAST(COALESCE(SUM(k), 0) AS BIGINT) AS columns, CAST(SUM(bytes) AS BIGINT) AS bytes FROM catalog_tables LEFT JOIN n USING (table_id) GROUP BY ROLLUP (catalog_name, schema_name)""", f"{CT} {CI}")
def _(t):
    return prof.catalog_rollup(t.catalog_tables, t.column_inventory)


@check("p13_assets_by_type", "SELECT table_type, COUNT(*) AS assets FROM catalog_tables GROUP BY 1 ORDER BY assets DESC, table_type LIMIT 5", CT)
def _(t):
    return prof.assets_by_type(t.catalog_tables, 5)


@check("p13_largest_tables", "SELECT table_id, table_name, bytes FROM catalog_tables WHERE bytes > 0 ORDER BY bytes DESC, table_id LIMIT 5", CT)
def _(t):
    return prof.largest_tables(t.catalog_tables, 5)


# layout

def _branches():
    out = []
    for rx, groups, column, kind, grain in lay.PATH_PATTERNS:
        parts = " || '/' || ".join(f"regexp_extract(path, '{rx}', {g})" for g in range(1, groups + 1))
        out.append(f"WHEN regexp_matches(path, '{rx}') THEN {{'c': '{column}', 't': '{kind}', 'g': '{grain}', 's': {parts}, 'h': {'true' if '=' in rx else 'false'}}}")
    return "CASE " + " ".join(out) + " END"


_D1 = f"SELECT path, {_branches()} AS p FROM object_listing"


@check("d1_detect_path_partition", f"SELECT path, p.c AS column_name, p.t AS partition_type, p.g AS granularity, p.s AS samples, p.h AS is_hive_style FROM ({_D1}) WHERE p IS NOT NULL", OL)
def _(t):
    return lay.detect_path_partition(t.object_listing.select("path")).withColumn("samples", F.array_join("samples", ","))


@check("d2_partition_cardinality", f"SELECT p.c AS column_name, p.t AS partition_type, COUNT(DISTINCT p.s) AS cardinality, array_to_string(list_sort(list_distinct(list(p.s)))[1:10], ',') AS samples FROM ({_D1}) WHERE p IS NOT NULL GROUP BY 1, 2", OL)
def _(t):
    return lay.partition_cardinality(t.object_listing.select("path")).withColumn("samples", F.array_join("samples", ","))


def _any(c, words):
    return " OR ".join(f"contains({c}, '{w}')" for w in words)


_D3 = " UNION ALL ".join(
    [f"SELECT table_id, column_name, ordinal, 'DATE' AS partition_type, 'DAILY' AS granularity, 0 AS rule FROM column_inventory WHERE {_any('data_type', ['date', 'timestamp'])}"]
    + [f"SELECT table_id, column_name, ordinal, '{k}', {repr(g) if g else 'NULL'}, {i + 1} FROM column_inventory WHERE {_any('column_name', w)}" for i, (w, k, g) in enumerate(lay.NAME_PATTERNS)])


@check("d3_detect_schema_partitions", _D3, CI)
def _(t):
    return lay.detect_schema_partitions(t.column_inventory.select("table_id", "column_name", "ordinal", "data_type")).drop("data_type")


_D4IN = f"""d AS ({_D3}), i AS (SELECT 'tbl_' || CAST(table_id AS VARCHAR) AS dataset, table_id, ordinal * 10 + rule AS position, column_name, partition_type, CASE WHEN table_id % 4 = 0 THEN NULL ELSE granularity END AS granularity, CASE WHEN table_id % 2 = 0 THEN 12 ELSE 500 END AS cardinality FROM d),
 s AS (SELECT dataset, any_value(table_id) * 7.0 AS size_gb FROM i GROUP BY 1),
 f AS (SELECT i.*, s.size_gb, partition_type <> 'LIST' AS isdate FROM i JOIN s USING (dataset)),
 g AS (SELECT dataset, list(column_name ORDER BY position, column_name) FILTER (WHERE isdate) AS dates, list(column_name ORDER BY position, column_name) FILTER (WHERE NOT isdate) AS lists,
  list(granularity ORDER BY position, column_name) FILTER (WHERE isdate AND granularity IS NOT NULL) AS known, any_value(size_gb) AS size_gb FROM f GROUP BY 1),
 h AS (SELECT *, COALESCE(known[1], CASE WHEN size_gb > 1000 THEN 'HOURLY' WHEN size_gb > 10 THEN 'DAILY' WHEN size_gb > 0 THEN 'MONTHLY' ELSE 'DAILY' END) AS grain FROM g)"""


@check("d4_recommend_partitioning", f"""WITH {_D4IN}
 SELECT dataset, 'HIVE_STYLE' AS partition_type, array_to_string(dates, ',') AS columns, grain AS granularity FROM h WHERE len(dates) > 0
 UNION ALL SELECT dataset, 'LIST', column_name, NULL FROM f WHERE NOT isdate AND cardinality < 100
 UNION ALL SELECT dataset, 'COMPOSITE', dates[1] || ',' || lists[1], grain FROM h WHERE len(dates) > 0 AND len(lists) > 0""", CI)
def _(t):
    d = lay.detect_schema_partitions(t.column_inventory.select("table_id", "column_name", "ordinal", "data_type"))
    d = d.selectExpr("concat('tbl_', CAST(table_id AS STRING)) AS dataset", "table_id", "ordinal * 10 + rule AS position", "column_name", "partition_type",
                     "CASE WHEN table_id % 4 = 0 THEN NULL ELSE granularity END AS granularity", "CASE WHEN table_id % 2 = 0 THEN 12 ELSE 500 END AS cardinality")
    sizes = d.groupBy("dataset").agg((F.max("table_id") * 7.0).alias("size_gb"))
    return lay.recommend_partitioning(d, sizes).withColumn("columns", F.array_join("columns", ","))


@check("d5_suggest_clustering", """WITH c AS (SELECT table_id, list(column_name ORDER BY ordinal) FILTER (WHERE d)[1] AS dt, list(column_name ORDER BY ordinal) FILTER (WHERE NOT d AND column_name IN ('id', 'user_id', 'customer_id', 'account_id', 'event_id'))[1] AS id,
 list(column_name ORDER BY ordinal) FILTER (WHERE NOT d AND column_name IN ('region', 'country', 'type', 'status', 'category'))[1] AS cat FROM (SELECT *, contains(data_type, 'date') OR contains(data_type, 'timestamp') AS d FROM column_inventory) GROUP BY 1)
 SELECT table_id, table_name, CASE WHEN dt IS NOT NULL THEN concat_ws(', ', dt, cat) ELSE id END AS suggested_key, CASE WHEN dt IS NOT NULL THEN 'time series' ELSE 'point lookups' END AS reason
 FROM catalog_tables JOIN c USING (table_id) WHERE clustering_key IS NULL AND (bytes = 0 OR bytes >= 1000000000) AND COALESCE(dt, id) IS NOT NULL""", f"{CT} {CI}")
def _(t):
    return lay.suggest_clustering(t.catalog_tables, t.column_inventory)


_FMT = "CASE WHEN contains(path, '_delta_log') THEN 'delta' WHEN ends_with(path, '.parquet') THEN 'parquet' WHEN ends_with(path, '.json') OR ends_with(path, '.jsonl') THEN 'json' WHEN ends_with(path, '.csv') THEN 'csv' WHEN ends_with(path, '.avro') THEN 'avro' WHEN ends_with(path, '.orc') THEN 'orc' END"


@check("d6_detect_formats", f"SELECT split_part(path, '/', 3) AS bucket, split_part(path, '/', 4) AS prefix, string_agg(DISTINCT {_FMT}, ',' ORDER BY {_FMT}) AS formats, COUNT(*) AS objects FROM object_listing GROUP BY 1, 2", OL)
def _(t):
    return lay.detect_formats(t.object_listing).withColumn("formats", F.array_join("formats", ","))


@check("d7_dataset_sizes", "SELECT split_part(path, '/', 3) AS bucket, regexp_extract(path, '^[a-z0-9]+://[^/]+/(.*/)?[^/]*$', 1) AS prefix, CAST(SUM(size) AS BIGINT) AS bytes, COUNT(*) AS objects, CAST(SUM(size) AS DOUBLE) / 1073741824.0 AS size_gb FROM object_listing GROUP BY 1, 2", OL)
def _(t):
    return lay.dataset_sizes(t.object_listing)


@check("d8_catalog_gap_suggestions", f"""WITH p AS ({_PFX}), u AS (SELECT bucket, prefix FROM p WHERE NOT EXISTS (SELECT 1 FROM {_CATSQL} WHERE kb = bucket AND starts_with(prefix, kp))),
 v AS (SELECT *, 's3://' || bucket || '/' || prefix AS path FROM u),
 f AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{x}')" for x in _TARGETS)}) k(tp) WHERE starts_with(path, tp) OR starts_with(tp, path)) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY prefix) <= 3)
 SELECT bucket, prefix, path, substr(lower(regexp_replace(regexp_replace(regexp_replace(bucket || '_' || prefix, '/+$', ''), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')), 1, 128) AS database_name
 FROM f""", OL)
def _(t):
    return lay.catalog_gap_suggestions(t.object_listing, _catalog(t), t.spark.createDataFrame([(x,) for x in _TARGETS], "path string"), 3)


@check("d8_catalog_gap_suggestions_all", f"""WITH p AS ({_PFX}), u AS (SELECT bucket, prefix FROM p WHERE NOT EXISTS (SELECT 1 FROM {_CATSQL} WHERE kb = bucket AND starts_with(prefix, kp))),
 f AS (SELECT *, 's3://' || bucket || '/' || prefix AS path FROM u)
 SELECT bucket, prefix, path, lower(regexp_replace(regexp_replace(regexp_replace(bucket || '_' || prefix, '/+$', ''), '[^a-zA-Z0-9_]', '_', 'g'), '_+', '_', 'g')) AS database_name
 FROM f WHERE NOT EXISTS (SELECT 1 FROM (VALUES {', '.join(f"('{x}')" for x in _TARGETS)}) k(tp) WHERE starts_with(path, tp) OR starts_with(tp, path))""", OL)
def _(t):
    return lay.catalog_gap_suggestions(t.object_listing, _catalog(t), t.spark.createDataFrame([(x,) for x in _TARGETS], "path string"))


@check("d9_stale_jobs", "SELECT o_orderkey AS job FROM orders WHERE date_diff('second', o_orderdate, TIMESTAMP '2000-01-01') // 86400 > 30")
def _(t):
    jobs = t.orders.selectExpr("o_orderkey AS job", "o_orderdate AS last_run")
    return lay.stale_jobs(jobs, F.lit("2000-01-01").cast("timestamp_ntz")).select("job")


@check("d10_unpartitioned_large_tables", "SELECT table_id, bytes FROM catalog_tables WHERE table_type = 'TABLE' AND partition_field IS NULL AND bytes > 1000000000", CT)
def _(t):
    return lay.unpartitioned_large_tables(t.catalog_tables).select("table_id", "bytes")


@check("d10_tables_without_policy_tags", "SELECT table_id FROM catalog_tables WHERE NOT has_policy_tags AND row_count > 0", CT)
def _(t):
    return lay.tables_without_policy_tags(t.catalog_tables).select("table_id")


@check("d11_write_with_layout", "SELECT strftime(o_orderdate, '%Y') AS year, strftime(o_orderdate, '%m') AS month, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY ALL")
def _(t):
    from custodia.session import scratch_path
    path = scratch_path(t.spark, "layout")
    lay.write_with_layout(t.orders, path, "o_orderdate", "MONTHLY", ["o_orderstatus"], ["o_custkey"])
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("year").cast("string").alias("year"), F.lpad(F.col("month").cast("string"), 2, "0").alias("month"), "o_orderstatus").agg(F.count("*").alias("n"))


@check("d12_columnar_advice", f"WITH x AS (SELECT 'b' || CAST(l_suppkey % 40 AS VARCHAR) AS bucket, CASE WHEN l_suppkey % 3 = 0 AND path_no % 5 = 0 THEN 'parquet' WHEN path_no % 2 = 0 THEN 'json' ELSE 'csv' END AS f FROM (SELECT l_suppkey, l_orderkey AS path_no FROM lineitem)) SELECT bucket, string_agg(DISTINCT f, ',' ORDER BY f) AS formats FROM x GROUP BY 1 HAVING NOT bool_or(f = 'parquet')")
def _(t):
    listing = t.lineitem.selectExpr("concat('s3://b', CAST(l_suppkey % 40 AS STRING), '/d/x', CASE WHEN l_suppkey % 3 = 0 AND l_orderkey % 5 = 0 THEN '.parquet' WHEN l_orderkey % 2 = 0 THEN '.json' ELSE '.csv' END) AS path")
    return lay.columnar_advice(lay.detect_formats(listing)).withColumn("formats", F.array_join("formats", ","))
