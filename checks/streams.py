"""Sources, sinks and streams. Streams run over the whole table with availableNow and append to Parquet."""

import datetime as dt

from pyspark.sql import functions as F

from checks.events import TTL_SQL
from checks.registry import check, rnd
from custodia.operators import events as ev
from custodia.schemas import SESSION_SCHEMA
from custodia.session import materialize, scratch_path, ship_package
from custodia.sources import sessions as src
from custodia.sources import listing
from custodia.sources import tables as tab
from custodia.streaming import streams as st

S = "session_logs"


def _written(t):
    path = scratch_path(t.spark, "sessions")
    src.write_sessions(t.session_logs, path)
    return path


@check("s1_read_sessions", "SELECT session_id, language, NULLIF(error_code, '') AS error_code, cost_usd, latency_ms, success, year, month, day FROM session_logs", S)
def _(t):
    return src.read_sessions(t.spark, _written(t)).select("session_id", "language", "error_code", "cost_usd", "latency_ms", "success", "year", "month", "day")


@check("s2_write_sessions", "SELECT year, month, day, COUNT(*) AS sessions FROM session_logs GROUP BY ALL", S)
def _(t):
    path = scratch_path(t.spark, "sessions-parquet")
    src.write_sessions(t.session_logs, path, "parquet")
    return src.read_sessions(t.spark, path, "parquet").groupBy("year", "month", "day").agg(F.count("*").alias("sessions"))


@check("s3_generate_sessions")
def _(t):
    return src.sessions_for(t.events.selectExpr("event_id AS id"), dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 31))


@check("s4_object_listing", "SELECT strftime(o_orderdate, 'y=%Y') AS folder, COUNT(*) > 0 AS has_files FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "listing")
    t.orders.withColumn("y", F.year("o_orderdate")).repartition("y").write.partitionBy("y").parquet(path)
    files = tab.object_listing(t.spark, path).where("path LIKE '%.parquet' AND size > 0")
    return files.groupBy(F.regexp_extract("path", "(y=[0-9]+)/", 1).alias("folder")).agg((F.count("*") > 0).alias("has_files"))


@check("s4_object_listing_partitions", "SELECT strftime(o_orderdate, 'y=%Y/m=%-m') AS folder, 1 AS files FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "listing")
    dated = t.orders.withColumns({"y": F.year("o_orderdate"), "m": F.month("o_orderdate")})
    dated.repartition("y", "m").write.partitionBy("y", "m").parquet(path)
    files = tab.object_listing(t.spark, path).where("path LIKE '%.parquet' AND size > 0 AND mtime > '2020-01-01'")
    return files.groupBy(F.regexp_extract("path", "(y=[0-9]+/m=[0-9]+)/", 1).alias("folder")).agg(F.count("*").cast("int").alias("files"))


@check("c4_crawl_tables", """SELECT t.table_name, column_name, ordinal, data_type, is_partition, n AS rows, 1 AS n_types FROM (VALUES
 ('orders', 'o_orderkey', 0, 'bigint', false), ('orders', 'o_custkey', 1, 'bigint', false), ('orders', 'price', 2, 'decimal(15,2)', false), ('orders', 'y', 1048576, 'string', true),
 ('customer', 'c_custkey', 0, 'bigint', false), ('customer', 'c_name', 1, 'string', false)) x(table_name, column_name, ordinal, data_type, is_partition)
 JOIN (SELECT 'orders' AS table_name, COUNT(*) AS n FROM orders UNION ALL SELECT 'customer', COUNT(*) FROM customer) t USING (table_name)""")
def _(t):
    root = scratch_path(t.spark, "warehouse")
    t.orders.selectExpr("CAST(o_orderkey AS BIGINT) AS o_orderkey", "CAST(o_custkey AS BIGINT) AS o_custkey", "CAST(o_totalprice AS DECIMAL(15,2)) AS price",
                        "year(o_orderdate) AS y").repartition("y").write.partitionBy("y").parquet(f"{root}/orders")
    t.customer.selectExpr("CAST(c_custkey AS BIGINT) AS c_custkey", "c_name").write.parquet(f"{root}/customer")
    found = listing.crawl_tables(t.spark, root)
    return found.select("table_name", "column_name", "ordinal", "data_type", "is_partition", "rows", F.col("n_types").cast("int").alias("n_types"))


@check("s5_read_table", "SELECT n_nationkey, n_name, COUNT(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def _(t):
    held = {"catalog://sales.customer": t.customer, "catalog://sales.nation": t.nation}
    c, n = (tab.read_table(t.spark, u, held) for u in held)
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.count("*").alias("customers"))


@check("s6_execute", "SELECT o_orderpriority, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY ALL")
def _(t):
    return tab.execute(t.spark, "SELECT o_orderpriority, COUNT(*) AS n, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM {orders} GROUP BY o_orderpriority", orders=t.orders)


@check("s7_export_result", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name FROM customer")
def _(t):
    path = scratch_path(t.spark, "export")
    tab.export_result(t.customer.select("c_custkey", "c_name"), path, "csv")
    return t.spark.read.option("header", "true").schema("c_custkey string, c_name string").csv(path)


@check("s8_archive", "SELECT CASE WHEN o_orderstatus = 'F' THEN 'financial' ELSE 'default' END AS retention_category, COUNT(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "archive")
    tab.archive(t.orders.withColumn("retention_category", F.expr("CASE WHEN o_orderstatus = 'F' THEN 'financial' ELSE 'default' END")), path)
    return t.spark.read.parquet(path).groupBy("retention_category").agg(F.count("*").alias("n"))


@check("s9_refresh_partitions", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS y, COUNT(*) AS n FROM orders GROUP BY 1")
def _(t):
    path = scratch_path(t.spark, "repair")
    name = "repair_" + path[-12:]
    t.spark.sql(f"CREATE TABLE {name} (o_orderkey BIGINT, y STRING) USING parquet PARTITIONED BY (y) LOCATION '{path}'")
    t.orders.selectExpr("o_orderkey", "CAST(year(o_orderdate) AS STRING) AS y").write.mode("append").partitionBy("y").parquet(path)
    tab.refresh_partitions(t.spark, name)
    return t.spark.table(name).groupBy("y").agg(F.count("*").alias("n"))


@check("s11_write_audit", "SELECT strftime(ts, '%Y-%m-%d') AS event_date, decision AS outcome, COUNT(*) AS n FROM audit_log GROUP BY 1, 2", "audit_log")
def _(t):
    path = scratch_path(t.spark, "audit")
    tab.write_audit(ev.audit_trail(provider=t.audit_log.selectExpr("ts AS timestamp", "user_id", "action", "resource", "decision", "CAST(audit_id AS STRING) AS trace_id")), path)
    return t.spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "outcome").agg(F.count("*").alias("n"))


@check("s12_read_any", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(t):
    path = scratch_path(t.spark, "any")
    t.customer.select("c_custkey", "c_name", "c_nationkey").write.orc(path)
    return tab.read_any(t.spark, path)


@check("e3_register_source", "SELECT r_name AS name, COUNT(*) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def _(t):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    # the rows travel as an option, so that a worker needs no access to the driver's files
    class Regions(DataSource):
        @classmethod
        def name(cls):
            return "custodia_regions"

        def schema(self):
            return "id bigint, name string"

        def reader(self, schema):
            return Reader(self.options["rows"])

    class Reader(DataSourceReader):
        def __init__(self, rows):
            self.rows = rows.split(";")

        def partitions(self):
            return [InputPartition(i) for i in range(len(self.rows))]

        def read(self, partition):
            key, _, name = self.rows[partition.value].partition(":")
            yield int(key), name

    tab.register_source(t.spark, Regions)
    rows = ";".join(f"{r.r_regionkey}:{r.r_name}" for r in t.region.collect())  # five regions, whatever the scale
    regions = t.spark.read.format("custodia_regions").option("rows", rows).load()
    return t.nation.join(regions, F.col("n_regionkey") == F.col("id")).groupBy("name").agg(F.count(F.lit(1)).alias("nations"))


@check("e3_register_source_files", "SELECT o_orderpriority, COUNT(*) AS orders, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY 1")
def _(t):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    # a partition is a row group of a file; its rows are read by the task and come as Arrow batches
    class RowGroups(DataSource):
        @classmethod
        def name(cls):
            return "custodia_row_groups"

        def schema(self):
            return "o_orderpriority string, price decimal(15,2)"

        def reader(self, schema):
            return Reader(self.options["path"], schema.fieldNames())

    class Reader(DataSourceReader):
        def __init__(self, path, columns):
            self.path, self.columns = path, columns

        def partitions(self):
            from pyarrow import parquet

            out = []
            for path, size, _, is_folder in listing.list_folder(self.path):
                if not is_folder and path.endswith(".parquet"):
                    store, inner, _ = listing.open_store(path)
                    with store.open_input_file(inner) as handle:
                        out += [InputPartition((path, i)) for i in range(parquet.ParquetFile(handle).num_row_groups)]
            return out

        def read(self, partition):
            from pyarrow import parquet

            path, group = partition.value
            store, inner, _ = listing.open_store(path)
            with store.open_input_file(inner) as handle:
                yield from parquet.ParquetFile(handle).iter_batches(row_groups=[group], columns=self.columns)

    path = scratch_path(t.spark, "orders")
    t.orders.selectExpr("o_orderpriority", "CAST(o_totalprice AS DECIMAL(15,2)) AS price").repartition(4).write.option("parquet.block.size", "262144").parquet(path)
    ship_package(t.spark)
    tab.register_source(t.spark, RowGroups)
    orders = t.spark.read.format("custodia_row_groups").load(path)
    return orders.groupBy("o_orderpriority").agg(F.count("*").alias("orders"), F.sum("price").alias("total"))


# streams


@check("s10_session_stream", "SELECT session_id, language, latency_ms FROM session_logs", S)
def _(t):
    return st.run_available(st.session_stream(t.spark, _written(t)).select("session_id", "language", "latency_ms"), "session-stream")


@check("t8_session_kpis_stream", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, CAST(substr(timestamp, 1, 19) AS TIMESTAMP)) AS s, * FROM session_logs), m AS (SELECT MAX(CAST(substr(timestamp, 1, 19) AS TIMESTAMP)) - INTERVAL 10 MINUTE AS mark FROM session_logs)
 SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, COUNT(*) AS sessions, SUM(cost_usd) AS total_cost, {rnd('AVG(latency_ms)', 4)} AS avg_latency_ms, {rnd('100.0 * CAST(SUM(success::INT) AS DOUBLE) / COUNT(*)', 1)} AS success_rate FROM w, m WHERE s + INTERVAL 1 HOUR <= mark GROUP BY s""", S)
def _(t):
    stream = t.stream("session_logs").withColumn("event_time", F.to_timestamp(F.substring("timestamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))
    out = st.run_available(st.session_kpis(stream), "kpis")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("window_start"), "sessions", "total_cost", F.round("avg_latency_ms", 4).alias("avg_latency_ms"), "success_rate")


@check("t9_ingest_sessions", "SELECT year, month, day, COUNT(*) AS sessions, SUM(cost_usd) AS cost FROM session_logs GROUP BY ALL", S)
def _(t):
    out = scratch_path(t.spark, "ingest")
    st.ingest_sessions(t.stream("session_logs"), f"{out}/data", f"{out}/checkpoint").awaitTermination()
    back = t.spark.read.schema(SESSION_SCHEMA).parquet(f"{out}/data")
    return back.groupBy("year", "month", "day").agg(F.count("*").alias("sessions"), F.sum("cost_usd").alias("cost"))


@check("t1_request_metrics_stream", f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, * FROM request_log), m AS (SELECT MAX(ts) - INTERVAL 5 MINUTE AS mark FROM request_log)
 SELECT strftime(s, '%Y-%m-%d %H:%M') AS window_start, agent, capability, COUNT(*) AS requests, COUNT(*) FILTER (WHERE status = 'ERROR') AS errors, {rnd("100.0 * COUNT(*) FILTER (WHERE status = 'ERROR') / COUNT(*)", 2)} AS error_rate, {rnd('SUM(duration_ms)', 2)} AS total_ms FROM w, m WHERE s + INTERVAL 1 HOUR <= mark GROUP BY s, agent, capability""", "request_log")
def _(t):
    stream = t.stream("request_log").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_available(st.request_metrics(stream, "1 hour"), "metrics")
    return out.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("window_start"), "agent", "capability", "requests", "errors", "error_rate", F.round(F.col("avg_ms") * F.col("requests"), 2).alias("total_ms"))


@check("t2_dedupe_requests_stream", TTL_SQL.format(key="agent || '/' || capability"), "request_log", recursive=True)
def _(t):
    stream = t.stream("request_log").withColumn("ts", F.col("ts").cast("timestamp"))
    return st.run_available(st.dedupe_requests(stream, F.concat_ws("/", "agent", "capability")), "dedupe")


@check("t3_health_transitions_stream", """WITH f AS (SELECT agent, seq, status, status <> 'UNHEALTHY' AS ok FROM health_checks),
 g AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seq) - row_number() OVER (PARTITION BY agent, ok ORDER BY seq) AS isl FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY agent, ok, isl ORDER BY seq) AS run FROM g),
 s AS (SELECT *, CASE WHEN ok AND run >= 2 THEN status WHEN NOT ok AND run >= 3 THEN 'UNHEALTHY' END AS sets FROM h),
 c AS (SELECT *, COALESCE(last_value(sets IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS cur FROM s),
 p AS (SELECT *, COALESCE(LAG(cur) OVER (PARTITION BY agent ORDER BY seq), 'UNKNOWN') AS prev FROM c)
 SELECT agent, seq, prev AS from_status, cur AS to_status FROM p WHERE cur <> prev""", "health_checks")
def _(t):
    return st.run_available(st.health_transitions(t.stream("health_checks")), "health").drop("average_ms")


def _late(t, df, key):
    """``df`` (with a timestamp ts) as a stream of five triggers: a fifth of the time each, but every fifth row comes one
    trigger late. The last trigger brings one more row, long after all others, which moves the watermark past them. The
    delay that admits the late rows, three tenths of the time, comes with it."""
    df, n = materialize(df.withColumn("__t", F.unix_micros("ts")), "late")
    ends = df.agg(F.min("__t").alias("a"), F.max("__t").alias("b")).first()
    trigger = F.floor((F.col("__t") - ends.a) * 5 / (ends.b - ends.a + 1)) + F.when(F.pmod(F.xxhash64("__t"), F.lit(5)) == 0, 1).otherwise(0)
    end = df.limit(1).withColumn("ts", F.expr("ts + INTERVAL 9000 DAYS")).withColumn(key, F.lit("~end")).withColumn("__trigger", F.lit(5))
    rows = df.withColumn("__trigger", F.least(trigger, F.lit(4)).cast("int")).unionByName(end).drop("__t")
    path = scratch_path(t.spark, "triggers")
    for i in range(6):
        rows.where(F.col("__trigger") == i).drop("__trigger").coalesce(1).write.parquet(f"{path}/{i}")
    schema = rows.drop("__trigger").schema
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*"), f"{(ends.b - ends.a) * 3 // 10_000_000 + 1} seconds"


@check("t2_dedupe_requests_stream_late", TTL_SQL.format(key="agent || '/' || capability"), "request_log", recursive=True)
def _(t):
    stream, delay = _late(t, t.request_log.withColumn("ts", F.col("ts").cast("timestamp")), "agent")
    return st.run_available(st.dedupe_requests_in_order(stream, F.concat_ws("/", "agent", "capability"), delay=delay), "dedupe-late")


@check("t3_health_transitions_stream_late", """WITH f AS (SELECT agent, seq, status, status <> 'UNHEALTHY' AS ok FROM health_checks),
 g AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seq) - row_number() OVER (PARTITION BY agent, ok ORDER BY seq) AS isl FROM f),
 h AS (SELECT *, row_number() OVER (PARTITION BY agent, ok, isl ORDER BY seq) AS run FROM g),
 s AS (SELECT *, CASE WHEN ok AND run >= 2 THEN status WHEN NOT ok AND run >= 3 THEN 'UNHEALTHY' END AS sets FROM h),
 c AS (SELECT *, COALESCE(last_value(sets IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS cur FROM s),
 p AS (SELECT *, COALESCE(LAG(cur) OVER (PARTITION BY agent ORDER BY seq), 'UNKNOWN') AS prev FROM c)
 SELECT agent, seq, prev AS from_status, cur AS to_status FROM p WHERE cur <> prev""", "health_checks")
def _(t):
    # the checks' own clock: one a minute, in the order of their numbers
    checks = t.health_checks.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq") * 60))
    stream, delay = _late(t, checks, "agent")
    return st.run_available(st.health_transitions_in_order(stream, delay=delay), "health-late").drop("average_ms")


@check("t5_audit_trail_stream", "SELECT user_id, action, resource, decision AS outcome, strftime(ts, '%Y-%m-%d') AS event_date FROM audit_log", "audit_log")
def _(t):
    stream = t.stream("audit_log").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_available(st.audit_trail(stream), "audit-stream")
    return out.select("user_id", "action", "resource", "outcome", F.col("event_date").cast("string").alias("event_date"))


@check("t6_pii_access_alerts_stream", "SELECT audit_id, CASE WHEN decision = 'deny' THEN 'high' ELSE 'info' END AS severity FROM audit_log WHERE resource = 'customers'", "audit_log")
def _(t):
    return st.run_available(st.pii_access_alerts(t.stream("audit_log"), {"customers": "PII"}), "alerts").select("audit_id", "severity")


@check("t10_rate_breaches_stream", """WITH m AS (SELECT MAX(ts) - INTERVAL 5 MINUTE AS mark FROM request_log)
 SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, caller, COUNT(*) AS requests FROM request_log, m WHERE time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR <= mark GROUP BY 1, 2 HAVING COUNT(*) > 1""", "request_log")
def _(t):
    stream = t.stream("request_log").withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_available(st.rate_breaches(stream, 1, "1 hour"), "rates")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))
