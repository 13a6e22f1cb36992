"""Session and revenue reports."""

from pyspark.sql import functions as F

from checks.registry import check, rnd
from custodia.operators import aggregates as agg
from custodia.operators import filters, ordered, quantiles, revenue
from custodia.operators import session_reports as sr
from custodia.operators import sketches as sk
from custodia.session import scratch_path

S = "session_logs"
COST = f"{rnd('SUM(cost_usd)', 4)}"
AVGC = f"{rnd('CAST(SUM(cost_usd) AS DOUBLE) / COUNT(*)', 6)}"
FAM = "COUNT(DISTINCT family_id_hash)"
KID = "COUNT(DISTINCT child_id_hash)"
LAT = rnd("AVG(latency_ms)", 2)
LAT0 = rnd("AVG(latency_ms)", 0)
DUR = rnd("AVG(duration_seconds)", 2)
RATE1 = rnd("100.0 * CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)", 1)
RATE2 = rnd("100.0 * CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)", 2)
TIN, TOUT = "CAST(SUM(input_tokens) AS BIGINT)", "CAST(SUM(output_tokens) AS BIGINT)"
TALL = "CAST(SUM(input_tokens + output_tokens) AS BIGINT)"
SHARE = rnd("100.0 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()", 1)
P1K = rnd("CAST(SUM(cost_usd) AS DOUBLE) / NULLIF(CAST(SUM(input_tokens + output_tokens) AS DOUBLE), 0) * 1000", 6)
DAY = "concat(year, '-', month, '-', day)"


@check("a1_session_count", f"SELECT language, source, COUNT(*) AS sessions, {FAM} AS unique_families FROM session_logs GROUP BY ALL ORDER BY sessions DESC, language, source LIMIT 50", S)
def _(t):
    return sr.session_count(t.session_logs, ["language", "source"], limit=50)


@check("a1_session_count_january_week", f"SELECT region, COUNT(*) AS sessions, {FAM} AS unique_families FROM session_logs WHERE year = '2024' AND month = '01' AND day BETWEEN '08' AND '14' GROUP BY ALL ORDER BY sessions DESC, region LIMIT 50", S)
def _(t):
    return sr.session_count(t.session_logs, ["region"], filters.partition_range("2024-01-08", "2024-01-14"), 50)


@check("a2_session_totals", f"SELECT COUNT(*) AS total_sessions, {FAM} AS unique_families, {KID} AS unique_children FROM session_logs", S)
def _(t):
    return sr.session_totals(t.session_logs)


@check("a3_session_totals_cost", f"SELECT COUNT(*) AS total_sessions, {FAM} AS unique_families, {KID} AS unique_children, {COST} AS total_cost_usd FROM session_logs", S)
def _(t):
    return sr.session_totals_cost(t.session_logs)


@check("a4_cost_analysis", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost, {AVGC} AS avg_cost_per_session, {TIN} AS total_input_tokens, {TOUT} AS total_output_tokens, {P1K} AS cost_per_1k_tokens FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.cost_analysis(t.session_logs)


@check("a5_cost_by_model", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost, {AVGC} AS avg_cost, {TIN} AS total_input_tokens, {TOUT} AS total_output_tokens FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.cost_by_model(t.session_logs)


_LATQ = f"SELECT model_name, language, COUNT(*) AS sessions, {LAT} AS avg_latency_ms, MIN(latency_ms) AS min_latency_ms, MAX(latency_ms) AS max_latency_ms, {DUR} AS avg_duration_sec"


@check("a6_performance", f"{_LATQ}, {rnd('quantile_cont(latency_ms, 0.95)', 2)} AS p95_latency_ms FROM session_logs WHERE latency_ms > 0 GROUP BY ALL", S)
def _(t):
    return sr.performance(t.session_logs, exact=True)


@check("a7_latency_by_model_language", f"{_LATQ} FROM session_logs WHERE latency_ms > 0 GROUP BY ALL", S)
def _(t):
    return sr.latency_by_model_language(t.session_logs)


_TREND = f"COUNT(*) AS sessions, {FAM} AS active_families, {COST} AS daily_cost, {LAT} AS avg_latency_ms, {RATE1} AS success_rate FROM session_logs GROUP BY ALL"


@check("a8_trend_daily", f"SELECT {DAY} AS date, {_TREND} ORDER BY date DESC LIMIT 90", S)
def _(t):
    return sr.trend_daily(t.session_logs, limit=90)


@check("a9_trend_hourly", f"SELECT concat({DAY}, ' ', substr(timestamp, 12, 2), ':00') AS hour, language, {_TREND} ORDER BY hour DESC, language LIMIT 90", S)
def _(t):
    return sr.trend_hourly(t.session_logs, ["language"], limit=90)


@check("a10_trend_weekly", f"SELECT strftime(date_trunc('week', CAST(substr(timestamp, 1, 19) AS TIMESTAMP)), '%Y-%m-%d') AS week, {_TREND} ORDER BY week DESC LIMIT 90", S)
def _(t):
    return sr.trend_weekly(t.session_logs, limit=90)


@check("a11_trend_ymd", f"SELECT year, month, day, COUNT(*) AS sessions, {FAM} AS active_families, {COST} AS daily_cost, {LAT0} AS avg_latency_ms FROM session_logs GROUP BY ALL ORDER BY year DESC, month DESC, day DESC LIMIT 14", S)
def _(t):
    return sr.trend_ymd(t.session_logs, 14, latency_digits=0)


@check("a12_breakdown", f"SELECT language, region, COUNT(*) AS sessions, {SHARE} AS percentage, {FAM} AS unique_families, {COST} AS total_cost, {LAT} AS avg_latency_ms FROM session_logs GROUP BY language, region", S)
def _(t):
    return sr.breakdown(t.session_logs)


@check("a13_comparison", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost, {AVGC} AS avg_cost, {LAT} AS avg_latency_ms, {RATE1} AS success_rate, {TALL} AS total_tokens FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.comparison(t.session_logs)


_TOP = f"COUNT(*) AS sessions, {FAM} AS unique_families, {COST} AS total_cost, {LAT} AS avg_latency_ms FROM session_logs GROUP BY ALL"


@check("a14_top_n_cost", f"SELECT family_id_hash, {_TOP} ORDER BY total_cost DESC, family_id_hash LIMIT 10", S)
def _(t):
    return sr.top_n(t.session_logs, ["family_id_hash"], "total_cost")


@check("a14_top_n_fastest", f"SELECT child_id_hash, {_TOP} ORDER BY avg_latency_ms, child_id_hash LIMIT 5", S)
def _(t):
    return sr.top_n(t.session_logs, ["child_id_hash"], "avg_latency_ms", asc=True, n=5)


_OUT = "CAST(SUM(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS successful, CAST(SUM(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS failed"


@check("a15_success_rate", f"SELECT model_name, COUNT(*) AS total_sessions, {_OUT}, {RATE2} AS success_rate FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.success_rate(t.session_logs)


@check("a16_success_rate_by_language", f"SELECT language, COUNT(*) AS total, {_OUT}, {RATE1} AS success_rate FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.success_rate_by_language(t.session_logs)


@check("a17_error_breakdown", f"SELECT error_code, model_name, COUNT(*) AS occurrences, {SHARE} AS percentage FROM session_logs WHERE NOT success AND error_code IS NOT NULL AND error_code <> '' GROUP BY error_code, model_name ORDER BY occurrences DESC, error_code, model_name LIMIT 20", S)
def _(t):
    return sr.error_breakdown(t.session_logs, 20)


@check("a18_error_impact", f"SELECT error_code, COUNT(*) AS occurrences, {FAM} AS affected_families FROM session_logs WHERE error_code <> '' GROUP BY ALL ORDER BY occurrences DESC, error_code LIMIT 10", S)
def _(t):
    return sr.error_impact(t.session_logs, 10)


@check("a19_status_distribution", f"SELECT COALESCE(NULLIF(error_code, ''), 'Success') AS status, COUNT(*) AS count, {SHARE} AS percentage FROM session_logs GROUP BY 1", S)
def _(t):
    return sr.status_distribution(t.session_logs)


@check("a20_overview", f"SELECT language, region, COUNT(*) AS sessions, {FAM} AS families, {COST} AS total_cost, {LAT} AS avg_latency_ms, {RATE1} AS success_rate FROM session_logs GROUP BY ALL ORDER BY sessions DESC, language, region LIMIT 20", S)
def _(t):
    return sr.overview(t.session_logs, 20)


@check("a21_language_report", f"SELECT language, region, COUNT(*) AS sessions, {FAM} AS families, {COST} AS total_cost, {AVGC} AS avg_cost_per_session FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.language_report(t.session_logs)


@check("a22_kpi_summary", f"SELECT COUNT(*) AS total_sessions, {FAM} AS unique_families, {KID} AS unique_children, COUNT(DISTINCT language) AS languages, {COST} AS total_cost, {LAT0} AS avg_latency_ms, {RATE1} AS success_rate, {TALL} AS total_tokens FROM session_logs", S)
def _(t):
    return sr.kpi_summary(t.session_logs)


@check("a23_session_stats", f"SELECT COUNT(*) AS total_sessions, {FAM} AS unique_families, {KID} AS unique_children, {COST} AS total_cost_usd, {AVGC} AS avg_cost_per_session, {TIN} AS total_input_tokens, {TOUT} AS total_output_tokens FROM session_logs", S)
def _(t):
    return sr.session_stats(t.session_logs)


@check("a24_by_language", f"SELECT language, COUNT(*) AS sessions, {FAM} AS families, {COST} AS cost, {LAT0} AS avg_latency FROM session_logs GROUP BY ALL ORDER BY sessions DESC, language LIMIT 10", S)
def _(t):
    return sr.by_language(t.session_logs, 10)


@check("a24_by_model", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost, {AVGC} AS avg_cost, {TIN} AS input_tokens, {TOUT} AS output_tokens, {LAT0} AS avg_latency FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.by_model(t.session_logs)


@check("a24_daily_dashboard", f"SELECT {DAY} AS date, COUNT(*) AS sessions, {FAM} AS families, {COST} AS cost, {LAT0} AS avg_latency, {RATE1} AS success_rate FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.daily_dashboard(t.session_logs)


@check("a25_by_region_share", f"SELECT region, COUNT(*) AS sessions, {COST} AS cost, {SHARE} AS percentage FROM session_logs GROUP BY region", S)
def _(t):
    return sr.by_region_share(t.session_logs)


@check("a26_top_families", f"SELECT family_id_hash, COUNT(*) AS sessions, {KID} AS children, {COST} AS total_cost, {LAT0} AS avg_latency FROM session_logs GROUP BY ALL ORDER BY sessions DESC, family_id_hash LIMIT 10", S)
def _(t):
    return sr.top_families(t.session_logs)


@check("a27_model_usage", f"SELECT model_provider, model_name, COUNT(*) AS sessions, {COST} AS total_cost, {AVGC} AS avg_cost, {LAT0} AS avg_latency, {TIN} AS input_tokens, {TOUT} AS output_tokens FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.model_usage(t.session_logs)


_EFF = f"SELECT language, COUNT(*) AS sessions, {rnd('AVG(input_tokens)', 0)} AS avg_input, {rnd('AVG(output_tokens)', 0)} AS avg_output, {rnd('CAST(SUM(output_tokens) AS DOUBLE) / NULLIF(SUM(input_tokens), 0)', 2)} AS output_ratio FROM session_logs GROUP BY ALL"


@check("a28_token_efficiency", _EFF, S)
def _(t):
    return sr.token_efficiency(t.session_logs)


@check("a28_most_efficient_language", f"SELECT language, output_ratio FROM ({_EFF}) ORDER BY output_ratio DESC, language LIMIT 1", S)
def _(t):
    return sr.most_efficient_language(t.session_logs)


@check("a29_day_over_day", f"""WITH d AS (SELECT {DAY} AS date, COUNT(*) AS sessions FROM session_logs GROUP BY 1),
 x AS (SELECT date, sessions, LAG(sessions) OVER (ORDER BY date) AS previous FROM d)
 SELECT date, sessions, previous, (sessions - previous) / CAST(previous AS DOUBLE) * 100.0 AS change_pct FROM x WHERE previous > 0 ORDER BY date DESC LIMIT 1""", S)
def _(t):
    return sr.day_over_day(t.session_logs)


@check("a30_row_counts", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS row_count, COUNT(*) = 0 AS is_empty, '{c}' AS columns FROM {n}" for n, c in [
        ("orders", "o_orderkey,o_custkey,o_orderstatus,o_totalprice,o_orderdate,o_orderpriority"),
        ("customer", "c_custkey,c_name,c_nationkey,c_acctbal,c_mktsegment"),
        ("events", "event_id,ts,user_id,event_type,value,props"),
        ("documents", "doc_id,text,lang,source,n_chars")]))
def _(t):
    return sr.row_counts({n: t.read(n) for n in ("orders", "customer", "events", "documents")})


@check("a31_monthly_revenue", "SELECT strftime(date_trunc('month', transaction_date), '%Y-%m-%d') AS month, region, SUM(amount) AS total_revenue FROM revenue WHERE year(transaction_date) = 1998 GROUP BY ALL", "revenue")
def _(t):
    return revenue.monthly_revenue(t.revenue, 1998)


@check("a32_top_customers", "SELECT customer_id, COUNT(*) AS transaction_count, SUM(amount) AS total_amount FROM revenue GROUP BY ALL ORDER BY total_amount DESC, customer_id LIMIT 25", "revenue")
def _(t):
    return revenue.top_customers(t.revenue, 25)


@check("a33_generic_aggregate", "SELECT region, SUM(amount) AS total_amount, COUNT(*) AS count FROM revenue WHERE year(transaction_date) = 1997 GROUP BY ALL ORDER BY total_amount DESC, region LIMIT 10000", "revenue")
def _(t):
    return revenue.generic_aggregate(t.revenue, ["region"], ["SUM", "COUNT"], 1997, "DESC", 10_000)


@check("a33_generic_aggregate_global", f"SELECT SUM(amount) AS total_amount, COUNT(*) AS count FROM revenue", "revenue")
def _(t):
    return revenue.generic_aggregate(t.revenue, [], ["SUM", "COUNT"])


@check("a34_monthly_revenue_by_region", """SELECT r_name AS region, period_id % 100 AS month, SUM(amount) AS total_revenue
 FROM revenue JOIN region ON region_id = r_regionkey WHERE period_id // 100 = 1999 AND r_name IN ('EUROPE', 'ASIA', 'AFRICA') GROUP BY ALL""", "revenue")
def _(t):
    regions = t.region.selectExpr("r_regionkey AS id", "r_name AS name", "r_name AS country")
    periods = t.orders.selectExpr("year(o_orderdate) AS year", "month(o_orderdate) AS month").distinct().selectExpr(
        "year * 100 + month AS id", "year", "month")
    return revenue.monthly_revenue_by_region(t.revenue, regions, periods, 1999, ["EUROPE", "ASIA", "AFRICA"])


@check("a35_dataset_statistics", f"SELECT COUNT(*) AS total_sessions, {COST} AS total_cost, {RATE1} AS success_rate, MIN({DAY}) AS first_day, MAX({DAY}) AS last_day, COUNT(DISTINCT {DAY}) AS days_with_data FROM session_logs", S)
def _(t):
    return sr.dataset_statistics(t.session_logs)


@check("a35_language_shares", f"SELECT language, COUNT(*) AS sessions, {SHARE} AS percentage FROM session_logs GROUP BY language ORDER BY sessions DESC, language LIMIT 5", S)
def _(t):
    return sr.language_shares(t.session_logs, 5)


@check("a35_model_costs", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.model_costs(t.session_logs)


@check("a36_quick_check_cost", f"SELECT model_name, COUNT(*) AS sessions, {COST} AS total_cost FROM session_logs GROUP BY ALL ORDER BY total_cost DESC, model_name LIMIT 5", S)
def _(t):
    return sr.quick_checks(t.session_logs, 5, 7)["cost_by_model"]


@check("a36_quick_check_language", "SELECT language, COUNT(*) AS sessions FROM session_logs GROUP BY ALL ORDER BY sessions DESC, language LIMIT 5", S)
def _(t):
    return sr.quick_checks(t.session_logs, 5, 7)["sessions_by_language"]


@check("a36_quick_check_days", f"SELECT year, month, day, COUNT(*) AS sessions, {COST} AS daily_cost FROM session_logs GROUP BY ALL ORDER BY year DESC, month DESC, day DESC LIMIT 7", S)
def _(t):
    return sr.quick_checks(t.session_logs, 5, 7)["last_days"]


@check("a37_monthly_trend", f"SELECT concat(year, '-', month) AS month, COUNT(*) AS sessions, {FAM} AS active_families, {COST} AS total_cost FROM session_logs GROUP BY 1", S)
def _(t):
    return sr.monthly_trend(t.session_logs)


@check("a37_cohorts", f"""WITH f AS (SELECT *, MIN({DAY}) OVER (PARTITION BY family_id_hash) AS cohort FROM session_logs)
 SELECT cohort, {DAY} AS period, {FAM} AS families, COUNT(*) AS sessions FROM f GROUP BY 1, 2""", S)
def _(t):
    return sr.cohorts(t.session_logs, F.concat_ws("-", "year", "month", "day"))


@check("a37_by_source", f"SELECT source, COUNT(*) AS sessions, {FAM} AS unique_families, {COST} AS total_cost, {RATE1} AS success_rate FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.by_source(t.session_logs)


@check("a37_peak_hours", f"SELECT substr(timestamp, 12, 2) AS hour, COUNT(*) AS sessions, {LAT} AS avg_latency_ms FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.peak_hours(t.session_logs)


# the same reports without a limit

@check("a1_session_count_all", f"SELECT family_id_hash, COUNT(*) AS sessions, {FAM} AS unique_families FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.session_count(t.session_logs, ["family_id_hash"])


@check("a9_trend_hourly_all", f"SELECT concat({DAY}, ' ', substr(timestamp, 12, 2), ':00') AS hour, language, {_TREND}", S)
def _(t):
    return sr.trend_hourly(t.session_logs, ["language"])


@check("a9_trend_hourly_periods", f"""WITH t AS (SELECT concat({DAY}, ' ', substr(timestamp, 12, 2), ':00') AS hour, language, {_TREND})
 SELECT * FROM t WHERE hour IN (SELECT DISTINCT hour FROM t ORDER BY hour DESC LIMIT 48)""", S)
def _(t):
    return sr.trend_hourly(t.session_logs, ["language"], periods=48)


@check("a17_error_breakdown_all", f"SELECT error_code, model_name, COUNT(*) AS occurrences, {SHARE} AS percentage FROM session_logs WHERE NOT success AND error_code IS NOT NULL AND error_code <> '' GROUP BY error_code, model_name", S)
def _(t):
    return sr.error_breakdown(t.session_logs)


@check("a20_overview_all", f"SELECT language, region, COUNT(*) AS sessions, {FAM} AS families, {COST} AS total_cost, {LAT} AS avg_latency_ms, {RATE1} AS success_rate FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.overview(t.session_logs)


@check("a36_quick_check_days_all", f"SELECT year, month, day, COUNT(*) AS sessions, {COST} AS daily_cost FROM session_logs GROUP BY ALL", S)
def _(t):
    return sr.quick_checks(t.session_logs)["last_days"]


def _near(col, exact, approx, bound=0.06):
    """1 where a sketch is within its error bound of the exact value; 5 % is the sketch's own deviation, small counts are near exact."""
    return (F.abs(F.col(approx) - F.col(exact)) <= F.greatest(F.lit(1.0), F.col(exact) * 3 * bound)).cast("int").alias(col)


@check("a22_kpi_summary_sketch", f"SELECT COUNT(*) AS total_sessions, 1 AS families_near, 1 AS children_near FROM session_logs", S)
def _(t):
    exact, sketch = sr.kpi_summary(t.session_logs), sr.kpi_summary(t.session_logs, approx=True)
    both = exact.select("total_sessions", F.col("unique_families").alias("ef"), F.col("unique_children").alias("ec")).join(
        sketch.select("total_sessions", F.col("unique_families").alias("sf"), F.col("unique_children").alias("sc")), "total_sessions")
    return both.select("total_sessions", _near("families_near", "ef", "sf"), _near("children_near", "ec", "sc"))


def _stored_days(t):
    path = scratch_path(t.spark, "days")
    sk.store_daily(sk.daily_sketches(t.session_logs), path)
    return sk.read_daily(t.spark, path)


@check("a22_kpi_from_days", f"SELECT COUNT(*) AS total_sessions, {COST} AS total_cost, {LAT0} AS avg_latency_ms, {RATE1} AS success_rate, {TALL} AS total_tokens, 1 AS families_near, 1 AS children_near FROM session_logs", S)
def _(t):
    exact = sr.kpi_summary(t.session_logs).select("total_sessions", F.col("unique_families").alias("ef"), F.col("unique_children").alias("ec"))
    both = sk.summary(_stored_days(t)).join(exact, "total_sessions")
    return both.select("total_sessions", "total_cost", "avg_latency_ms", "success_rate", "total_tokens",
                       _near("families_near", "ef", "unique_families", 0.016), _near("children_near", "ec", "unique_children", 0.016))


@check("a37_monthly_from_days", f"SELECT concat(year, '-', month) AS month, language, COUNT(*) AS total_sessions, {COST} AS total_cost, {RATE1} AS success_rate, 1 AS families_near FROM session_logs GROUP BY 1, 2", S)
def _(t):
    month = F.concat_ws("-", "year", "month").alias("month")
    days = sk.summary(_stored_days(t), [month, "language"])
    exact = t.session_logs.groupBy(month, "language").agg(F.count_distinct("family_id_hash").alias("ef"))
    return days.join(exact, ["month", "language"]).select("month", "language", "total_sessions", "total_cost", "success_rate",
                                                          _near("families_near", "ef", "unique_families", 0.016))


# generic aggregation surface

@check("g_basic_aggs", "SELECT o_orderpriority, COUNT(*) AS n, MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi, SUM(CAST(o_totalprice AS DECIMAL(15,2))) AS total FROM orders GROUP BY ALL")
def _(t):
    rows = t.orders.withColumn("price", F.col("o_totalprice").cast("decimal(15,2)"))
    return agg.basic_aggs(rows, ["o_orderpriority"], {"n": ("count", "*"), "lo": ("min", "o_orderkey"),
                                                      "hi": ("max", "o_orderkey"), "total": ("sum", "price")})


@check("g_distinct_counts", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS parts, COUNT(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ALL")
def _(t):
    return agg.distinct_counts(t.lineitem, ["l_returnflag"], {"parts": "l_partkey", "suppliers": "l_suppkey"})


@check("g_percentiles", f"SELECT l_returnflag, {rnd('quantile_cont(l_extendedprice, 0.5)', 4)} AS p50, {rnd('quantile_cont(l_extendedprice, 0.95)', 4)} AS p95 FROM lineitem GROUP BY ALL")
def _(t):
    out = quantiles.percentiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p95": 0.95}, exact=True)
    return out.select("l_returnflag", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


@check("g_nearest_rank", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, COUNT(*) OVER (PARTITION BY event_type) AS n FROM events)
 SELECT event_type, n AS count, MAX(CASE WHEN k = n // 2 THEN value END) AS p50,
  MAX(CASE WHEN k = CASE WHEN n >= 20 THEN CAST(floor(n * 0.95::DOUBLE) AS BIGINT) ELSE n - 1 END THEN value END) AS p95,
  MAX(CASE WHEN k = CAST(floor(n * 0.99::DOUBLE) AS BIGINT) THEN value END) AS p99, MIN(value) AS min, MAX(value) AS max FROM r GROUP BY event_type, n""")
def _(t):
    return quantiles.nearest_rank(t.events, ["event_type"], "value")


@check("g_conditional_count", "SELECT o_orderpriority, COUNT(*) AS total, COUNT(*) FILTER (WHERE o_totalprice > 200000) AS large, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS closed FROM orders GROUP BY ALL")
def _(t):
    return agg.conditional_count(t.orders, ["o_orderpriority"], {"large": F.col("o_totalprice") > 200000, "closed": F.col("o_orderstatus") == "F"})


@check("g_safe_ratio", f"SELECT event_type, user_id, {rnd('CAST(SUM(latency) AS DOUBLE) / NULLIF(SUM(base), 0) * 1000.0', 6)} AS ratio FROM (SELECT event_type, user_id, event_id % 7 AS latency, event_id % 2 AS base FROM events) GROUP BY ALL")
def _(t):
    from custodia.functions.numbers import rounded, safe_ratio
    rows = t.events.selectExpr("event_type", "user_id", "event_id % 7 AS latency", "event_id % 2 AS base")
    return rows.groupBy("event_type", "user_id").agg(rounded(safe_ratio(F.sum("latency"), F.sum("base"), 1000), 6).alias("ratio"))


@check("g_argmax", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY ALL ORDER BY n DESC, o_custkey LIMIT 1")
def _(t):
    return agg.argmax(t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey", "n")


@check("g_rollup_totals", "SELECT catalog_name, schema_name, CAST(GROUPING(catalog_name) * 2 + GROUPING(schema_name) AS BIGINT) AS level_id, COUNT(*) AS datasets, CAST(SUM(bytes) AS BIGINT) AS bytes FROM catalog_tables GROUP BY ROLLUP (catalog_name, schema_name)", "catalog_tables")
def _(t):
    return agg.rollup_totals(t.catalog_tables, ["catalog_name", "schema_name"], [F.count("*").alias("datasets"), F.sum("bytes").alias("bytes")])


@check("g_sample_set", "SELECT l_returnflag, COUNT(DISTINCT l_partkey) AS cardinality, array_to_string(list_sort(list_distinct(list(l_partkey)))[1:10], ',') AS samples FROM lineitem GROUP BY ALL")
def _(t):
    return agg.sample_set(t.lineitem, ["l_returnflag"], "l_partkey").withColumn("samples", F.array_join("samples", ","))


# windows

@check("w1_share_of_total", f"SELECT o_orderpriority, o_orderstatus, COUNT(*) AS orders, {rnd('100.0 * CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER ()', 2)} AS percentage FROM orders GROUP BY 1, 2")
def _(t):
    return agg.share_of_total(t.orders, ["o_orderpriority", "o_orderstatus"], digits=2, count_name="orders")


@check("w2_change_from_previous", """WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, COUNT(*) AS n FROM events GROUP BY 1)
 SELECT day, n, LAG(n) OVER (ORDER BY day) AS previous, (n - LAG(n) OVER (ORDER BY day)) / CAST(LAG(n) OVER (ORDER BY day) AS DOUBLE) * 100.0 AS change_pct FROM d""")
def _(t):
    daily = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))
    return ordered.change_from_previous(daily, ["day"], "n", chunk=F.substring("day", 1, 7))


@check("w3_last_n", "SELECT agent, seq, status FROM health_checks QUALIFY row_number() OVER (PARTITION BY agent ORDER BY seq DESC) <= 100", "health_checks")
def _(t):
    return ordered.last_n(t.health_checks.select("agent", "seq", "status"), ["agent"], ["seq"], 100)


@check("w4_run_lengths", """WITH f AS (SELECT agent, seq, status <> 'UNHEALTHY' AS ok FROM health_checks),
 g AS (SELECT *, row_number() OVER (PARTITION BY agent ORDER BY seq) - row_number() OVER (PARTITION BY agent, ok ORDER BY seq) AS island FROM f)
 SELECT agent, seq, ok, row_number() OVER (PARTITION BY agent, ok, island ORDER BY seq) AS run_length FROM g""", "health_checks")
def _(t):
    rows = t.health_checks.selectExpr("agent", "seq", "status <> 'UNHEALTHY' AS ok")
    return ordered.run_lengths(rows, ["agent"], ["seq"], "ok", ordered.chunk_of(rows, "seq", 1000))


@check("w5_carry_forward", """WITH f AS (SELECT agent, seq, CASE WHEN seq % 5 = 0 THEN status END AS known FROM health_checks)
 SELECT agent, seq, known, last_value(known IGNORE NULLS) OVER (PARTITION BY agent ORDER BY seq ROWS UNBOUNDED PRECEDING) AS filled FROM f""", "health_checks")
def _(t):
    rows = t.health_checks.selectExpr("agent", "seq", "CASE WHEN seq % 5 = 0 THEN status END AS known")
    return ordered.carry_forward(rows, ["agent"], ["seq"], "known", "filled", ordered.chunk_of(rows, "seq", 1000))
