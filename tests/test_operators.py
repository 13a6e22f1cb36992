"""Goldens and properties that need their own small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from custodia.operators import access, catalog, filters, lineage, paging, profiling, querylog
from custodia.plans.governed import RowRule, TablePolicy, User, audit_row, governed_view
from custodia.session import work_root
from custodia.sources import sessions as src
from custodia.sources import tables as tab

EDGES = [
    ("catalog://finance.customer_transactions", "catalog://finance.monthly_revenue"),
    ("catalog://finance.customer_transactions", "catalog://analytics.user_churn"),
    ("catalog://finance.monthly_revenue", "catalog://analytics.revenue_forecast"),
    ("catalog://finance.monthly_revenue", "catalog://reporting.executive_dashboard"),
    ("catalog://analytics.user_churn", "catalog://marketing.retention_campaigns"),
    ("catalog://analytics.user_churn", "catalog://reporting.customer_health_dashboard"),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(a, b, "r", "t") for a, b in EDGES], "src string, dst string, relationship string, transformation string")


def test_downstream_golden(edges):
    got = lineage.downstream(edges, [EDGES[0][0]], 3).collect()
    levels = {r["node"]: r["level"] for r in got}
    assert sorted(levels.values()) == [1, 1, 2, 2, 2, 2]
    assert set(levels) == {b for _, b in EDGES}


def test_paths_keep_duplicates_and_close_cycles(spark):
    rows = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a")]
    g = spark.createDataFrame([(x, y, "r", "t") for x, y in rows], "src string, dst string, relationship string, transformation string")
    got = [(r["level"], r["parent"], r["node"]) for r in lineage.walk(g, ["a"], 4).collect()]
    assert sorted(got) == [(1, "a", "b"), (1, "a", "c"), (2, "b", "d"), (2, "c", "d"), (3, "d", "a"), (3, "d", "a")]
    assert {(r["node"], r["level"]) for r in lineage.reach(g, ["a"], 4).collect()} == {("b", 1), ("c", 1), ("d", 2)}


def test_find_path(edges):
    got = lineage.find_path(edges, EDGES[0][0], "catalog://reporting.executive_dashboard").first()["path"]
    assert got == ["catalog://finance.customer_transactions", "catalog://finance.monthly_revenue", "catalog://reporting.executive_dashboard"]
    assert lineage.find_path(edges, "x", "x").first()["path"] == ["x"]
    assert lineage.find_path(edges, EDGES[0][0], "catalog://nowhere.else").count() == 0
    assert lineage.find_path(edges, EDGES[0][0], "catalog://reporting.executive_dashboard", max_nodes=2).count() == 0


def test_depth_is_the_callers(edges):
    with pytest.raises(ValueError):
        lineage.reach(edges, ["x"], 0)
    root = EDGES[0][0]
    assert sorted(lineage.reach(edges, [root], 11).collect()) == sorted(lineage.reach(edges, [root], None).collect())


def test_search_score_is_capped(spark):
    tables = spark.createDataFrame([("revenue", "Monthly revenue records", ["revenue"]), ("regions", "Geographic", ["geo"])],
                                   "table_name string, description string, tags array<string>")
    assert [(r["table_name"], r["score"]) for r in catalog.search_catalog(tables, "revenue").collect()] == [("revenue", 1.0)]


def test_question_intents(spark):
    asked = ["How many sessions do we have by language?", "What's our cost by model?", "Show me the performance breakdown by model",
             "Daily trend of sessions for the last 30 days", "Top 5 most expensive languages", "What's our error rate by model?",
             "Compare costs between models", "Show me session distribution by region"]
    df = spark.createDataFrame(list(enumerate(asked)), "question_id int, question string")
    got = [r["intent"] for r in querylog.question_intent(df).orderBy("question_id").collect()]
    assert got == ["count", "cost", "performance", "trend", "top_n", "breakdown", "cost", "breakdown"]


def test_security_scan(spark):
    df = spark.createDataFrame([(0, "DELETE FROM t"), (1, "SELECT * FROM t"), (2, "-- only a comment"), (3, "select updated_at from t")], "i int, sql string")
    got = {r["i"]: (r["safe"], r["security_rule"]) for r in querylog.scan_security(df).collect()}
    assert got == {0: (False, "blocked_keyword"), 1: (True, None), 2: (False, "empty_query"), 3: (True, None)}


def test_pagination_golden(spark):
    df = spark.range(250)
    info = paging.page_info(df, 1, 100).first()
    assert (info["total_pages"], info["has_more"], info["next_cursor"]) == (3, True, "page:2:size:100")
    pages = [[r["id"] for r in paging.paginate(df, ["id"], p, 100).collect()] for p in (1, 2, 3, 4)]
    assert [len(p) for p in pages] == [100, 100, 50, 0] and sum(pages, []) == list(range(250))
    by_key, cursor = [], None
    while page := [r["id"] for r in paging.page_after(df, ["id"], cursor, 100).collect()]:
        by_key += page
        cursor = [page[-1]]
    assert by_key == list(range(250))
    with pytest.raises(ValueError):
        paging.paginate(df, [])


def test_relative_ranges():
    day = dt.date(2024, 3, 8)
    assert filters.relative_range("today", day) == ("2024-03-08", "2024-03-08")
    assert filters.relative_range("last week", day) == ("2024-03-01", "2024-03-08")
    assert filters.relative_range("past month", day) == ("2024-02-07", "2024-03-08")


def test_filters_fail_closed(spark):
    df = spark.createDataFrame([("eu", 1)], "region string, id int")
    assert filters.row_filter_template(df, "region", None).count() == 0
    assert filters.geo_restrict(df, "nobody", {"eu": "EU"}).count() == 0
    with pytest.raises(filters.AccessDenied):
        filters.exclude_classifications(df, {"id": ["PII"]}, ["nobody"])
    with pytest.raises(filters.AccessDenied):
        filters.column_deny(df, [], "customers", ["customers"])


def test_governed_view_filters_raw_values_and_audits(spark):
    df = spark.createDataFrame([("eu", "a@b.c", 1), ("us", "d@e.f", 2)], "region string, email string, id int")
    from custodia.operators.redaction import MaskPolicy
    policy = TablePolicy("t", ("analyst",), row_rules=(RowRule(column="region", attribute="regions"),), masks=(MaskPolicy("region", "full"), MaskPolicy("email", "email")))
    user = User("u1", ["analyst"], {"regions": ["eu"]})
    view = governed_view(df, user, policy)
    assert [tuple(r) for r in view.collect()] == [("***REDACTED***", "a***@b.c", 1)]
    audit = audit_row(view, user, policy, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert (audit["user_id"], audit["outcome"], audit["details"]) == ("u1", "allow", '{"rows":1}')
    with pytest.raises(filters.AccessDenied):
        governed_view(df, User("u2", ["guest"]), policy)


def test_bare_names_do_not_bypass_policies(spark):
    rows = [(["viewer"], "read", ["finance.customer_transactions"])]
    df = spark.createDataFrame(rows, "roles array<string>, action string, resources array<string>")
    assert not access.authorize_batch(df).first()["authorized"]
    nobody = spark.createDataFrame([(["ghost"], "read", ["catalog://a.b"])], df.schema)
    assert not access.authorize_batch(nobody).first()["authorized"]


def test_luhn(spark):
    df = spark.createDataFrame([("4111-1111-1111-1111",), ("4111-1111-1111-1112",)], "n string")
    assert [r[0] for r in df.select(profiling.luhn_valid(F.col("n"))).collect()] == [True, False]


def test_generated_sessions(spark):
    df = src.generate_sessions(spark, 20_000, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 31)).cache()
    again = src.generate_sessions(spark, 20_000, dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 31)).repartition(3)
    assert df.exceptAll(again).count() == 0
    row = df.agg(F.avg((F.col("language") == "en-GB").cast("int")), F.avg(F.col("success").cast("int")),
                 F.avg(F.col("model_name").startswith("claude-3-haiku").cast("int")), F.min("timestamp"), F.max("timestamp"),
                 F.min(F.when(F.col("model_name").startswith("claude-3-opus"), F.col("latency_ms")))).first()
    assert abs(row[0] - 0.25) < 0.02 and abs(row[1] - 9 / 13) < 0.02 and abs(row[2] - 0.60) < 0.02
    assert "2025-01-01" <= row[3][:10] and row[4] < "2025-01-31" and row[5] >= 1200
    assert df.where("success <> (error_code IS NULL)").count() == 0
    df.unpersist()


def test_read_any_and_uri(spark):
    root = work_root(spark)
    import uuid
    base = f"{root}/any-{uuid.uuid4().hex}"
    df = spark.range(10).selectExpr("id", "CAST(id AS STRING) AS s")
    for fmt in ("parquet", "orc", "json", "csv"):
        writer = df.write.option("header", "true") if fmt == "csv" else df.write
        writer.format(fmt).save(f"{base}/{fmt}")
        assert tab.detect_format(spark, f"{base}/{fmt}") == fmt
        assert tab.read_any(spark, f"{base}/{fmt}").count() == 10
    assert tab.parse_uri("catalog://finance.revenue") == ("finance", "revenue")
    for bad in ("finance.revenue", "catalog://finance", "catalog://a.b.c", "catalog://a.b; drop"):
        with pytest.raises(ValueError):
            tab.parse_uri(bad)
    with pytest.raises(LookupError):
        tab.read_table(spark, "catalog://no_such.table")
    for sql in ("DROP TABLE t", "SELECT 1; SELECT 2", "", "WITH a AS (SELECT 1) DELETE FROM t"):
        with pytest.raises(PermissionError):
            tab.check_read_only(sql)


def test_build_catalog(spark):
    spark.range(1).selectExpr("id", "'x' AS name").createOrReplaceTempView("catalog_probe")
    rows = catalog.build_catalog(spark, ["default"]).where("table_name = 'catalog_probe'").collect()
    assert [(r["column_name"], r["data_type"]) for r in sorted(rows, key=lambda r: r["ordinal"])] == [("id", "bigint"), ("name", "string")]
    spark.catalog.dropTempView("catalog_probe")


def test_user_supplied_source(spark):
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Rows(DataSourceReader):
        def partitions(self):
            return [InputPartition(i) for i in range(3)]

        def read(self, partition):
            yield (partition.value, f"part-{partition.value}")

    class Inventory(DataSource):
        @classmethod
        def name(cls):
            return "inventory_probe"

        def schema(self):
            return "id int, label string"

        def reader(self, schema):
            return Rows()

    tab.register_source(spark, Inventory)
    assert sorted(r["label"] for r in spark.read.format("inventory_probe").load().collect()) == ["part-0", "part-1", "part-2"]


def test_groups_with_null_keys_are_kept(spark):
    from custodia.operators import aggregates, quantiles
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    got = {r["k"]: r["p50"] for r in quantiles.percentiles(df, ["k"], "v", {"p50": 0.5}, exact=True).collect()}
    assert got == {None: 2.0, "a": 5.0}
    assert {r["k"]: r["cardinality"] for r in aggregates.sample_set(df, ["k"], "v", 5).collect()} == {None: 2, "a": 1}
