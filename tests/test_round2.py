"""Holes that were closed: the read-only guard, roles, maps, NaN and crowded quantiles, null requests and depth."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from custodia.operators import dedupe, filters, lineage, paging, quantiles, redaction
from custodia.sources import tables


@pytest.mark.parametrize("sql", [
    "WITH a AS (SELECT '--' AS a) INSERT INTO tgt SELECT * FROM a", "SELECT 1; SELECT 2", "/* x */ DROP TABLE t", "SELECT '/*' AS a; DROP TABLE t -- */",
    "WITH a AS (SELECT \"--\" AS x) INSERT OVERWRITE tgt SELECT * FROM a"])
def test_writes_are_refused(spark, sql):
    with pytest.raises(PermissionError):
        tables.execute(spark, sql)


def test_guard_decides_on_the_plan(spark):
    assert tables._writes(spark, "WITH a AS (SELECT 1 AS x) INSERT INTO tgt SELECT * FROM a", {})
    assert tables._writes(spark, "CREATE TABLE x AS SELECT 1", {})
    for sql in ("SELECT 1", "WITH a AS (SELECT '--' AS x) SELECT * FROM a", "SHOW TABLES", "DESCRIBE TABLE x", "SELECT * FROM {t} WHERE a IN (SELECT 1)"):
        assert tables._writes(spark, sql, {"t": None}) is None
    df = spark.range(3000)
    assert tables.execute(spark, "SELECT id FROM {t} -- all of it", t=df).count() == 3000
    assert tables.execute(spark, "SELECT '--' AS a, id FROM {t}", 5, t=df).count() == 5


def test_no_known_role_no_rows(spark):
    df = spark.createDataFrame([("FR", "europe")], "country string, region string")
    assert filters.role_row_filters(df, ["nobody"], "regions").count() == 0
    assert filters.role_row_filters(df, [], "regions").count() == 0
    assert filters.viewer_region_filter(df, []).count() == 0
    assert filters.viewer_region_filter(df, ["nobody"]).count() == 0
    assert filters.viewer_region_filter(df, ["analyst"]).count() == 1
    assert filters.role_row_filters(df, ["admin"], "regions").count() == 1


def test_redaction_below_map_keys(spark):
    df = spark.sql("SELECT map('p', named_struct('ssn', '1', 'n', 'x')) AS m, map('a', map('ssn', '2')) AS n, map('ssn', 3, 'q', 4) AS k, map('l', array('5')) AS l, CAST(NULL AS MAP<STRING,STRING>) AS e")
    r = redaction.redact_paths(df, ["m.*.ssn", "n.*.ssn", "k.ssn", "l.l[]", "e.*"]).first()
    assert r.m["p"].ssn == "[REDACTED]" and r.m["p"].n == "x" and r.n["a"]["ssn"] == "[REDACTED]"
    assert r.k == {"ssn": None, "q": 4} and r.l == {"l": ["[REDACTED]"]} and r.e is None


def test_nan_sorts_last(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10, "nan")], "v double")
    r = quantiles.percentiles(df, [], "v", {"p50": 0.5, "p95": 0.95}, exact=True).first()
    assert r.p50 == 3.0 and r.p95 != r.p95
    inf = float("inf")
    df = spark.createDataFrame([(x,) for x in (-inf, -2.0, -0.5, 0.0, 1e-310, 5e-4, inf)], "v double")
    got = quantiles.percentiles(df, [], "v", {f"p{i}": i / 6 for i in range(7)}, exact=True).first()
    assert [got[f"p{i}"] for i in range(7)] == [-inf, -2.0, -0.5, 0.0, 1e-310, 5e-4, inf]


@pytest.mark.parametrize("expr", ["id / 2e8", "1e6 + id / 2e8", "-id / 2e8", "pow(id / 2e5, 9)"])
def test_crowded_values(spark, expr):
    df = spark.range(200_001).select(F.expr(expr).alias("v"))
    r = quantiles.percentiles(df, [], "v", {"a": 0.1, "b": 0.5}, exact=True).first()
    want = df.selectExpr("percentile(v, 0.1) AS a", "percentile(v, 0.5) AS b").first()
    assert abs(r.a - want.a) < 1e-9 and abs(r.b - want.b) < 1e-9


def test_requests_without_time_or_key_are_executed(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "k", t, "OK"), (2, "k", t + dt.timedelta(seconds=5), "OK"), (3, "k", None, "OK"), (4, None, t, "OK")], "id long, k string, ts timestamp, status string")
    got = {r.id: (r.executed, r.served_by) for r in dedupe.dedupe_requests(df, F.col("k"), "ts", "id", F.col("status") == "ERROR").collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (True, None), 4: (True, None)}


def test_walks_end_by_themselves(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{(i + 1) % 15}", "r", None) for i in range(15)], "src string, dst string, relationship string, transformation string")
    assert lineage.reach(edges, ["n0"], None).count() == 14  # a cycle
    assert len(lineage.find_path(edges, "n0", "n14").first().path) == 15
    with pytest.raises(ValueError):
        lineage.reach(edges, ["n0"], 0)


def test_pages_above_the_bound_are_refused(spark):
    with pytest.raises(ValueError):
        paging.paginate(spark.range(5).toDF("id"), ["id"], 1, 1001)


def test_bag_and_set_difference(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    assert sorted(r.k for r in paging.except_all(a, b).collect()) == [1, 2]
    assert sorted(r.k for r in paging.except_distinct(a, b).collect()) == [2]


def test_dense_requests_meet_in_bounded_tables(spark):
    """One key, one request a second for 12 hours: no task sees more of the key than the tables of FAN parts."""
    n, ttl, per_chunk = 43_200, 60, 4
    t = dt.datetime(2024, 1, 1)
    df = spark.range(n).select(F.col("id"), F.lit("hot").alias("k"), (F.lit(t).cast("timestamp") + F.make_dt_interval(secs=F.col("id"))).alias("ts"))
    seen = []
    real = dedupe.materialize

    def watch(frame, label):
        out = real(frame, label)
        if label == "tables":
            seen.append(out[0].groupBy("k", F.floor(F.col("c") / dedupe.FAN)).count().agg(F.max("count")).first()[0])
        return out

    dedupe.materialize = watch
    try:
        out = dedupe.dedupe_requests(df, F.col("k"), "ts", "id", F.lit(False), ttl, per_chunk)
        executed = out.where("executed").count()
    finally:
        dedupe.materialize = real
    assert executed == n // ttl and out.count() == n
    # a table has a row per request of the first ttl of its part, one more, and its mark
    assert len(seen) > 2 and max(seen) <= dedupe.FAN * (ttl + 2)
