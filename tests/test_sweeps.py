"""Starts-with joins as sweeps, and exact ranks from one count, against plain versions and their plans."""

import random
import re

import pytest
from plan_flags import plan_of
from pyspark.sql import functions as F

from custodia.operators import layout, quantiles


def test_sweep_is_every_pair(spark):
    draw = random.Random(7)
    word = lambda: "".join(draw.choices(["a", "b", "é", "日", "\U0010ffff", "/"], k=draw.randrange(5)))
    rows = [(i, draw.choice(["x", "y", None]), draw.choice([word(), None, word()])) for i in range(300)]
    marks = [(draw.choice(["x", "y", None]), draw.choice([word() or "a", None])) for _ in range(25)]
    df, known = spark.createDataFrame(rows, "id int, bucket string, text string"), spark.createDataFrame(marks, "bucket string, mark string")
    for keys in ([], ["bucket"]):
        got = {r[0]: (r[1], r[2]) for r in layout.swept(df, "text", known, "mark", keys).select("id", "__under", "__over").collect()}
        want = {}
        for i, b, t in rows:
            own = [m for k, m in marks if m is not None and t is not None and (not keys or (k is not None and k == b))]
            want[i] = (any(t.startswith(m) for m in own), any(m.startswith(t) for m in own))
        assert got == want


def test_a_thousand_lengths_move_each_row_once(spark):
    rows = spark.range(2000).select(F.lit("b").alias("bucket"), F.concat(F.lit("x" * 900), F.lpad(F.col("id").cast("string"), 6, "0")).alias("prefix"))
    marks = spark.range(1, 1001).select(F.lit("b").alias("bucket"), F.concat(F.repeat(F.lit("y"), F.col("id").cast("int")), F.lit("z")).alias("prefix"))
    left = layout.uncatalogued_prefixes(rows, marks)
    assert "Generate" not in plan_of(left) and left.count() == 2000
    marks = marks.union(spark.createDataFrame([("b", "x" * 900 + "0000")], "bucket string, prefix string"))
    assert layout.uncatalogued_prefixes(rows, marks).count() == 1900


@pytest.mark.parametrize("group", [[], ["k"]])
def test_exact_ranks_read_one_count(spark, group):
    df = spark.range(20_000).selectExpr("id % 3 AS k", "pmod(hash(id), 5000) / 7.0D AS v")
    out = quantiles.percentiles(df, group, "v", {"p50": 0.5, "p95": 0.95}, exact=True)
    plan = plan_of(out)
    assert len(re.findall(r"FileScan", plan)) <= 2 and len(re.findall(r"Join", plan)) <= 2 and len(re.findall(r"Exchange", plan)) <= 4 and "Range (" not in plan
    want = df.groupBy(*group).agg(F.expr("percentile(v, 0.5) AS p50"), F.expr("percentile(v, 0.95) AS p95"))
    rows = lambda x: sorted([round(c, 9) for c in r] for r in x.select(*group, "p50", "p95").collect())
    assert rows(out) == rows(want)
    both = quantiles.percentiles(df, group, "v", {"p50": 0.5}, exact=True, distinct=True)
    assert sorted(r.distinct for r in both.collect()) == sorted(r.d for r in df.groupBy(*group).agg(F.count_distinct("v").alias("d")).collect())
