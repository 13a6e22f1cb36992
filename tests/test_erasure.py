"""Erasure and retention on stored tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from custodia.functions import masks
from custodia.operators import erasure as er
from custodia.operators.retention import erase_subjects
from custodia.session import scratch_path

REQUEST = "subject_id bigint, exception string"


@pytest.fixture
def root(spark):
    root = scratch_path(spark, "table")
    # five rows a subject, far apart, some without a subject
    rows = spark.range(20000).selectExpr("id", "CASE WHEN id % 1000 = 999 THEN NULL ELSE id % 4000 END AS subject", "repeat('x', 20) AS body")
    assert er.store(rows, root, "subject") == 1
    return root


def _names(spark, root, version=None):
    return {r["file"] for r in er._named(spark, root, version)[0].collect()}


def _wide(spark, parts="40"):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)


@pytest.fixture(autouse=True)
def many_files(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    _wide(spark)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("n", [10, 500])
def test_only_files_that_hold_the_subjects_are_rewritten(spark, root, n):
    # ten subjects within two hundred neighbours, or more than are pushed as a list
    asked = spark.range(n).selectExpr(f"1000 + id * {200 // n if n < 200 else 1} AS subject_id", "CASE WHEN id = 3 THEN 'legal_obligation' END AS exception")
    before, files = er.read_stored(spark, root), er._named(spark, root)[0]
    want = sorted(map(tuple, erase_subjects(before, "subject", asked).select("id", "subject").fillna(-1).collect()))
    assert want != sorted(map(tuple, before.select("id", "subject").fillna(-1).collect()))
    holding = {r["f"] for r in before.select("subject", er._file().alias("f")).join(asked.where("exception IS NULL"), F.col("subject") == F.col("subject_id")).select("f").distinct().collect()}
    assert er.erase_stored(spark, root, "subject", asked) == 2
    got = sorted(map(tuple, er.read_stored(spark, root).select("id", "subject").fillna(-1).collect()))
    kept = _names(spark, root, 1) & _names(spark, root, 2)
    assert _names(spark, root, 1) - kept == holding and 0 < len(holding) < files.count() / 2
    assert len(got) == len(want)
    erased = {r["subject_id"] for r in asked.where("exception IS NULL").collect()}
    assert not erased & {s for _, s in got} and 1003 * (n == 500) in {s for _, s in got} | {0}


def test_readers_see_all_or_nothing(spark, root):
    rows = er.read_stored(spark, root).count()
    # a job that died before its mark: the version is there in part, its files are there
    half = er._named(spark, root)[0].limit(1)
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{root}/versions/v=2")
    assert er.versions(spark, root) == [1] and er.read_stored(spark, root).count() == rows


def test_nothing_asked_nothing_written(spark, root):
    for rows in ([], [(None, None)], [(99999, None)], [(5, "legal_obligation"), (5, None)]):
        assert er.erase_stored(spark, root, "subject", spark.createDataFrame(rows, REQUEST)) == 1
    assert er.versions(spark, root) == [1]


def test_erasing_all_and_vacuum(spark, root):
    er.erase_stored(spark, root, "subject", spark.range(4000).selectExpr("id AS subject_id", "CAST(NULL AS STRING) AS exception"))
    left = er.read_stored(spark, root)
    assert left.count() == 20 and left.where("subject IS NOT NULL").count() == 0
    assert er.read_stored(spark, root, 1).count() == 20000
    removed = er.vacuum(spark, root)
    assert removed > 0 and er.read_stored(spark, root).count() == 20 and er.versions(spark, root) == [2]
    with pytest.raises(LookupError):
        er.read_stored(spark, root, 1)
    assert er.vacuum(spark, root) == 0


def test_empty_table(spark):
    root = scratch_path(spark, "table")
    with pytest.raises(LookupError):
        er.read_stored(spark, root)
    er.store(spark.createDataFrame([], "id bigint, body string"), root, "id")
    assert er.read_stored(spark, root).columns == ["id", "body"] and er.read_stored(spark, root).count() == 0
    assert er.erase_stored(spark, root, "id", spark.createDataFrame([(1, None)], REQUEST)) == 1


def test_retention_of_a_stored_table(spark):
    policy = {"logs": {"delete_days": 100}, "people": {"anonymize_days": 50}, "old": {"archive_days": 10}, "held": {"hold": True, "delete_days": 1}}
    day = dt.date(2024, 6, 1)
    rows = spark.range(4000).selectExpr("id", "'n' || id AS name", "CASE CAST(id / 1000 AS INT) WHEN 0 THEN 'logs' WHEN 1 THEN 'people' WHEN 2 THEN 'old' ELSE 'held' END AS category",
                                        "CAST(date_sub(DATE'2024-06-01', CAST(id % 200 AS INT)) AS TIMESTAMP_NTZ) AS ts",
                                        "CAST(NULL AS TIMESTAMP_NTZ) AS deleted_at", "CAST(NULL AS TIMESTAMP_NTZ) AS anonymized_at")
    root, cold = scratch_path(spark, "table"), scratch_path(spark, "cold")
    er.store(rows, root, "id")
    args = ("id", "ts", day, {"name": masks.mask_hash}, cold)
    assert er.retain_stored(spark, root, *args, policy=policy) == 2
    now = er.read_stored(spark, root)
    assert now.where("category = 'logs' AND deleted_at IS NOT NULL").count() == 500
    assert now.where("category = 'people' AND anonymized_at IS NOT NULL AND name NOT LIKE 'n%'").count() == 750
    assert now.where("category = 'old'").count() == 50 and spark.read.parquet(cold).count() == 950
    assert now.where("category = 'held'").exceptAll(rows.where("category = 'held'")).count() == 0
    # untouched files stay: those with rows under hold alone
    assert _names(spark, root, 1) & _names(spark, root, 2)
    assert er.retain_stored(spark, root, *args, policy=policy) == 2
    # the marked rows leave later, and what is masked is not masked again
    later = er.retain_stored(spark, root, "id", "ts", day + dt.timedelta(days=120), {"name": masks.mask_hash}, cold, policy=policy)
    assert later == 3
    then = er.read_stored(spark, root)
    assert then.where("category = 'logs'").count() == 500 and then.where("category = 'logs' AND deleted_at IS NULL").count() == 0
    first = now.where("anonymized_at IS NOT NULL").select("id", "name")
    assert first.exceptAll(then.select("id", "name")).count() == 0
