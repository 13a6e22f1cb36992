"""Listings and inventories made in tasks."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from custodia.session import scratch_path
from custodia.sources import listing
from custodia.sources import tables as tab


def _local(path):
    return path.removeprefix("file://").removeprefix("file:")


@pytest.fixture(scope="module")
def tree(spark):
    root = scratch_path(spark, "tree")
    spark.range(60).selectExpr("id", "id % 3 AS a", "id % 5 AS b").repartition("a", "b").write.partitionBy("a", "b").parquet(root)
    return root


def test_every_file_of_every_level(spark, tree):
    got = {(_local(r["path"]), r["size"]) for r in listing.list_files(spark, tree).collect()}
    want = {(os.path.join(at, n), os.path.getsize(os.path.join(at, n)))
            for at, _, names in os.walk(_local(tree)) for n in names if n[0] not in "._"}
    assert got == want and len(got) == 15
    old = {_local(r["path"]) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tree).select("path").collect()}
    assert old == {p for p, _ in got}


def test_hidden_files_and_times(spark, tree):
    rows = listing.list_files(spark, tree, hidden=True).collect()
    assert any(r["path"].endswith("/_SUCCESS") for r in rows) and len(rows) > 15
    assert all(abs((dt.datetime.now() - r["mtime"]).total_seconds()) < 86400 for r in rows)


def test_one_file_wildcards_nothing(spark, tree):
    one = listing.list_files(spark, tree).first()["path"]
    assert [r["path"] for r in listing.list_files(spark, one).collect()] == [one]
    assert listing.list_files(spark, tree + "/a=*/b=1").count() == 3
    empty = scratch_path(spark, "empty")
    os.makedirs(_local(empty))
    assert listing.list_files(spark, empty).count() == 0
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, tree + "/no*")
    with pytest.raises(Exception):
        listing.list_files(spark, tree + "/missing").count()


def test_a_lister_of_your_own_and_levels_only_as_far_as_asked(spark):
    def store(folder):
        depth = folder.count("/")
        if depth < 4:
            return [(f"{folder}/{i}", 0, 0.0, True) for i in range(10)]
        return [(f"{folder}/x.csv", 7, 1.0, False)]

    out = listing.list_files(spark, "m:/", store)
    assert out.count() == 1000 and out.agg(F.sum("size")).first()[0] == 7000
    levels = listing.walk_levels(spark, "m:/", store)
    assert next(levels).count() == 10 and next(levels).count() == 100


def test_format_is_known_from_the_first_level_with_files(spark):
    seen = spark.sparkContext.accumulator(0)

    def store(folder):
        seen.add(1)
        if folder.endswith("/t"):
            return [("m:/t/a=1", 0, 0.0, True), ("m:/t/a=2", 0, 0.0, True), ("m:/t/_SUCCESS", 0, 0.0, False)]
        return [(folder + "/x.orc", 1, 0.0, False), (folder + "/deep", 0, 0.0, True)]

    assert tab.detect_format(spark, "m:/t", lister=store) == "orc" and seen.value == 3

    def delta(folder):
        return [("m:/t/_delta_log", 0, 0.0, True), ("m:/t/x.parquet", 1, 0.0, False)]

    assert tab.detect_format(spark, "m:/t", lister=delta) == "delta"

    def mixed(folder):
        return [("m:/t/x.orc", 1, 0.0, False), ("m:/t/a", 0, 0.0, True)] if folder.endswith("/t") else [("m:/t/a/y.json", 1, 0.0, False)]

    assert tab.detect_format(spark, "m:/t", lister=mixed) == "orc"
    with pytest.raises(ValueError):
        tab.detect_format(spark, "m:/t", thorough=True, lister=mixed)


def test_inventory_from_footers(spark):
    root = scratch_path(spark, "house")
    spark.range(30).selectExpr("id", "id % 2 AS day", "array(id) AS ids", "named_struct('x', 1.5D) AS s", "TIMESTAMP '2024-01-01' AS at").write.partitionBy("day").parquet(f"{root}/a")
    spark.range(4).selectExpr("id").write.parquet(f"{root}/b")
    # a later file of b spells its column otherwise and adds one
    spark.range(5).selectExpr("CAST(id AS STRING) AS id", "1 AS more").write.mode("append").parquet(f"{root}/b")
    spark.range(1).write.json(f"{root}/c")
    got = {(r["table_name"], r["column_name"], r["data_type"]): (r["is_partition"], r["rows"], r["n_types"]) for r in listing.crawl_tables(spark, root).collect()}
    assert got == {
        ("a", "id", "bigint"): (False, 30, 1), ("a", "ids", "array<bigint>"): (False, 30, 1), ("a", "s", "struct<x:double>"): (False, 30, 1),
        ("a", "at", "timestamp"): (False, 30, 1), ("a", "day", "string"): (True, 30, 1),
        ("b", "id", "bigint"): (False, 4, 2), ("b", "id", "string"): (False, 5, 2), ("b", "more", "int"): (False, 5, 1)}
