"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custodia.session import materialize, scratch_path, ship_package

__all__ = ["connected_components", "materialize", "ready", "scratch_path", "spread", "table"]

#: Bounds on one Arrow batch, so that a worker never holds more than a few very long texts at once.
BATCH_ROWS, BATCH_BYTES = 1000, "16m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and ship this package to the Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship_package(spark)


def spread(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Deal rows out over all shuffle partitions by ``keys`` (a salt spreads a hot key)."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(a, b) links between ids of one ordered type -> (node, component), component the smallest id reachable.

    Alternates the large-star and small-star steps. Each round hangs every node on the smallest id that it
    has seen, so the rounds grow with the logarithm of a component's diameter, and no component is ever
    held by one task: minima are combined before the shuffle, and the joins back are plain equi-joins that
    AQE splits at a hot node. A round is written to the shared folder, so a lost executor repeats one round.
    Links with a null end are ignored; no links give no rows.
    """
    links = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    links, _ = materialize(links, label)
    before = None
    while True:
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        root = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        # large star: neighbours above u hang on u's minimum
        large = (both.where("v > u").join(root, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                 .where("hi <> lo").distinct())
        # small star: neighbours below hi, and hi itself, hang on the smallest of them
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(lowest).distinct())
        state = Observation()
        links = small.observe(state, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"))
        path = scratch_path(edges.sparkSession, label)
        links.write.parquet(path)
        links = edges.sparkSession.read.schema(small.schema).parquet(path)
        now = (state.get["n"], state.get["x"])
        if now == before or now[0] == 0:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                links.select("lo", "lo")).distinct()
        before = now
