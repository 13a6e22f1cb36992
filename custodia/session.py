"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Settings every operator is written against. They matter most on skewed keys: AQE splits hot join
# partitions and coalesces small ones, and the advisory size keeps a reduce task inside executor memory.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "custodia", master: str | None = None, **conf: str) -> SparkSession:
    """Create (or reuse) a session with the settings above; ``conf`` wins over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> SparkSession:
    """Give this package to the Python workers, once per application; they need not find it on their own path.

    The driver serves the archive to each executor.
    """
    sc = spark.sparkContext
    if getattr(sc, "_custodia_shipped", None) is None:
        root = os.path.dirname(os.path.abspath(__file__))
        archive = os.path.join(tempfile.mkdtemp(), "custodia_workers.zip")
        with zipfile.ZipFile(archive, "w") as out:
            for folder, _, names in os.walk(root):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        out.write(path, os.path.relpath(path, os.path.dirname(root)))
        sc.addPyFile(archive)
        sc._custodia_shipped = archive
    return spark


def work_root(spark: SparkSession) -> str:
    """Folder shared by all executors: ``spark.checkpoint.dir`` as the cluster names it.

    Only a local session may fall back to a folder of its own; on a cluster a machine-local folder
    would be lost with its executor, so a missing setting is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    sc = spark.sparkContext
    if sc.master.startswith("local-cluster") or not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = "file://" + tempfile.mkdtemp(prefix="custodia-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    return f"{work_root(spark).rstrip('/')}/custodia/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str = "stage") -> tuple[DataFrame, int]:
    """Write ``df`` to the shared folder; return it as read back, with its row count.

    Cuts the lineage of an iterative plan so that a lost executor costs one stage, not the whole walk,
    and gives Catalyst the true size of the data for its next join choice. The count is observed while
    writing, so asking whether a frontier is empty costs no further job.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def lay_out(df: DataFrame, key: str, label: str = "layout") -> DataFrame:
    """``df`` written to the shared folder in buckets by the hash of ``key``, sorted by it within each, and read as such.

    A join on ``key`` with any other data moves that data only, not these rows, however often it runs. There are as
    many buckets as shuffle partitions, one file each. The catalog knows the table for a moment only; the files stay.
    """
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, path = f"custodia_{label}_{uuid.uuid4().hex}", scratch_path(spark, label)
    df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
