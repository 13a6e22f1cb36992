"""Erasure and retention as jobs on stored tables that rewrite only the files they must.

A stored table is a folder with ``data`` (Parquet files in generations, one folder per write) and ``versions`` (one
small table per version that names its files, with their rows and the least and greatest key). A job

1. finds the files that hold rows in question: the key range of each file excludes most, statistics and Bloom filters
   in the footers of the others spare them their pages, and only the key column is read;
2. rewrites those files into a new generation;
3. publishes a version: what it names is written whole before its ``_SUCCESS`` mark, and readers take the greatest
   version so marked, so they see all of a job or nothing of it. A job that dies leaves files that no version names;
4. with ``vacuum``, at last removes the files that no kept version names, which makes the erasure final.

Rows are laid out in ranges of the key, so that a subject's rows lie in few files. The names of the files, not their
contents, pass the driver, as they do for any Parquet table. One job at a time may write to a table.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from custodia import policies as P
from custodia.functions.text import lit_array
from custodia.operators.retention import ERASURE_EXCEPTIONS, enforce_retention, lifecycle_action
from custodia.session import materialize, ship_package
from custodia.sources.listing import expand, list_files, open_store

# up to so many keys are held against the files' ranges one by one and pushed to the files; more are joined
PUSHED_KEYS = 200


def _file() -> Column:
    """Generation and name of the file that a row comes from."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    return sorted(int(mark.split("/v=")[-1].split("/")[0]) for mark in expand(spark, f"{root}/versions/v=*/_SUCCESS"))


def _named(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, StructType, int]:
    """Files of a version (the last one unless told), the schema of the table and the number of the version."""
    known = versions(spark, root)
    version = version if version is not None else (known or [None])[-1]
    if version not in known:
        raise LookupError(f"no version {version} of {root}" if known else f"no table at {root}")
    rows = spark.read.parquet(f"{root}/versions/v={version}")
    schema = StructType.fromJson(json.loads(rows.where("file IS NULL").first()["schema"]))
    return rows.where("file IS NOT NULL").drop("schema"), schema, version


def _open(spark: SparkSession, root: str, files: DataFrame, schema: StructType) -> DataFrame:
    names = [f"{root}/data/{r['file']}" for r in files.select("file").collect()]
    return spark.read.schema(schema).parquet(*names) if names else spark.createDataFrame([], schema)


def _write(rows: DataFrame, root: str, key: str) -> DataFrame:
    """A new generation of files, and what a version says of them."""
    path = f"{root}/data/{uuid.uuid4().hex}"
    bloom = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.adaptive.enabled#{key}": "true"}
    rows.repartitionByRange(key).sortWithinPartitions(key).write.options(**bloom).parquet(path)
    written = rows.sparkSession.read.schema(rows.schema).parquet(path).select(key, _file().alias("file"))
    return written.groupBy("file").agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("most"))


def _publish(files: DataFrame, schema: StructType, root: str, version: int) -> int:
    about = files.sparkSession.createDataFrame([(schema.json(),)], "schema string")
    whole = files.unionByName(about, allowMissingColumns=True)
    whole.coalesce(1).write.mode("errorifexists").parquet(f"{root}/versions/v={version}")
    return version


def store(df: DataFrame, root: str, key: str) -> int:
    """Write ``df`` as the next version of the table at ``root``, in place of what it held; returns the version."""
    known = versions(df.sparkSession, root)
    return _publish(_write(df, root, key), df.schema, root, (known or [0])[-1] + 1)


def read_stored(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of the last version published, or of the one named."""
    files, schema, _ = _named(spark, root, version)
    return _open(spark, root, files, schema)


def _rewrite(spark: SparkSession, root: str, key: str, touched: DataFrame, change: Callable[[DataFrame, int], DataFrame]) -> int:
    """Publish a version in which the ``touched`` files are replaced by what ``change(rows, version)`` makes of them."""
    files, schema, version = _named(spark, root)
    touched, n = materialize(touched, "touched")
    if n == 0:
        return version
    rows = _open(spark, root, touched, schema)
    new = _write(change(rows, version + 1).select(*schema.names), root, key)
    return _publish(files.join(touched, "file", "left_anti").unionByName(new), schema, root, version + 1)


def holding(spark: SparkSession, root: str, key: str, ids: DataFrame) -> DataFrame:
    """(file) of the last version for each file that holds a row of the ids (one column, distinct, not null)."""
    files, schema, _ = _named(spark, root)
    name = ids.columns[0]
    few = [r[0] for r in ids.limit(PUSHED_KEYS + 1).collect()]
    if len(few) <= PUSHED_KEYS:
        near = files.where(F.exists(lit_array(few), lambda k: k.between(F.col("least"), F.col("most")))) if few else files.limit(0)
        rows = _open(spark, root, near, schema)
        return rows.where(F.col(key).isin(few)).select(_file().alias("file")).distinct() if few and near.count() else near.select("file")
    least, most = ids.agg(F.min(name), F.max(name)).first()
    near = files.where((F.col("most") >= least) & (F.col("least") <= most))
    if near.isEmpty():
        return near.select("file")
    keyed = _open(spark, root, near, schema).select(F.col(key).alias("__key"), _file().alias("file"))
    return keyed.join(ids.select(F.col(name).alias("__key")), "__key", "left_semi").select("file").distinct()


def erase_stored(spark: SparkSession, root: str, key: str, requests: DataFrame, exceptions: Sequence[str] = ERASURE_EXCEPTIONS) -> int:
    """Erase the requested subjects from the table at ``root``; returns the version in which they are gone.

    ``requests`` has subject_id and exception; a subject with one of the exceptions on any request stays, a null
    subject asks for nothing. Where no file holds a subject, nothing is written and the version stays. Earlier
    versions still hold the subjects until ``vacuum``.
    """
    exempt = F.coalesce(F.col("exception").isin(list(exceptions)), F.lit(False))
    ids = requests.where("subject_id IS NOT NULL").groupBy("subject_id").agg(F.bool_or(exempt).alias("__keep"))
    ids, _ = materialize(ids.where(~F.col("__keep")).select(F.col("subject_id").alias("__id")), "subjects")
    return _rewrite(spark, root, key, holding(spark, root, key, ids),
                    lambda rows, _: rows.join(ids, F.col(key) == F.col("__id"), "left_anti"))


def retain_stored(spark: SparkSession, root: str, key: str, ts_col: str, as_of: dt.date, pii: Mapping[str, Callable[[Column], Column]],
                  archive: str | None = None, category: str = "category", deleted_at: str = "deleted_at",
                  anonymized_at: str = "anonymized_at", policy: Mapping[str, Mapping] = P.RETENTION) -> int:
    """Bring the table at ``root`` to what retention asks of it on ``as_of``; only files with a row to change are rewritten.

    The table has the timestamps ``deleted_at`` and ``anonymized_at``. Rows due for deletion are marked, and leave
    once the mark is old enough; rows due for anonymisation are masked once; rows due for the archive move to
    ``archive`` (a folder per version, so that a repeated job replaces its own), or stay where there is none. A second
    run on the same day finds nothing to do.
    """
    files, schema, _ = _named(spark, root)
    today = F.lit(as_of).cast("timestamp_ntz")
    purge = F.date_sub(F.lit(as_of), P.SOFT_DELETE_DAYS).cast("timestamp_ntz")
    action = F.col("lifecycle_action")
    mask = (action == "anonymize") & F.col(anonymized_at).isNull()
    due = mask | ((action == "delete") & (F.col(deleted_at).isNull() | (F.col(deleted_at) <= purge)))
    if archive is not None:
        due = due | (action == "archive")
    every = _open(spark, root, files, schema)
    if files.isEmpty():
        return _named(spark, root)[2]
    touched = lifecycle_action(every.withColumn("__file", _file()), ts_col, as_of, category, policy)
    touched = touched.where(F.coalesce(due, F.lit(False))).select(F.col("__file").alias("file")).distinct()

    def change(rows: DataFrame, version: int) -> DataFrame:
        rows = enforce_retention(rows, ts_col, as_of, {}, deleted_at, category, policy)
        rows = rows.withColumns({**{c: F.when(mask, fn(F.col(c))).otherwise(F.col(c)) for c, fn in pii.items()},
                                 anonymized_at: F.when(mask, today).otherwise(F.col(anonymized_at))})
        if archive is None:
            return rows
        rows.where(action == "archive").drop("lifecycle_action").write.mode("overwrite").option("compression", "gzip").parquet(f"{archive}/version={version}")
        return rows.where(action != "archive")

    return _rewrite(spark, root, key, touched, change)


def _delete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            store_, inner, _ = open_store(path)
            try:
                store_.delete_file(inner)
            except FileNotFoundError:
                pass  # a task that was lost had done it
        yield batch[["path"]]


def vacuum(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Remove all but the last ``keep`` versions, and every file of the table that none of those names; returns how many.

    The versions go first, so a reader that comes later finds what it is told of. Files are removed in tasks.
    """
    if keep < 1:
        raise ValueError("the last version stays")
    known = versions(spark, root)
    live = None
    for version in known[-keep:]:
        files = _named(spark, root, version)[0].select("file")
        live = files if live is None else live.unionAll(files)
    if live is None:
        raise LookupError(f"no table at {root}")
    ship_package(spark)
    for version in known[:-keep]:
        store_, inner, _ = open_store(f"{root}/versions/v={version}")
        store_.delete_file(f"{inner}/_SUCCESS")
        store_.delete_dir(inner)
    stored = list_files(spark, f"{root}/data").where("path LIKE '%.parquet'").withColumn("file", F.substring_index("path", "/", -2))
    dead = stored.join(live.distinct(), "file", "left_anti").select("path")
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return materialize(dead.repartition(width).mapInPandas(_delete, "path string"), "vacuum")[1]
