"""Listings and inventories of stored files, made in tasks.

A walk goes down folder by folder: the folders of one level are spread over the tasks, each task lists its own and
gives back what it found, and the folders among that are the next level. The driver only ever sees how many folders
a level has. A task holds one folder's entries at a time; levels are written to the shared folder, so that a lost
executor costs one level.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.session import materialize, ship_package

ENTRY = "path string, size bigint, mtime timestamp, is_folder boolean"
COLUMN = "path string, column_name string, ordinal int, data_type string, nullable boolean, rows bigint"

Entry = tuple[str, int, float, bool]
Lister = Callable[[str], Iterable[Entry]]

# how Spark's names of stores are spelt by the file systems that the workers use
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _split(path: str) -> tuple[str, str]:
    """(scheme with its colon, rest); a path without a scheme is a local one."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return "file:", path
    return scheme + ":", rest


def open_store(path: str):
    """(file system, path in it, prefix that makes a full path of one in it) as seen by a worker."""
    from pyarrow import fs

    scheme, rest = _split(path)
    if scheme == "file:":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file:"
    store, inner = fs.FileSystem.from_uri(SCHEMES.get(scheme[:-1], scheme[:-1]) + ":" + rest)
    at = rest.find(inner)
    return store, inner, scheme + (rest[:at] if at >= 0 else "//")


def list_folder(path: str) -> Iterator[Entry]:
    """Entries of one folder: path, size, seconds since 1970 and whether it is a folder.

    A file is its own only entry; a missing folder is an error.
    """
    from pyarrow import fs

    store, inner, prefix = open_store(path)
    try:
        found = store.get_file_info(fs.FileSelector(inner))
    except OSError:
        found = [store.get_file_info(inner)]
        if found[0].type != fs.FileType.File:
            raise
    for info in found:
        folder = info.type == fs.FileType.Directory
        yield prefix + info.path, 0 if folder else info.size, (info.mtime_ns or 0) / 1e9, folder


def _is_hidden(path: str) -> bool:
    """Names that Spark's readers pass over: ``_x`` (unless a partition folder, ``_x=1``) and ``.x``."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def _entries(lister: Lister, hidden: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for folder in batch["path"]:
                rows = [e for e in lister(folder) if hidden or not _is_hidden(e[0])]
                out = pd.DataFrame(rows, columns=["path", "size", "mtime", "is_folder"])
                out["mtime"] = pd.to_datetime((out["mtime"].astype("float64") * 1e6).round().astype("int64"), unit="us").astype("datetime64[us]")
                yield out.astype({"size": "int64", "is_folder": "bool"})
    return run


def expand(spark: SparkSession, path: str) -> list[str]:
    """The folders that a path with wildcards stands for; any other path is itself."""
    if not set(path) & set("*?[{"):
        return [path]
    pattern = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = pattern.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(pattern)
    return [str(status.getPath()) for status in found or []]


def walk_levels(spark: SparkSession, path: str, lister: Lister = list_folder, hidden: bool = False) -> Iterator[DataFrame]:
    """The entries of each level below ``path``, top first, as stored DataFrames; the caller may stop at any level."""
    ship_package(spark)
    roots = expand(spark, path)
    if not roots:
        raise FileNotFoundError(path)
    folders, n = spark.createDataFrame([(root,) for root in roots], "path string"), len(roots)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while n:
        spread = folders.repartition(min(n, width)) if n > 1 else folders
        level, _ = materialize(spread.mapInPandas(_entries(lister, hidden), ENTRY), "level")
        yield level
        folders = level.where("is_folder").select("path")
        n = folders.count()


def list_files(spark: SparkSession, path: str, lister: Lister = list_folder, hidden: bool = False) -> DataFrame:
    """(path, size, mtime) of every file below ``path``, listed in tasks; contents are not read.

    ``lister`` is called in the workers with one folder and yields its entries; give one of your own for a store that
    ``open_store`` does not know. An empty folder gives no row, a path that is a file is an error of the lister.
    """
    out = None
    for level in walk_levels(spark, path, lister, hidden):
        files = level.where(~F.col("is_folder")).select("path", "size", "mtime")
        out = files if out is None else out.unionAll(files)
    return out


# ---- inventory of a warehouse folder ----------------------------------------------------------------------

def _columns_of(file) -> Iterator[tuple[str, str, bool]]:
    """Name, Spark's name of the type and nullability of each column of a Parquet file.

    An instant in the old 96-bit form has no time zone in Arrow and is a ``timestamp`` to Spark.
    """
    from pyspark.sql.pandas.types import from_arrow_type

    leaves = [file.schema.column(i) for i in range(len(file.schema))]
    old = {leaf.path.split(".")[0] for leaf in leaves if leaf.physical_type == "INT96"}
    for column in file.schema_arrow:
        yield column.name, from_arrow_type(column.type, prefer_timestamp_ntz=column.name not in old).simpleString(), column.nullable


def _footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import parquet

    names = ["path", "column_name", "ordinal", "data_type", "nullable", "rows"]
    for batch in batches:
        for path in batch["path"]:
            store, inner, _ = open_store(path)
            with store.open_input_file(inner) as handle:
                file = parquet.ParquetFile(handle)
                rows = [(path, name, i, kind, null, file.metadata.num_rows) for i, (name, kind, null) in enumerate(_columns_of(file))]
            yield pd.DataFrame(rows, columns=names)


def crawl_tables(spark: SparkSession, root: str, lister: Lister = list_folder) -> DataFrame:
    """Column inventory of the tables stored as Parquet below ``root``, one folder each, from their files alone.

    One row per table, column and type: uri, ordinal (the smallest of any file), nullable (in any file), is_partition,
    files and rows that have it so, and n_types, which is above 1 where the files of a table disagree. Keys of
    partition folders (``key=value``) are columns of type string behind the others. Listing and the reading of
    footers run in tasks, one row per file and column comes out of them and is summed before it is moved.
    """
    base = "/" + root.rstrip("/").rsplit("/", 1)[-1] + "/"
    files = list_files(spark, root, lister).where(F.col("path").endswith(".parquet"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # a table's name is the first folder below the root, and a file directly below it belongs to none
    below = F.substring_index("path", base, -1)
    files = files.where(below.contains("/")).select("path").repartition(width, "path")
    found, _ = materialize(files.mapInPandas(_footers, COLUMN), "footers")
    found = found.withColumn("table_name", F.substring_index(below, "/", 1))
    plain = found.groupBy("table_name", "column_name", "data_type").agg(
        F.min("ordinal").alias("ordinal"), F.bool_or("nullable").alias("nullable"), F.count("*").alias("files"), F.sum("rows").alias("rows"))
    # each file once, for the keys of its folders
    keys = F.regexp_extract_all(F.col("path"), F.lit("/([^/=]+)=[^/]*(?=/)"), F.lit(1))
    parts = found.where("ordinal = 0").select("table_name", "rows", F.posexplode(keys).alias("level", "column_name"))
    parts = parts.groupBy("table_name", "column_name").agg(
        (F.min("level") + F.lit(1 << 20)).alias("ordinal"), F.count("*").alias("files"), F.sum("rows").alias("rows"))
    both = plain.withColumn("is_partition", F.lit(False)).unionByName(
        parts.withColumns({"data_type": F.lit("string"), "nullable": F.lit(False), "is_partition": F.lit(True)}))
    types = both.groupBy("table_name", "column_name").agg(F.count("*").alias("n_types"))
    uri = F.concat(F.lit(f"catalog://{os.path.basename(root.rstrip('/'))}."), F.col("table_name"))
    return both.join(types, ["table_name", "column_name"]).select(
        uri.alias("uri"), "table_name", "column_name", "ordinal", "data_type", "nullable", "is_partition", "files", "rows", "n_types")
