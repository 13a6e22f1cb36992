"""Storage layout: partition detection, formats, sizes, catalog gaps and layout advice over whole listings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.functions.text import contains_any
from custodia.operators import aggregates as agg
from custodia.operators.ordered import join_null_safe, top_per_key
from custodia.session import materialize

# fixed values: path patterns in the order they are tried: regex, capture groups, column, type, granularity
PATH_PATTERNS = [
    (r"year=(\d{4})/month=(\d{2})/day=(\d{2})", 3, "year/month/day", "HIVE_STYLE", "DAILY"),
    (r"year=(\d{4})/month=(\d{2})", 2, "year/month", "HIVE_STYLE", "MONTHLY"),
    (r"year=(\d{4})", 1, "year", "HIVE_STYLE", "YEARLY"),
    (r"dt=(\d{4}-\d{2}-\d{2})", 1, "dt", "HIVE_STYLE", "DAILY"),
    (r"date=(\d{4}-\d{2}-\d{2})", 1, "date", "HIVE_STYLE", "DAILY"),
    (r"hour=(\d{2})", 1, "hour", "HIVE_STYLE", "HOURLY"),
    (r"/(\d{4})/(\d{2})/(\d{2})/", 3, "date_partition", "YEAR_MONTH_DAY", "DAILY"),
    (r"/(\d{4})/(\d{2})/", 2, "date_partition", "YEAR_MONTH", "MONTHLY"),
    (r"/(\d{4}-\d{2}-\d{2})/", 1, "date_partition", "DATE", "DAILY"),
    (r"/(\d{4}-\d{2}-\d{2})/(\d{2})/", 2, "date_partition", "DATE_HOUR", "HOURLY"),
    (r"/(\d{8})/", 1, "date_partition", "DATE", "DAILY"),
    (r"/(\d{8})(\d{2})/", 2, "date_partition", "DATE_HOUR", "HOURLY"),
]

# fixed values: name parts of likely partition columns -> type, granularity
NAME_PATTERNS = [
    (["date", "dt", "event_date", "created_date", "partition_date", "ingestion_date"], "DATE", "DAILY"),
    (["timestamp", "event_time", "created_at", "updated_at", "ts"], "DATE_HOUR", "HOURLY"),
    (["region", "country", "geo", "location", "country_code"], "LIST", None),
    (["category", "type", "status", "source", "channel"], "LIST", None),
]

# fixed values
CLUSTER_IDS = ["id", "user_id", "customer_id", "account_id", "event_id"]
CLUSTER_CATEGORIES = ["region", "country", "type", "status", "category"]
FORMAT_SUFFIXES = [(".parquet", "parquet"), (".json", "json"), (".jsonl", "json"), (".csv", "csv"), (".avro", "avro"), (".orc", "orc")]
SKIPPED_BUCKETS = ["log", "trail", "config", "backup"]
SYSTEM_CONTAINERS = ["insights-logs", "azure-webjobs"]
LARGE_TABLE_BYTES = 1_000_000_000
DATE_TYPES = ["DATE", "HIVE_STYLE", "YEAR_MONTH_DAY", "DATE_HOUR"]


# ---- paths ------------------------------------------------------------------------------------------------

def bucket_of(path: Column) -> Column:
    """Authority of ``scheme://bucket/key``."""
    return F.substring_index(F.substring_index(path, "/", 3), "/", -1)


def folder_of(path: Column) -> Column:
    """Everything up to and including the last slash."""
    return F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))


def prefix_of(path: Column) -> Column:
    """Folder part of an object key with its trailing slash; empty at the bucket root."""
    root = F.length(F.substring_index(path, "/", 3)) + F.lit(2)
    return F.substring(folder_of(path), root, F.length(path))


def _samples(path: Column, regex: str, groups: int, most: int | None) -> Column:
    """Matches (the first ``most``), each as its captured values joined by slashes."""
    found = F.regexp_extract_all(path, F.lit(regex), F.lit(1 if groups == 1 else 0))
    found = found if most is None else F.slice(found, 1, most)
    if groups == 1:
        return found
    joined = "/".join(f"${g}" for g in range(1, groups + 1))
    return F.transform(found, lambda m: F.regexp_replace(m, regex, joined))


def detect_path_partition(listing: DataFrame, most: int | None = 5) -> DataFrame:
    """First matching pattern per path: column, type, granularity and sample values (the first ``most`` of the path).

    The number of the pattern is found first with plain tests, paths without one are dropped, and only the matching
    pattern extracts its samples. The number comes out of a generator, because a filter on a plain column would be
    pushed below it and repeat all tests, together with whatever expression the path is made of.
    """
    path, number = F.col("path"), F.col("__n")
    which, samples = F, F
    for i, (regex, groups, *_) in enumerate(PATH_PATTERNS):
        rx = "(?i)" + regex if "=" in regex else regex
        which = which.when(path.contains("=") & path.rlike(rx) if "=" in regex else path.rlike(rx), i + 1)
        samples = samples.when(number == i + 1, _samples(path, rx, groups, most))
    def named(values: list) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), number)
    rows = listing.select("*", F.explode(F.array(which)).alias("__n")).where(number.isNotNull())
    return rows.select(
        *listing.columns, named([p[2] for p in PATH_PATTERNS]).alias("column_name"),
        named([p[3] for p in PATH_PATTERNS]).alias("partition_type"), named([p[4] for p in PATH_PATTERNS]).alias("granularity"),
        samples.alias("samples"), named(["=" in p[0] for p in PATH_PATTERNS]).alias("is_hive_style"))


def partition_cardinality(listing: DataFrame) -> DataFrame:
    """Distinct partition values per (column, type) with ten samples.

    Only the folder of a path can match, unless the file name itself has a ``key=value``. So files shrink to
    distinct folders before any pattern is tried.
    """
    path = F.col("path")
    folder = F.when(F.substring_index(path, "/", -1).contains("="), path).otherwise(folder_of(path))
    folders = listing.select(folder.alias("path")).distinct()
    values = detect_path_partition(folders, None).select("column_name", "partition_type", F.explode("samples").alias("value"))
    return agg.sample_set(values, ["column_name", "partition_type"], "value", 10)


def detect_schema_partitions(columns: DataFrame) -> DataFrame:
    """Likely partition columns by type and by name; one column can yield several rows."""
    name, dtype = F.lower("column_name"), F.lower("data_type")
    def cell(kind: str, grain: str | None, rule: int) -> Column:
        return F.struct(F.lit(kind).alias("partition_type"), F.lit(grain).cast("string").alias("granularity"),
                        F.lit(rule).alias("rule"))
    hits = [F.when(contains_any(dtype, ["date", "timestamp"]), cell("DATE", "DAILY", 0))]
    hits += [F.when(contains_any(name, words), cell(kind, grain, i + 1))
             for i, (words, kind, grain) in enumerate(NAME_PATTERNS)]
    return columns.withColumn("__h", F.explode(F.array_compact(F.array(*hits)))).select(*columns.columns, "__h.*")


def recommend_partitioning(detected: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """Layout advice per dataset.

    ``detected`` has one row per detected partition column (dataset, position, column_name, partition_type,
    granularity, cardinality), so what is gathered per dataset is bounded by its number of columns.
    """
    item = F.struct("position", "column_name", "partition_type", "granularity", "cardinality")
    per = detected.groupBy("dataset").agg(F.array_sort(F.collect_list(item)).alias("items"))
    if sizes is not None:
        per = per.join(sizes.select("dataset", "size_gb"), "dataset", "left")
    else:
        per = per.withColumn("size_gb", F.lit(None).cast("double"))
    dates = F.filter("items", lambda x: x["partition_type"].isin(DATE_TYPES))
    lists = F.filter("items", lambda x: x["partition_type"] == "LIST")
    known = F.filter(dates, lambda x: x["granularity"].isNotNull())
    size = F.nullif(F.col("size_gb"), F.lit(0.0))
    by_size = F.when(size > 1000, "HOURLY").when(size > 10, "DAILY").when(size.isNotNull(), "MONTHLY").otherwise("DAILY")
    grain = F.when(F.size(known) > 0, F.get(known, F.lit(0))["granularity"]).otherwise(by_size)
    none = F.lit(None).cast("string")
    def rec(kind: str, cols: Column, g: Column) -> Column:
        return F.struct(F.lit(kind).alias("partition_type"), cols.alias("columns"), g.alias("granularity"))
    hive = F.when(F.size(dates) > 0, F.array(rec("HIVE_STYLE", F.transform(dates, lambda x: x["column_name"]), grain)))
    small = F.filter(lists, lambda x: (x["cardinality"] > 0) & (x["cardinality"] < 100))
    by_list = F.transform(small, lambda x: rec("LIST", F.array(x["column_name"]), none))
    both = F.when((F.size(dates) > 0) & (F.size(lists) > 0), F.array(rec("COMPOSITE", F.array(
        F.get(dates, F.lit(0))["column_name"], F.get(lists, F.lit(0))["column_name"]), grain)))
    empty = F.array().cast("array<struct<partition_type:string,columns:array<string>,granularity:string>>")
    return per.select("dataset", F.inline(F.concat(F.coalesce(hive, empty), by_list, F.coalesce(both, empty))))


def suggest_clustering(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Clustering key per large, unclustered table: first date column (with the first category), else first id."""
    name, dtype = F.lower("column_name"), F.lower("data_type")
    is_date = contains_any(dtype, ["date", "timestamp"])
    is_id = ~is_date & name.isin(CLUSTER_IDS)
    is_cat = ~is_date & name.isin(CLUSTER_CATEGORIES)
    firsts = columns.groupBy("table_id").agg(*[
        F.min_by(F.when(cond, F.col("column_name")), F.when(cond, F.col("ordinal"))).alias(a)
        for a, cond in (("__date", is_date), ("__id", is_id), ("__cat", is_cat))])
    key = F.when(F.col("__date").isNotNull(), F.concat_ws(", ", "__date", "__cat")).otherwise(F.col("__id"))
    size = F.nullif(F.col("bytes"), F.lit(0))
    return (tables.where(F.col("clustering_key").isNull() & (size.isNull() | (size >= LARGE_TABLE_BYTES)))
            .join(firsts, "table_id").withColumn("suggested_key", key).where("suggested_key IS NOT NULL")
            .select("table_id", "table_name", "suggested_key",
                    F.when(F.col("__date").isNotNull(), "time series").otherwise("point lookups").alias("reason")))


# ---- formats and sizes ------------------------------------------------------------------------------------

def format_of(path: Column) -> Column:
    out = F.when(path.contains("_delta_log"), "delta")
    for suffix, name in FORMAT_SUFFIXES:
        out = out.when(path.endswith(suffix), name)
    return out


def detect_formats(listing: DataFrame, level: int = 1) -> DataFrame:
    """Formats found per bucket and leading folder (at most six distinct values per group)."""
    top = F.array_join(F.slice(F.split(prefix_of(F.col("path")), "/"), 1, level), "/")
    rows = listing.select(bucket_of(F.col("path")).alias("bucket"), top.alias("prefix"), format_of(F.col("path")).alias("format"))
    return rows.groupBy("bucket", "prefix").agg(F.array_sort(F.collect_set("format")).alias("formats"),
                                                F.count(F.lit(1)).alias("objects"))


def columnar_advice(formats: DataFrame) -> DataFrame:
    """Buckets with data but without any columnar format."""
    per = formats.select("bucket", F.explode("formats").alias("format")).groupBy("bucket").agg(
        F.array_sort(F.collect_set("format")).alias("formats"))
    return per.where(~F.array_contains("formats", "parquet") & ~F.array_contains("formats", "delta"))


def dataset_sizes(listing: DataFrame) -> DataFrame:
    rows = listing.select(bucket_of(F.col("path")).alias("bucket"), prefix_of(F.col("path")).alias("prefix"), "size")
    return rows.groupBy("bucket", "prefix").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("objects")).withColumn(
        "size_gb", F.col("bytes") / F.lit(1024.0 ** 3))


# ---- catalog gaps -----------------------------------------------------------------------------------------

def prefixes(listing: DataFrame) -> DataFrame:
    """Distinct (bucket, prefix) of a listing, reduced before anything is joined."""
    return listing.select(bucket_of(F.col("path")).alias("bucket"), prefix_of(F.col("path")).alias("prefix")).distinct()


def swept(rows: DataFrame, text: str, marks: DataFrame, mark: str, keys: list[str] = []) -> DataFrame:
    """``rows`` with ``__under`` (``text`` starts with a ``mark`` of the same ``keys``) and ``__over`` (it is the start of one).

    A starts-with join as one sweep over both tables in order of their bytes. What starts with a mark lies between the
    mark and the mark followed by a byte beyond any character, so a row is under a mark if the greatest such end
    among the marks up to it is beyond it, and over one if the next mark is before its own end. The sweep runs in
    each of many ranges; only the greatest end and the first mark of a range pass to the others. Every row is moved
    once and comes out once, however many lengths the marks have, and a busy key is cut into ranges like any other.
    Null texts, marks and keys match nothing.
    """
    end = lambda c: F.concat(c, F.lit(bytes([255])))
    names = [f"__k{i}" for i in range(len(keys))] or ["__k0"]
    key = lambda df: [F.col(k).alias(n) for k, n in zip(keys, names, strict=True)] if keys else [F.lit(0).alias("__k0")]
    held = rows.select(*key(rows), F.col(text).cast("binary").alias("__t"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast("binary").alias("__mark"))
    known = marks.where(F.col(mark).isNotNull()).select(*key(marks), F.col(mark).cast("binary").alias("__t")).distinct()
    known = known.dropna(subset=names).withColumn("__row", F.lit(None).cast(held.schema["__row"].dataType)).withColumn("__mark", F.col("__t"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both, _ = materialize(held.unionByName(known).repartitionByRange(parts, *names, "__t").withColumn("__part", F.spark_partition_id()), "sweep")
    order = Window.partitionBy(*names).orderBy("__part")
    ranges = both.groupBy(*names, "__part").agg(F.max(end(F.col("__mark"))).alias("__end"), F.min("__mark").alias("__first")).select(
        *names, "__part", F.max("__end").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("__end"),
        F.min("__first").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("__first"))
    joined = join_null_safe(both, ranges, [*names, "__part"])
    own = Window.partitionBy(*names, "__part").orderBy("__t")
    last = F.greatest("__end", F.max(end(F.col("__mark"))).over(own.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    after = F.least("__first", F.min("__mark").over(own.rangeBetween(Window.currentRow, Window.unboundedFollowing)))
    out = joined.select("__row", F.coalesce(last > F.col("__t"), F.lit(False)).alias("__under"), F.coalesce(after < end(F.col("__t")), F.lit(False)).alias("__over"))
    return out.where("__row IS NOT NULL").select("__row.*", "__under", "__over")


def uncatalogued_prefixes(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Prefixes not starting with any catalogued prefix of their bucket; an empty one covers the bucket."""
    return swept(found.select("bucket", "prefix").distinct(), "prefix", catalog, "prefix", ["bucket"]).where("NOT __under").select("bucket", "prefix")


def not_covered(found: DataFrame, targets: DataFrame, column: str = "path") -> DataFrame:
    """Paths that neither start with a target nor are the start of one."""
    return swept(found.distinct(), column, targets, column).where("NOT __under AND NOT __over").select(*found.columns)


def containers_to_scan(containers: DataFrame, scanned: DataFrame, per_account: int | None = None) -> DataFrame:
    """Storage containers no scan covers, system containers skipped; ``per_account`` keeps the first of those by position.

    A container is covered when its address occurs in a scanned name (case ignored): when the name, from its address
    onwards, starts with the container's.
    """
    url = F.concat(F.lit("https://"), F.col("account"), F.lit(".blob.core.windows.net/"), F.col("container"))
    rows = containers.withColumn("path", url).where(~F.col("container").startswith("$") & ~F.col("container").isin(SYSTEM_CONTAINERS))
    names = scanned.select(F.regexp_extract(F.lower("qualified_name"), r"(https://.*)$", 1).alias("__t"))
    left = swept(rows.withColumn("__low", F.lower("path")), "__low", names, "__t").where("NOT __over").select(*rows.columns)
    return left if per_account is None else top_per_key(left, ["account"], [F.col("position"), F.col("container")], per_account)


def database_name(bucket: Column, prefix: Column) -> Column:
    raw = F.regexp_replace(F.concat(bucket, F.lit("_"), prefix), "/+$", "")
    name = F.lower(F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9_]", "_"), "_+", "_"))
    # catalogs allow 128 characters; a longer name ends in a hash of all of it, so that no two gaps share one
    return F.when(F.length(name) <= 128, name).otherwise(F.concat(F.substring(name, 1, 95), F.lit("_"), F.md5(raw)))


def catalog_gap_suggestions(listing: DataFrame, catalog: DataFrame, crawlers: DataFrame, per_bucket: int | None = None) -> DataFrame:
    """Uncatalogued prefixes that no crawler covers, with a database name for each; ``per_bucket`` keeps the first of those."""
    gaps = uncatalogued_prefixes(prefixes(listing), catalog)
    gaps = gaps.where(~contains_any(F.lower("bucket"), SKIPPED_BUCKETS))
    gaps = gaps.withColumn("path", F.concat(F.lit("s3://"), F.col("bucket"), F.lit("/"), F.col("prefix")))
    left = not_covered(gaps, crawlers)
    left = left if per_bucket is None else top_per_key(left, ["bucket"], [F.col("prefix")], per_bucket)
    return left.withColumn("database_name", database_name(F.col("bucket"), F.col("prefix")))


# ---- reports ----------------------------------------------------------------------------------------------

def stale_jobs(jobs: DataFrame, as_of: Column, days: int = 30) -> DataFrame:
    """Jobs whose last run lies more than ``days`` whole days back; jobs that never ran are not stale."""
    return jobs.where(F.col("last_run") <= as_of - F.expr(f"INTERVAL {days + 1} DAY"))


def unpartitioned_large_tables(tables: DataFrame) -> DataFrame:
    return tables.where((F.col("table_type") == "TABLE") & F.col("partition_field").isNull()
                        & (F.col("bytes") > LARGE_TABLE_BYTES))


def tables_without_policy_tags(tables: DataFrame) -> DataFrame:
    return tables.where(~F.col("has_policy_tags") & (F.col("row_count") > 0))


# fixed values: partition columns derived from a date column, per granularity
_GRAIN_COLUMNS = {
    "YEARLY": [("year", "yyyy")],
    "MONTHLY": [("year", "yyyy"), ("month", "MM")],
    "DAILY": [("year", "yyyy"), ("month", "MM"), ("day", "dd")],
    "HOURLY": [("year", "yyyy"), ("month", "MM"), ("day", "dd"), ("hour", "HH")],
}


def write_with_layout(df: DataFrame, path: str, date_column: str | None = None, granularity: str = "DAILY",
                      list_columns: Sequence[str] = (), cluster_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Write Parquet in a recommended layout.

    Rows are range-partitioned by partition and cluster columns: a big day is split over several files instead of
    landing in one task, small days share a task, and row-group statistics on the cluster columns stay tight.
    """
    parts = []
    if date_column:
        for name, fmt in _GRAIN_COLUMNS[granularity]:
            df = df.withColumn(name, F.date_format(date_column, fmt))
            parts.append(name)
    parts += list(list_columns)
    keys = [*parts, *cluster_by] + ([date_column] if date_column else [])
    if keys:
        # the row hash comes last, so that even a single hot key value can be cut into ranges
        df = df.repartitionByRange(*keys, F.xxhash64(*df.columns)).sortWithinPartitions(*keys)
    writer = df.write.mode(mode)
    (writer.partitionBy(*parts) if parts else writer).parquet(path)
