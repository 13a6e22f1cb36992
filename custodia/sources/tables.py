"""Tables, listings and files: reading by URI or by detected format, exports and archives."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.operators.layout import format_of
from custodia.operators.querylog import ALLOWED_FIRST, BLOCKED
from custodia.sources.listing import Lister, list_files, list_folder, walk_levels

URI = re.compile(r"^catalog://([a-zA-Z_][a-zA-Z0-9_]*)\.([a-zA-Z_][a-zA-Z0-9_]*)$")
EXPORT_FORMATS = ("json", "csv")
EXTERNAL_FORMATS = ("avro", "delta")


def object_listing(spark: SparkSession, path: str, lister: Lister = list_folder) -> DataFrame:
    """(path, size, mtime) of every file below ``path``, listed in tasks; contents are not read."""
    return list_files(spark, path, lister)


def parse_uri(uri: str) -> tuple[str, str]:
    found = URI.match(uri)
    if not found:
        raise ValueError(f"not a dataset URI: {uri!r}")
    return found[1], found[2]


def read_table(spark: SparkSession, uri: str, fallback: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Table behind ``catalog://db.table``: the session catalog first, then the fallback map."""
    db, table = parse_uri(uri)
    if spark.catalog.databaseExists(db) and spark.catalog.tableExists(f"{db}.{table}"):
        return spark.table(f"{db}.{table}")
    if fallback and uri in fallback:
        return fallback[uri]
    raise LookupError(f"no table for {uri}")


# literals and quoted names are kept, comments are cut, and neither is looked for inside the other
_LITERAL_OR_COMMENT = re.compile(r"""('(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`[^`]*`)|--[^\n]*|/\*.*?\*/""", re.S)


def strip_comments(sql: str) -> str:
    return _LITERAL_OR_COMMENT.sub(lambda m: m[1] or " ", sql)


def _writes(spark: SparkSession, sql: str, names: Mapping[str, object]) -> str | None:
    """The first command or insert of the parsed statement, if it holds one; SHOW, DESCRIBE and EXPLAIN are reads."""
    for name in names:
        sql = sql.replace("{" + name + "}", f"`{name}`")
    jvm = spark._jvm
    command = jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command", False, jvm.java.lang.Thread.currentThread().getContextClassLoader())
    todo = [(spark._jsparkSession.sessionState().sqlParser().parsePlan(sql), True)]
    while todo:
        node, top = todo.pop()
        kind = node.getClass().getSimpleName()
        if not (top and re.match("Show|Describe|Explain", kind)) and (command.isInstance(node) or re.search("Insert|Merge|Update|Delete", kind)):
            return kind
        for below in (node.children(), node.innerChildren()):
            todo += [(below.apply(i), False) for i in range(below.size()) if hasattr(below.apply(i), "innerChildren")]
    return None


def check_read_only(sql: str, spark: SparkSession | None = None, names: Mapping[str, object] = {}) -> None:
    """Refuse anything but one read statement: by its words, and with a session by its parsed plan."""
    text = strip_comments(sql).strip()
    words = text.split()
    if not words or words[0].upper() not in ALLOWED_FIRST:
        raise PermissionError("only read statements are allowed")
    for keyword in BLOCKED:
        if re.search(rf"\b{keyword}\b", text.upper()):
            raise PermissionError(f"blocked operation: {keyword}")
    if len([s for s in text.split(";") if s.strip()]) > 1:
        raise PermissionError("one statement at a time")
    if spark is not None and (found := _writes(spark, sql, names)):
        raise PermissionError(f"blocked operation: {found}")


def execute(spark: SparkSession, sql: str, max_rows: int | None = None, **tables: DataFrame) -> DataFrame:
    """Read-only SQL, cut to ``max_rows`` where given; tables given by name are referenced as ``{name}``. Values keep their types."""
    check_read_only(sql, spark, tables)
    out = spark.sql(sql, **tables)
    return out if max_rows is None else out.limit(max_rows)


def export_result(df: DataFrame, path: str, fmt: str = "json", mode: str = "errorifexists") -> None:
    if fmt not in EXPORT_FORMATS:
        raise ValueError(f"export format must be one of {EXPORT_FORMATS}")
    writer = df.write.mode(mode)
    writer.json(path) if fmt == "json" else writer.option("header", "true").csv(path)


def archive(df: DataFrame, path: str, category: str = "retention_category", mode: str = "append") -> None:
    """Cold-tier copy: gzip, one folder per retention category."""
    df.hint("rebalance", F.col(category)).write.mode(mode).option("compression", "gzip").partitionBy(category).parquet(path)


def refresh_partitions(spark: SparkSession, table: str) -> None:
    """Make partition folders written behind the catalog's back visible."""
    spark.catalog.recoverPartitions(table)


def write_audit(df: DataFrame, path: str) -> None:
    """Append audit rows, partitioned by event date (so retention drops whole folders)."""
    dated = df.withColumn("event_date", F.to_date("timestamp"))
    dated.hint("rebalance", F.col("event_date")).write.mode("append").partitionBy("event_date").parquet(path)


def detect_format(spark: SparkSession, path: str, thorough: bool = False, lister: Lister = list_folder) -> str:
    """Format of the files below ``path``; a delta log decides, otherwise there must be exactly one format.

    The folders of a level are listed in tasks, and only the names of formats come back. The uppermost level that
    holds files of a known format decides, as all files of a table lie at the same depth; ``thorough`` looks at all.
    """
    found = set()
    name = F.substring_index(F.col("path"), "/", -1)
    for level in walk_levels(spark, path, lister, hidden=True):
        shown = F.when(F.col("is_folder"), F.when(name == "_delta_log", "delta")).when(~name.rlike(r"^[_.]"), format_of(F.col("path")))
        found |= {r["f"] for r in level.select(shown.alias("f")).where("f IS NOT NULL").distinct().collect()}
        if "delta" in found:
            return "delta"
        if found and not thorough or len(found) > 1:
            break
    if len(found) != 1:
        raise ValueError(f"{path} holds {sorted(found) or 'no known format'}")
    return found.pop()


def read_any(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    fmt = detect_format(spark, path)
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    if fmt == "csv":
        reader = reader.option("header", "true")
    try:
        return reader.load(path)
    except Exception as exc:
        if fmt in EXTERNAL_FORMATS and ("find" in str(exc).lower() or "data source" in str(exc).lower()):
            raise RuntimeError(f"reading {fmt} needs its Spark package on the classpath") from exc
        raise


def register_source(spark: SparkSession, source: type) -> None:
    """Register a user-supplied Python ``DataSource`` so that ``spark.read.format(name)`` finds it."""
    spark.dataSource.register(source)
