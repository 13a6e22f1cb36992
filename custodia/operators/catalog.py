"""Catalog search, inventories and catalog joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.functions.text import contains_any, glob_to_regex, lit_map

# fixed values: keyword -> table it points at, in the order tables are reported
KEYWORD_TABLES = {
    "revenue": "revenue", "sales": "revenue", "income": "revenue",
    "region": "regions", "geography": "regions", "country": "regions",
    "time": "time_periods", "month": "time_periods", "year": "time_periods", "quarter": "time_periods",
    "customer": "customers", "client": "customers",
    "transaction": "transactions", "purchase": "transactions", "order": "transactions",
}

# fixed values: base type names of the metastore -> SQL names
TYPE_NAMES = {
    "string": "STRING", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "float": "FLOAT",
    "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "date": "DATE", "decimal": "DECIMAL", "binary": "BINARY",
    "array": "ARRAY", "map": "MAP", "struct": "STRUCT",
}


def search_catalog(tables: DataFrame, query: str, limit: int | None = None) -> DataFrame:
    """Best matches for a word: 0.8 for the name, 0.5 for the description, 0.3 for any tag, capped at 1."""
    q = query.lower()
    in_tags = F.exists("tags", lambda t: F.lower(t).contains(q))
    points = (F.when(F.lower("table_name").contains(q), 0.8).otherwise(0.0)
              + F.when(F.lower("description").contains(q), 0.5).otherwise(0.0)
              + F.when(in_tags, 0.3).otherwise(0.0))
    out = tables.withColumn("score", F.least(points, F.lit(1.0))).where("score > 0")
    out = out.select("table_name", F.lit("table").alias("type"), "description", "score").orderBy(F.desc("score"), "table_name")
    return out if limit is None else out.limit(limit)


def search_glob(tables: DataFrame, pattern: str, catalog: str | None = None, schema: str | None = None) -> DataFrame:
    if catalog:
        tables = tables.where(F.col("catalog_name") == catalog)
    if schema:
        tables = tables.where(F.col("schema_name") == schema)
    return tables.where(F.lower("table_name").rlike(glob_to_regex(pattern.lower())))


def search_substring(tables: DataFrame, columns: DataFrame, text: str) -> DataFrame:
    """Tables whose name contains ``text``, with their number of columns."""
    hits = tables.where(F.lower("table_name").contains(text.lower()))
    counts = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("column_count"))
    return hits.join(counts, "table_id", "left").withColumn("column_count", F.coalesce("column_count", F.lit(0)))


def build_catalog(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """Column inventory of the session catalog: one row per column, partition keys included.

    Reads metadata only; the table list is the catalog's own and the result is a DataFrame like any other.
    """
    rows = []
    for db in databases or [d.name for d in spark.catalog.listDatabases()]:
        for table in spark.catalog.listTables(db):
            full = table.name if table.isTemporary else f"{db}.{table.name}"
            for i, c in enumerate(spark.catalog.listColumns(full)):
                rows.append((f"catalog://{full}", db, table.name, c.name, i, c.dataType, c.nullable, c.isPartition))
    return spark.createDataFrame(rows, "uri string, database string, table_name string, column_name string, "
                                       "ordinal int, data_type string, nullable boolean, is_partition boolean")


def flatten_catalog(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Tables and columns as one inventory keyed by ``catalog://schema.table``; the partition field is flagged."""
    uri = F.concat(F.lit("catalog://"), F.col("schema_name"), F.lit("."), F.col("t.table_name"))
    t, c = tables.alias("t"), columns.alias("c")
    return t.join(c, F.col("t.table_id") == F.col("c.table_id")).select(
        uri.alias("uri"), F.col("c.column_name").alias("column_name"), F.col("c.ordinal").alias("ordinal"),
        F.col("c.data_type").alias("data_type"),
        F.coalesce(F.col("c.column_name") == F.col("t.partition_field"), F.lit(False)).alias("is_partition"))


def normalize_types(columns: DataFrame, source: str = "data_type", out: str = "sql_type") -> DataFrame:
    """Upper-case base type; unknown types keep their whole text."""
    base = F.regexp_extract(F.lower(source), r"^[^(<]*", 0)
    return columns.withColumn(out, F.coalesce(F.element_at(lit_map(TYPE_NAMES), base), F.upper(source)))


def accessible_resources(grants: DataFrame, principal: str | None = None, resource_type: str | None = None,
                         catalog: str | None = None, database: str | None = None) -> DataFrame:
    rows = grants.where(F.col("decision") == "ALLOW")
    for column, value in (("principal", principal), ("resource_type", resource_type), ("catalog_name", catalog),
                          ("database_name", database)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def tables_in_text(text: Column, keywords: Mapping[str, str] = KEYWORD_TABLES) -> Column:
    """Array of the tables whose keywords occur in the text, each once, in keyword order."""
    low = F.lower(text)
    return F.array_distinct(F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in keywords.items()])))


def resolve_tables_from_text(questions: DataFrame, keywords: Mapping[str, str] = KEYWORD_TABLES) -> DataFrame:
    return questions.select("question_id", F.explode(tables_in_text(F.col("question"), keywords)).alias("table_name"))


# ---- joins ------------------------------------------------------------------------------------------------

def table_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Every table with its columns; tables without columns stay, with nulls."""
    t, c = tables.alias("t"), columns.alias("c")
    return t.join(c, F.col("t.table_id") == F.col("c.table_id"), "left").select(
        F.col("t.table_id").alias("table_id"), F.col("t.table_name").alias("table_name"), "t.schema_name",
        F.col("c.column_name").alias("column_name"), F.col("c.data_type").alias("data_type"),
        F.col("c.nullable").alias("nullable"))


def table_relationships(rel: DataFrame, tables: DataFrame) -> DataFrame:
    """Both ends of each relationship resolved to table names."""
    a = tables.select(F.col("table_id").alias("from_table_id"), F.col("table_name").alias("from_table"))
    b = tables.select(F.col("table_id").alias("to_table_id"), F.col("table_name").alias("to_table"))
    return rel.join(a, "from_table_id").join(b, "to_table_id").select("from_table", "to_table", "relationship")


def relevant_joins(joins: DataFrame, tables: Sequence[str], exact: bool = False) -> DataFrame:
    """Declared joins touching any of the tables.

    The default tests for the name anywhere in ``from`` or ``to`` (``orders`` also hits ``reorders.id``); ``exact``
    compares the table part before the dot.
    """
    a, b = F.col("from_column"), F.col("to_column")
    if exact:
        return joins.where(F.split(a, r"\.")[0].isin(list(tables)) | F.split(b, r"\.")[0].isin(list(tables)))
    return joins.where(contains_any(a, tables) | contains_any(b, tables))


def normalize_classifications(df: DataFrame, mapping: Mapping[str, str], provider: str = "provider",
                              label: str = "label", out: str = "unified") -> DataFrame:
    """``provider:label`` looked up in the mapping; unmapped labels stay as they are."""
    key = F.concat_ws(":", F.col(provider), F.col(label))
    return df.withColumn(out, F.coalesce(F.element_at(lit_map(dict(mapping)), key), F.col(label)))


def pii_columns_accessible(columns: DataFrame, grants: DataFrame, principal: str,
                           levels: Sequence[str] = ("PII", "PHI", "PCI"),
                           privileges: Sequence[str] = ("SELECT", "ALL")) -> DataFrame:
    """Sensitive columns of the tables a principal may read."""
    mine = grants.where((F.col("principal") == principal) & (F.col("decision") == "ALLOW")
                        & F.col("privilege").isin(list(privileges))).select("table_name")
    return columns.where(F.col("classification").isin(list(levels))).join(mine, "table_name", "left_semi")


def foreign_key_check(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Key values without a parent and how many rows carry them.

    Rows are counted per key before the anti join, so a key that fills a third of the table is one row in it.
    """
    keys = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("key")).agg(
        F.count(F.lit(1)).alias("orphan_rows"))
    return keys.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")
