"""Classification, value scanning, column statistics and data quality."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.numbers import pct
from custodia.functions.text import contains_any, first_match, glob_to_regex, lit_array, tags
from custodia.operators import aggregates as agg
from custodia.operators.quantiles import percentiles

# fixed values: name parts that mark personal and sensitive columns
PII_NAMES = ["email", "phone", "ssn", "social_security", "address", "name", "first_name", "last_name", "birth", "dob"]
SENSITIVE_NAMES = ["password", "secret", "token", "key", "credential", "card", "account", "salary", "income"]

# fixed values: classification levels, lowest first
LEVELS = ["PUBLIC", "INTERNAL", "CONFIDENTIAL", "PII", "RESTRICTED"]

# fixed values: column patterns of the privacy policy -> handling
PRIVACY_PATTERNS = [
    ("*.email", "RESTRICTED"), ("*.phone", "RESTRICTED"), ("*.ssn", "RESTRICTED"), ("*.national_id", "RESTRICTED"),
    ("customers.name", "RESTRICTED"), ("users.name", "RESTRICTED"),
    ("*.birth_date", "SENSITIVE"), ("*.postal_code", "SENSITIVE"), ("*.ip_address", "SENSITIVE"), ("*.device_id", "SENSITIVE"),
    ("*.browsing_history", "SENSITIVE"), ("*.purchase_history", "SENSITIVE"), ("*.location_data", "SENSITIVE"),
]

# fixed values per provider: exact labels, then keyword rungs tried in order, then the default level.
# "starts" holds label prefixes. All comparisons ignore case.
PROVIDER_LEVELS = {
    "aws": {
        "keywords": [(["pii", "personal", "ssn", "email"], "PII"), (["phi", "health", "medical"], "PHI"),
                     (["pci", "card", "payment"], "PCI"), (["restricted", "secret", "credential"], "RESTRICTED"),
                     (["confidential", "financial"], "CONFIDENTIAL"), (["internal"], "INTERNAL")],
        "default": "PUBLIC",
    },
    "azure": {
        "starts": [("microsoft.personal", "PII"), ("microsoft.financial", "CONFIDENTIAL"), ("microsoft.government", "PII"),
                   ("microsoft.security", "RESTRICTED"), ("microsoft.health", "PHI")],
        "keywords": [(["pii", "personal", "ssn", "email"], "PII"), (["phi", "health"], "PHI"),
                     (["pci", "card", "payment"], "PCI"), (["confidential"], "CONFIDENTIAL")],
        "default": "INTERNAL",
    },
    "gcp": {
        "exact": {"person_name": "PII", "phone_number": "PII", "email_address": "PII", "street_address": "PII",
                  "credit_card_number": "PCI", "us_social_security_number": "PII", "us_passport": "PII",
                  "date_of_birth": "PII", "medical_record_number": "PHI", "health_insurance_id": "PHI",
                  "aws_credentials": "RESTRICTED", "gcp_credentials": "RESTRICTED", "password": "RESTRICTED"},
        "keywords": [(["pii", "personal"], "PII"), (["phi", "health"], "PHI"), (["pci", "card", "payment"], "PCI"),
                     (["restricted", "secret"], "RESTRICTED"), (["confidential"], "CONFIDENTIAL")],
        "default": "INTERNAL",
    },
    "databricks": {
        "exact": {"personally_identifiable_information": "PII", "pii": "PII", "payment_card_data": "PCI", "pci": "PCI",
                  "health_information": "PHI", "phi": "PHI", "hipaa": "PHI", "sensitive": "CONFIDENTIAL",
                  "confidential": "CONFIDENTIAL", "restricted": "RESTRICTED", "secret": "RESTRICTED",
                  "internal": "INTERNAL", "public": "PUBLIC"},
        "keywords": [(["pii", "personal", "ssn", "social security"], "PII"), (["phi", "health", "medical", "hipaa"], "PHI"),
                     (["pci", "credit card", "payment"], "PCI"), (["restricted", "secret", "credential"], "RESTRICTED"),
                     (["confidential", "sensitive"], "CONFIDENTIAL"), (["internal"], "INTERNAL")],
        "default": "INTERNAL",
    },
}

# fixed values: value detectors (ASCII digits, no look-around)
DETECTORS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "PHONE_NUMBER": r"[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "US_SOCIAL_SECURITY_NUMBER": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "CREDIT_CARD_NUMBER": r"[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}[- ]?[0-9]{4}",
    "IP_ADDRESS": r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}",
}


# ---- classification by name -------------------------------------------------------------------------------

def _named(c: Column, words: Sequence[str], word_boundary: bool) -> Column:
    if word_boundary:
        return c.rlike(r"(^|_)(" + "|".join(re.escape(w) for w in words) + r")(_|$)")
    return contains_any(c, words)


def classify_by_name(columns: DataFrame, name: str = "column_name", word_boundary: bool = False) -> DataFrame:
    """Adds ``tags``: PII and/or SENSITIVE by name part. Plain substrings, so ``custkey`` is SENSITIVE;
    ``word_boundary`` asks for whole words between underscores."""
    c = F.lower(name)
    return columns.withColumn("tags", tags((_named(c, PII_NAMES, word_boundary), "PII"),
                                           (_named(c, SENSITIVE_NAMES, word_boundary), "SENSITIVE")))


def classify_by_suffix(columns: DataFrame, name: str = "column_name") -> DataFrame:
    """Adds ``classification`` and ``sensitivity``; FINANCIAL is a prefix test, so ``total_cost`` is GENERAL."""
    c = F.col(name)
    financial = F.lower(c).rlike(r"^(cost|price|amount|revenue)")
    level = (F.when(c.rlike(r"(?s)_id$"), "PII").when(c.rlike(r"(?s)_hash$"), "PSEUDONYMIZED")
             .when(financial, "FINANCIAL").otherwise("GENERAL"))
    sensitivity = F.when(level == "PII", "high").when(level == "GENERAL", "low").otherwise("medium")
    return columns.withColumn("classification", level).withColumn("sensitivity", sensitivity)


def classify_tables(columns: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Highest column level per table; tables without a classified column are UNCLASSIFIED."""
    order = lit_array(levels)
    rank = F.array_position(order, F.col("classification"))
    top = columns.groupBy("table_name").agg(F.max(rank).alias("__rank"))
    return top.select("table_name", F.when(F.col("__rank") > 0, F.element_at(order, F.col("__rank").cast("int")))
                      .otherwise("UNCLASSIFIED").alias("classification"))


def infer_level(label: Column, provider: str) -> Column:
    """Unified level of a provider's label: exact labels, prefixes, keyword rungs, default."""
    rules = PROVIDER_LEVELS[provider]
    low = F.lower(label)
    out = first_match(low, rules["keywords"], rules["default"])
    for start, level in reversed(rules.get("starts", [])):
        out = F.when(low.startswith(start), level).otherwise(out)
    for exact, level in rules.get("exact", {}).items():
        out = F.when(low == exact, level).otherwise(out)
    return out


def infer_levels(labels: DataFrame, provider: str = "provider", label: str = "label") -> DataFrame:
    """``infer_level`` for a table that mixes providers; an unknown provider gets null."""
    level = None
    for name in PROVIDER_LEVELS:
        cond = F.col(provider) == name
        value = infer_level(F.col(label), name)
        level = F.when(cond, value) if level is None else level.when(cond, value)
    return labels.withColumn("level", level)


def sensitive_columns(classifications: DataFrame) -> DataFrame:
    return classifications.where(F.col("column_name").isNotNull())


def classify_by_policy(columns: DataFrame, patterns: Sequence[tuple[str, str]] = PRIVACY_PATTERNS) -> DataFrame:
    """Handling of ``table.column`` by the first matching policy pattern; null where none matches."""
    full = F.lower(F.concat_ws(".", "table_name", "column_name"))
    out = None
    for pattern, handling in patterns:
        hit = full.endswith(pattern[1:]) if pattern.startswith("*.") else full.rlike(glob_to_regex(pattern))
        out = F.when(hit, handling) if out is None else out.when(hit, handling)
    return columns.withColumn("handling", out)


# ---- values -----------------------------------------------------------------------------------------------

def luhn_valid(number: Column) -> Column:
    """Luhn check over the digits of a string, as a fold inside the expression."""
    digits = F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), "")
    digits = F.filter(digits, lambda d: d != "")
    value = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def detector_count(text: Column, detector: str, pattern: str) -> Column:
    if detector == "CREDIT_CARD_NUMBER":
        return F.size(F.filter(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), luhn_valid))
    found = F.regexp_count(text, F.lit(pattern))
    # the address pattern backtracks over every word; most texts have no @ and never start it
    return F.when(text.contains("@"), found).otherwise(0) if "@" in pattern else found


def scan_sensitive_values(df: DataFrame, columns: Sequence[str], detectors: Mapping[str, str] = DETECTORS) -> DataFrame:
    """Matches per text column and detector over whole values, in one pass and one aggregate."""
    counted = df.select(*[F.coalesce(detector_count(F.col(c), d, p), F.lit(0)).alias(f"{c}|{d}")
                          for c in columns for d, p in detectors.items()])
    sums = counted.agg(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(d).alias("detector"),
                 F.count_if(F.col(f"`{c}|{d}`") > 0).alias("rows_matched"),
                 F.coalesce(F.sum(F.col(f"`{c}|{d}`")), F.lit(0)).alias("matches"))
        for c in columns for d in detectors]).alias("r"))
    return sums.select(F.inline("r"))


# ---- statistics -------------------------------------------------------------------------------------------

def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select(F.inline(pairs))


def column_statistics(df: DataFrame, columns: Sequence[str], exact: bool = False) -> DataFrame:
    """Rows, nulls, distinct, min, max, mean, median and deviation per numeric column.

    The default is a single aggregate over one scan (sketches for distinct and median). ``exact`` adds a value
    count per column, which shuffles one row per distinct value.
    """
    def one(c: str) -> Column:
        v = F.col(c).cast("double")
        fields = [F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("row_count"),
                  F.count_if(v.isNull()).alias("null_count"),
                  pct(F.count_if(v.isNull()), F.count(F.lit(1)), 4).alias("null_percentage"),
                  F.min(v).alias("min_value"), F.max(v).alias("max_value"), F.avg(v).alias("mean"),
                  F.stddev_samp(v).alias("stddev")]
        if not exact:
            fields += [F.approx_count_distinct(v).alias("distinct_count"),
                       F.percentile_approx(v, 0.5).alias("median")]
        return F.struct(*fields)
    base = df.agg(F.array(*[one(c) for c in columns]).alias("r")).select(F.inline("r"))
    if not exact:
        return base
    # one count of the values gives both
    values = percentiles(_long(df, columns), ["column_name"], "value", {"median": 0.5}, exact=True, distinct=True).withColumnRenamed("distinct", "distinct_count")
    return base.join(values, "column_name", "left").withColumn("distinct_count", F.coalesce("distinct_count", F.lit(0)))


def sample_values(df: DataFrame, columns: Sequence[str], n: int = 5, masks: Mapping[str, object] = {}) -> DataFrame:
    """The ``n`` smallest distinct values per column, masked where the column has a mask."""
    if not 1 <= n <= 100:
        raise ValueError("between 1 and 100 sample values")
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    picked = agg.sample_set(df.select(F.inline(pairs)), ["column_name"], "value", n)
    shown = F.col("samples")
    for c, fn in masks.items():
        shown = F.when(F.col("column_name") == c, F.transform("samples", fn)).otherwise(shown)
    return picked.select("column_name", "cardinality", shown.alias("samples"))


# ---- quality ----------------------------------------------------------------------------------------------

@dataclass(frozen=True)
class Constraint:
    """``kind`` is one of not_null, min, max, pattern, allowed; nulls violate not_null only."""

    column: str
    kind: str
    value: object = None

    def violated(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return c.isNull()
        if self.kind == "min":
            bad = c < F.lit(self.value)
        elif self.kind == "max":
            bad = c > F.lit(self.value)
        elif self.kind == "pattern":
            bad = ~c.rlike(self.value)
        elif self.kind == "allowed":
            bad = ~c.isin(list(self.value))
        else:
            raise ValueError(f"unknown constraint {self.kind!r}")
        return F.coalesce(bad, F.lit(False))

    @property
    def label(self) -> str:
        return f"{self.column}:{self.kind}"


def validate_constraints(df: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Violations per rule, all rules in one aggregate."""
    out = df.agg(F.array(*[F.struct(F.lit(r.label).alias("rule"), F.count_if(r.violated()).alias("violations"))
                           for r in rules]).alias("r"))
    return out.select(F.inline("r"))


def violating_rows(df: DataFrame, rules: Sequence[Constraint]) -> DataFrame:
    """Rows that break any rule, with the rules they break."""
    broken = tags(*[(r.violated(), r.label) for r in rules])
    return df.withColumn("violations", broken).where(F.size("violations") > 0)


def quality_metrics(df: DataFrame, rules: Sequence[Constraint], key: str, parent: DataFrame, parent_key: str,
                    ts: str, as_of: Column) -> DataFrame:
    """Completeness, accuracy, consistency (all percent) and freshness (hours) of one table, as one row."""
    cells = sum((F.count(c) for c in df.columns[1:]), F.count(df.columns[0]))
    bad = F.lit(False)
    for r in rules:
        bad = bad | r.violated()
    rows = F.count(F.lit(1))
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(F.max(ts).cast("timestamp"))) / F.lit(3_600_000_000)
    keys = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(F.col(parent_key).alias("k")).distinct().withColumn("hit", F.lit(True))
    matched = keys.join(known, "k", "left").agg(
        pct(F.sum(F.when(F.col("hit"), F.col("n")).otherwise(0)), F.sum("n"), 4).alias("c"))
    return df.agg(pct(cells, rows * len(df.columns), 4).alias("completeness"),
                  pct(F.count_if(~bad), rows, 4).alias("accuracy"), F.round(hours, 4).alias("freshness_hours")
                  ).withColumn("consistency", matched.scalar())


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Added, removed and retyped columns between two inventories (table_name, column_name, data_type)."""
    keys = ["table_name", "column_name"]
    a = old.select(*keys, F.col("data_type").alias("old_type"))
    b = new.select(*keys, F.col("data_type").alias("new_type"))
    change = (F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed")
              .when(F.col("old_type") != F.col("new_type"), "type_changed"))
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change IS NOT NULL")


def catalog_rollup(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Per catalog and schema, and over all: datasets, tables, views, columns and bytes."""
    per_table = columns.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_columns"))
    rows = tables.join(per_table, "table_id", "left")
    return agg.rollup_totals(rows, ["catalog_name", "schema_name"], [
        F.count(F.lit(1)).alias("datasets"), F.count_if(F.col("table_type") == "TABLE").alias("tables"),
        F.count_if(F.col("table_type") == "VIEW").alias("views"),
        F.coalesce(F.sum("n_columns"), F.lit(0)).alias("columns"), F.sum("bytes").alias("bytes")])


def assets_by_type(tables: DataFrame, n: int | None = None) -> DataFrame:
    out = tables.groupBy("table_type").agg(F.count(F.lit(1)).alias("assets"))
    out = out.orderBy(F.desc("assets"), "table_type")
    return out if n is None else out.limit(n)


def largest_tables(tables: DataFrame, n: int | None = None) -> DataFrame:
    out = tables.where("bytes > 0").select("table_id", "table_name", "bytes")
    out = out.orderBy(F.desc("bytes"), "table_id")
    return out if n is None else out.limit(n)
