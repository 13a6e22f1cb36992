"""Query-log and question-log analytics: every rule is a column expression over the whole log.

Word and space classes are ASCII (Java regex defaults).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.text import contains_any, first_match, tags

# fixed values: blocked keywords, in the order a reason is picked
BLOCKED = ["INSERT", "UPDATE", "DELETE", "DROP", "CREATE", "ALTER", "TRUNCATE"]

# fixed values: first words of permitted statements
ALLOWED_FIRST = ["SELECT", "WITH", "SHOW", "DESCRIBE", "EXPLAIN"]

# fixed values: injection patterns, tried in order on the upper-case text
INJECTION = [
    (r";\s*\b(DROP|DELETE|INSERT|UPDATE|CREATE|ALTER|TRUNCATE)\b", "Multi-statement injection"),
    (r"'\s*OR\s+'\d+'\s*=\s*'\d+", "Classic OR injection"),
    (r"'\s*OR\s+1\s*=\s*1", "Tautology injection"),
    (r"UNION\s+ALL\s+SELECT", "UNION injection"),
    (r"--\s*$", "Comment-based injection (end of line)"),
    (r"/\*.*\*/\s*\bDROP\b", "Comment obfuscation"),
    (r"CHAR\s*\(\s*\d+\s*\)", "Character encoding bypass"),
    (r"0[xX][0-9a-fA-F]+", "Hex encoding bypass"),
]

# fixed values: hint id, regex, estimated improvement
HINTS = [
    ("avoid_select_star", r"SELECT\s+\*", 0.15),
    ("add_limit", None, 0.10),
    ("use_index_columns", r"WHERE.*[^=<>!](\w+)\s*=", 0.20),
    ("avoid_functions_in_where", r"WHERE.*\b(YEAR|MONTH|DAY|LOWER|UPPER)\s*\(", 0.25),
    ("use_exists_over_in", r"IN\s*\(\s*SELECT", 0.15),
    ("avoid_or_in_where", r"WHERE.*\bOR\b", 0.10),
]
MAX_IMPROVEMENT = 0.5

# fixed values: structure tags
STRUCTURE_PATTERNS = [
    ("aggregation", r"(SUM|COUNT|AVG|MIN|MAX)\s*\("),
    ("group_by", r"GROUP\s+BY"),
    ("join", r"\bJOIN\b"),
    ("subquery", r"\(\s*SELECT"),
    ("window", r"\bOVER\s*\("),
    ("cte", r"\bWITH\b.*\bAS\s*\("),
]

# fixed values: intents with their keywords, in the order they are tested
INTENTS = [
    (["how many", "count", "total sessions", "number of"], "count"),
    (["cost", "spend", "expense", "price", "billing", "budget"], "cost"),
    (["latency", "performance", "slow", "fast", "response time", "duration"], "performance"),
    (["trend", "daily", "weekly", "monthly", "over time", "timeline", "history"], "trend"),
    (["by language", "by region", "by model", "breakdown", "distribution", "per"], "breakdown"),
    (["compare", "versus", "vs", "difference between"], "comparison"),
    (["top", "best", "worst", "most", "least", "highest", "lowest"], "top_n"),
    (["error", "fail", "issue", "problem", "success rate"], "error"),
]

# fixed values: word -> dimension, in the order dimensions are listed
DIMENSION_WORDS = [
    ("language", "language"), ("region", "region"), ("model", "model_name"), ("provider", "model_provider"),
    ("source", "source"), ("family", "family_id_hash"), ("child", "child_id_hash"), ("country", "region"), ("app", "source"),
]

# fixed values: range tokens, in the order they are tested
TIME_WORDS = [(["today"], "today"), (["yesterday"], "yesterday"), (["last week"], "last week"),
              (["last month", "past month"], "last month"), (["last 7 days"], "last 7 days"), (["last 30 days"], "last 30 days")]

PARTITION_WORDS = ["year", "month", "day"]


def without_comments(sql: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(sql, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", ""))


def _statements(sql: Column) -> Column:
    return F.size(F.filter(F.split(sql, ";"), lambda s: F.length(F.trim(s)) > 0))


def _word(upper: Column, keyword: str) -> Column:
    return upper.rlike(rf"\b{keyword}\b")


def scan_security(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``safe``, ``security_rule`` and ``reason``; the first rule that fires decides."""
    upper, clean = F.upper(sql), without_comments(F.col(sql))
    first = F.upper(F.regexp_extract(clean, r"^\s*(\S+)", 1))
    def found(rule: str, reason: Column | str) -> Column:
        return F.struct(F.lit(rule).alias("rule"), (reason if isinstance(reason, Column) else F.lit(reason)).alias("reason"))
    verdict = F
    for word in BLOCKED:
        verdict = verdict.when(_word(upper, word), found("blocked_keyword", f"Blocked operation: {word}"))
    for pattern, what in INJECTION:
        verdict = verdict.when(upper.rlike(pattern), found("injection_pattern", f"Potential SQL injection: {what}"))
    verdict = verdict.when(clean == "", found("empty_query", "Empty query after removing comments"))
    verdict = verdict.when(~first.isin(ALLOWED_FIRST), found(
        "disallowed_operation", F.concat(F.lit("Only read operations allowed. Found: "), first)))
    verdict = verdict.when(_statements(clean) > 1, found("multi_statement", "Multiple statements not allowed"))
    return log.withColumn("__v", verdict).select(
        *log.columns, F.col("__v").isNull().alias("safe"), F.col("__v.rule").alias("security_rule"), F.col("__v.reason").alias("reason"))


def _missing_partition(sql: Column) -> Column:
    low = F.lower(sql)
    return low.contains("session_logs") & ~contains_any(low, PARTITION_WORDS)


def scan_writes_and_warnings(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds ``safe``, the write keyword found and style warnings (empty for unsafe queries)."""
    c, upper = F.col(sql), F.upper(sql)
    write = F
    for word in BLOCKED:
        write = write.when(_word(upper, word), word)
    notes = tags((upper.rlike(r"SELECT\s+\*"), "select_star"),
                 (upper.contains("SELECT") & ~upper.contains("LIMIT"), "no_limit"),
                 (_missing_partition(c), "no_partition_filter"))
    none = F.array().cast("array<string>")
    return log.withColumn("write_keyword", write).withColumn("safe", F.col("write_keyword").isNull()).withColumn(
        "warnings", F.when(F.col("safe"), notes).otherwise(none))


def optimization_hints(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds the ids of the hints that apply and the summed improvement, capped at one half."""
    c = F.col(sql)
    hits = [(name, ~F.upper(c).contains("LIMIT") if rx is None else c.rlike("(?is)" + rx), gain) for name, rx, gain in HINTS]
    total = sum((F.when(hit, F.lit(int(gain * 100 + 0.5))).otherwise(0) for _, hit, gain in hits), F.lit(0))
    return log.withColumn("hints", tags(*[(hit, name) for name, hit, _ in hits])).withColumn(
        "estimated_improvement", F.least(total, F.lit(int(MAX_IMPROVEMENT * 100))) / F.lit(100.0))


def referenced_tables(sql: Column) -> Column:
    """Table after the first FROM, then the tables after every JOIN."""
    name = r"\s+(\w+(?:\.\w+)?)"
    first = F.slice(F.regexp_extract_all(sql, F.lit(r"(?i)\bFROM" + name), F.lit(1)), 1, 1)
    return F.concat(first, F.regexp_extract_all(sql, F.lit(r"(?i)\bJOIN" + name), F.lit(1)))


def referenced_columns(sql: Column) -> Column:
    """Last word of each item between SELECT and FROM; ``*`` alone stays a star."""
    text = F.regexp_extract(sql, r"(?is)SELECT\s+(.*?)\s+FROM", 1)
    last = F.transform(F.split(text, ","), lambda x: F.element_at(F.split(F.trim(x), r"\s+"), -1))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(last)


def _flags(sql: Column) -> dict[str, Column]:
    upper = F.upper(sql)
    return {
        "has_aggregation": upper.rlike(r"\b(SUM|COUNT|AVG|MIN|MAX)\s*\("), "has_group_by": upper.contains("GROUP BY"),
        "has_join": upper.contains("JOIN"), "has_subquery": upper.rlike(r"\(\s*SELECT"), "has_where": upper.contains("WHERE"),
        "has_order_by": upper.contains("ORDER BY"), "has_limit": upper.contains("LIMIT"),
    }


def structure_profile(log: DataFrame, sql: str = "sql") -> DataFrame:
    """Adds structure flags, pattern tags, tables, columns, relative cost and complexity."""
    c = F.col(sql)
    out = log.withColumns({
        **_flags(c), "tables": referenced_tables(c), "columns": referenced_columns(c),
        "patterns": tags(*[(c.rlike("(?i)" + rx), name) for name, rx in STRUCTURE_PATTERNS])})
    def factor(cond: Column, value: float) -> Column:
        return F.when(cond, F.lit(value)).otherwise(F.lit(1.0))
    join, sub, aggr, where = (F.col(f"has_{x}") for x in ("join", "subquery", "aggregation", "where"))
    cost = (F.lit(10.0) * factor(join, 2.5) * factor(aggr, 1.5) * factor(sub, 2.0) * factor(~where, 3.0)
            * factor(F.col("has_limit"), 0.5))
    score = join.cast("int") * 2 + sub.cast("int") * 2 + aggr.cast("int") + (~where).cast("int")
    return out.withColumns({
        "relative_cost": F.round(cost, 2), "rows_scanned": F.when(where, 1000).otherwise(10000),
        "complexity_score": score,
        "complexity": F.when(score >= 4, "high").when(score >= 2, "medium").otherwise("low")})


def explain_warnings(log: DataFrame, sql: str = "sql") -> DataFrame:
    c = F.col(sql)
    f = _flags(c)
    return log.withColumn("warnings", tags(
        (~f["has_where"] & ~f["has_limit"], "UNBOUNDED_QUERY"),
        (F.array_contains(referenced_columns(c), "*"), "SELECT_STAR"),
        (f["has_subquery"], "SUBQUERY_DETECTED"),
        (c.rlike(r"(?i)WHERE.*\b(YEAR|MONTH|LOWER|UPPER)\s*\(\s*\w+\s*\)"), "FUNCTION_ON_COLUMN")))


def table_usage(log: DataFrame, sql: str = "sql", user: str = "user_id") -> DataFrame:
    """Queries and users per referenced table."""
    rows = log.select(F.col(user).alias("__user"), F.explode(F.array_distinct(referenced_tables(F.col(sql)))).alias("table_name"))
    return rows.groupBy("table_name").agg(F.count(F.lit(1)).alias("queries"), F.count_distinct("__user").alias("users"))


def row_estimate(log: DataFrame, sql: str = "sql") -> DataFrame:
    upper = F.upper(sql)
    base = F.lit(1000) * F.when(upper.contains("JOIN"), 10).otherwise(1)
    base = F.floor(base / F.when(upper.contains("GROUP BY"), 10).otherwise(1))
    limit = F.nullif(F.regexp_extract(upper, r"LIMIT\s+(\d+)", 1), F.lit("")).cast("bigint")
    return log.withColumn("estimated_rows", F.least(base, limit)).withColumn(
        "complexity", F.when(upper.contains("JOIN"), "high").otherwise("medium"))


# ---- questions --------------------------------------------------------------------------------------------

def question_intent(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds intent, dimensions, time range token and N for ranking questions (10 unless stated)."""
    low = F.lower(text)
    dims = F.array_distinct(tags(*[(low.contains(w), d) for w, d in DIMENSION_WORDS]))
    stated = F.nullif(F.regexp_extract(low, r"top\s+(\d+)", 1), F.lit("")).cast("int")
    intent = first_match(low, INTENTS, "overview")
    return questions.withColumns({
        "intent": intent, "dimensions": dims, "time_token": first_match(low, TIME_WORDS, None),
        "top_n": F.when(intent == "top_n", F.coalesce(stated, F.lit(10)))})


def question_features(questions: DataFrame, text: str = "question") -> DataFrame:
    """Adds aggregates, grouping, year, N and a confidence of .5 + .2 + .15 + .1, at most .95."""
    low = F.lower(text)
    aggs = tags((contains_any(low, ["sum", "total", "revenue"]), "SUM"), (contains_any(low, ["count", "how many"]), "COUNT"),
                (contains_any(low, ["average", "avg", "mean"]), "AVG"))
    group = tags((low.contains("by region"), "region"), (contains_any(low, ["monthly", "by month"]), "month"),
                 (low.contains("by customer"), "customer_id"))
    year = F.nullif(F.regexp_extract(text, r"\b(20\d{2})\b", 1), F.lit("")).cast("int")
    top = F.nullif(F.regexp_extract(low, r"top\s+(\d+)", 1), F.lit("")).cast("int")
    points = (F.lit(50) + F.when(F.size(aggs) > 0, 20).otherwise(0) + F.when(F.size(group) > 0, 15).otherwise(0)
              + F.when(year.isNotNull(), 10).otherwise(0))
    return questions.withColumns({"aggregations": aggs, "group_by": group, "year": year, "top_n": top,
                                  "confidence": F.least(points, F.lit(95)) / F.lit(100.0)})
