"""Request, audit and health analytics (batch; the streaming twins live in ``custodia.streaming``)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia import policies as P
from custodia.functions.numbers import count_true, pct
from custodia.functions.text import lit_map
from custodia.operators.ordered import carry_forward, chunk_of, join_null_safe, numbered, run_lengths
from custodia.operators.quantiles import order_statistics

# fixed values
HEALTHY_AFTER, UNHEALTHY_AFTER = 2, 3
EWMA_ALPHA = 0.3
RATE_LIMIT_PER_MINUTE = 1000
MIN_DEADLINE_MS, DEFAULT_DEADLINE_MS, MAX_DEADLINE_MS = 1_000, 30_000, 300_000


def request_totals() -> list[Column]:
    """Aggregates shared by the batch report and its streaming twin."""
    failed = F.col("status") == "ERROR"
    return [F.count(F.lit(1)).alias("requests"), count_true(failed).alias("errors"),
            pct(count_true(failed), F.count(F.lit(1)), 2).alias("error_rate"), F.avg("duration_ms").alias("avg_ms")]


def request_metrics(df: DataFrame, group: Sequence[str] = ("agent", "capability"), exact: bool = False) -> DataFrame:
    """Requests, errors, error rate, mean, p50 and p99. ``exact`` uses nearest ranks, the default a sketch."""
    group = list(group)
    if not exact:
        return df.groupBy(*group).agg(*request_totals(), F.percentile_approx("duration_ms", 0.5).alias("p50_ms"),
                                      F.percentile_approx("duration_ms", 0.99).alias("p99_ms"))
    ranks = order_statistics(df, group, "duration_ms", {
        "p50_ms": lambda n: F.floor(n / 2), "p99_ms": lambda n: F.floor(n * F.lit(0.99))}).drop("n")
    return join_null_safe(df.groupBy(*group).agg(*request_totals()), ranks, group)


def health_states(df: DataFrame, order: str = "seq", key: str = "agent", chunk_size: float = 86_400) -> DataFrame:
    """Adds ``current`` and ``previous`` status per check.

    Healthy or degraded after two good checks in a row, unhealthy after three bad ones, otherwise unchanged;
    UNKNOWN before that. Run length and carry-forward work on chunks of the order column.
    """
    chunk = chunk_of(df, order, chunk_size)
    rows = df.withColumn("__ok", F.col("status").isin("HEALTHY", "DEGRADED"))
    rows = run_lengths(rows, [key], [order], "__ok", chunk, out="__run")
    named = F.when(F.col("__ok") & (F.col("__run") >= HEALTHY_AFTER), F.col("status")).when(
        ~F.col("__ok") & (F.col("__run") >= UNHEALTHY_AFTER), F.lit("UNHEALTHY"))
    rows = rows.withColumn("__set", named)
    rows = carry_forward(rows, [key], [order], "__set", "__before", chunk, inclusive=False)
    before = F.coalesce("__before", F.lit("UNKNOWN"))
    return rows.withColumn("current", F.coalesce("__set", before)).withColumn("previous", before).drop("__ok", "__run", "__set", "__before")


def health_transitions(df: DataFrame, order: str = "seq", key: str = "agent", chunk_size: float = 86_400) -> DataFrame:
    rows = health_states(df, order, key, chunk_size)
    return rows.where("current <> previous").select(key, order, F.col("previous").alias("from_status"), F.col("current").alias("to_status"))


def ewma_latency(df: DataFrame, order: str = "seq", key: str = "agent", value: str = "response_time_ms",
                 alpha: float = EWMA_ALPHA, chunk_size: float = 86_400) -> DataFrame:
    """Exponential average over healthy checks, newest state per agent.

    The recurrence is unrolled into weights of the row number: the first value counts (1-a)^(n-1), row i counts
    a(1-a)^(n-i). So it becomes a plain sum with partial aggregation instead of an ordered fold. Zeros before the
    first real value do not seed the average.
    """
    rows = df.where(F.col("status") == "HEALTHY").select(key, order, F.col(value).alias("__x"))
    seeds = rows.where("__x <> 0").groupBy(key).agg(F.min(order).alias("__seed"))
    rows = join_null_safe(rows, seeds, [key]).where(F.col(order) >= F.col("__seed")).drop("__seed")
    rows = numbered(rows, [key], [order], "__i", chunk_of(rows, order, chunk_size))
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    rows = join_null_safe(rows, sizes, [key])
    weight = F.when(F.col("__i") == 1, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(1.0 - alpha), F.col("n") - F.col("__i"))
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("checks"), F.sum(F.col("__x") * weight).alias("ewma_ms"))


def audit_trail(access: DataFrame | None = None, capability: DataFrame | None = None, provider: DataFrame | None = None) -> DataFrame:
    """Three audit shapes in one schema: access events, capability calls and provider log entries."""
    parts = []
    if access is not None:
        parts.append(access.select("timestamp", "event_type", "user_id", "action", "resource", "outcome"))
    if capability is not None:
        parts.append(capability.select(
            "timestamp", F.lit("capability").alias("event_type"), F.coalesce("user", F.lit("unknown")).alias("user_id"),
            F.col("capability").alias("action"), F.lit(None).cast("string").alias("resource"),
            F.when(F.coalesce("authorized", F.lit(True)), "allow").otherwise("deny").alias("outcome"), "trace_id"))
    if provider is not None:
        parts.append(provider.select(
            "timestamp", F.lit("data_access").alias("event_type"), "user_id", "action", "resource",
            F.col("decision").alias("outcome"), "trace_id"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def pii_access_alerts(events: DataFrame, levels: Mapping[str, str], enforcement: Mapping[str, tuple[str, str]] = P.ENFORCEMENT) -> DataFrame:
    """Alerts on access to personal data: refused access is enforced as unauthorised, granted access is noted."""
    level = F.element_at(lit_map(dict(levels)), F.col("resource"))
    action, severity = enforcement["unauthorized_pii_access"]
    denied = F.col("decision") == "deny"
    return events.withColumn("classification", level).where(F.col("classification").isin("PII", "PHI", "PCI", "RESTRICTED")).select(
        *events.columns, "classification",
        F.when(denied, "unauthorized_pii_access").otherwise("pii_access").alias("trigger"),
        F.when(denied, action).otherwise("alert").alias("enforcement"),
        F.when(denied, severity).otherwise("info").alias("severity"))


def access_summary(audit: DataFrame, period: str = "month", ts: str = "ts") -> DataFrame:
    bucket = F.date_format(F.date_trunc(period, ts), "yyyy-MM-dd").alias("period")
    return audit.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("decisions"), count_true(F.col("decision") == "deny").alias("denials"),
        F.count_distinct("user_id").alias("users"), F.count_distinct("resource").alias("resources"))


def rate_breaches(df: DataFrame, limit: int = RATE_LIMIT_PER_MINUTE, caller: str = "caller", ts: str = "ts",
                  window: str = "1 minute") -> DataFrame:
    """Callers over the limit in a tumbling window; works on a batch or a watermarked stream."""
    counted = df.groupBy(F.window(ts, window).alias("w"), caller).agg(F.count(F.lit(1)).alias("requests"))
    return counted.where(F.col("requests") > limit).select(F.col("w.start").alias("window_start"), caller, "requests")


def effective_deadline(requested: Column) -> Column:
    """Default where none (or a non-positive one) is asked for, otherwise clamped to the permitted range."""
    asked = F.coalesce(requested, F.lit(0))
    return F.when(asked <= 0, F.lit(DEFAULT_DEADLINE_MS)).otherwise(
        F.greatest(F.lit(MIN_DEADLINE_MS), F.least(asked, F.lit(MAX_DEADLINE_MS)))).cast("bigint")


def deadline_breaches(df: DataFrame, requested: str = "deadline_ms", took: str = "elapsed_ms") -> DataFrame:
    rows = df.withColumn("effective_deadline_ms", effective_deadline(F.col(requested)))
    return rows.where(F.col(took) > F.col("effective_deadline_ms"))
