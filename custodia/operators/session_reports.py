"""Session analytics: counts, cost, latency, trends, shares and rankings over ``session_logs``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custodia.functions.numbers import count_true, dbl, pct, rounded, safe_ratio
from custodia.operators import aggregates as agg
from custodia.operators.ordered import change_from_previous, join_null_safe
from custodia.operators.quantiles import percentiles

# fixed values: columns a session report may be grouped by
DIMENSIONS = ["language", "region", "model_name", "model_provider", "source", "family_id_hash", "child_id_hash"]

def _count() -> Column:
    return F.count(F.lit(1))



def _dims(dims: list[str]) -> list[str]:
    unknown = [d for d in dims if d not in DIMENSIONS]
    if unknown:
        raise ValueError(f"not a session dimension: {unknown}")
    return list(dims)


def _in_range(df: DataFrame, rng: Column | None) -> DataFrame:
    return df if rng is None else df.where(rng)


def _total_cost(name: str = "total_cost") -> Column:
    return dbl(F.round(F.sum("cost_usd"), 4)).alias(name)


def _avg_cost(name: str = "avg_cost") -> Column:
    return dbl(F.round(F.avg("cost_usd"), 6)).alias(name)


def _avg(col: str, name: str, digits: int = 2) -> Column:
    return rounded(F.avg(col), digits).alias(name)


def _distinct(col: str, name: str, approx: bool) -> Column:
    """Distinct values: exact (a row per value and count is shuffled), or a sketch of fixed size per group."""
    return (F.approx_count_distinct if approx else F.count_distinct)(col).alias(name)


def _families(name: str = "unique_families", approx: bool = False) -> Column:
    return _distinct("family_id_hash", name, approx)


def _children(name: str = "unique_children", approx: bool = False) -> Column:
    return _distinct("child_id_hash", name, approx)


def _success_rate(digits: int = 1) -> Column:
    return pct(count_true(F.col("success")), _count(), digits).alias("success_rate")


def _tokens(col: str, name: str) -> Column:
    return F.sum(F.col(col).cast("bigint")).alias(name)


def _all_tokens() -> Column:
    return F.sum((F.col("input_tokens") + F.col("output_tokens")).cast("bigint"))



def _ranked(df: DataFrame, by: str, dims: list[str], asc: bool = False, limit: int | None = None) -> DataFrame:
    first = F.col(by).asc() if asc else F.col(by).desc()
    out = df.orderBy(first, *dims)
    return out if limit is None else out.limit(limit)


def session_count(df: DataFrame, dims: list[str], rng: Column | None = None, limit: int | None = None, approx: bool = False) -> DataFrame:
    dims = _dims(dims)
    out = _in_range(df, rng).groupBy(*dims).agg(_count().alias("sessions"), _families(approx=approx))
    return _ranked(out, "sessions", dims, limit=limit)


def session_totals(df: DataFrame, rng: Column | None = None, approx: bool = False) -> DataFrame:
    """Global totals; three exact distinct counts triple the rows before the partial aggregate, ``approx`` does not."""
    return _in_range(df, rng).agg(_count().alias("total_sessions"), _families(approx=approx), _children(approx=approx))


def session_totals_cost(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.agg(_count().alias("total_sessions"), _families(approx=approx), _children(approx=approx), _total_cost("total_cost_usd"))


def cost_analysis(df: DataFrame, dims: list[str] = ["model_name"], rng: Column | None = None) -> DataFrame:
    dims = _dims(dims)
    per_1k = rounded(safe_ratio(F.sum("cost_usd"), _all_tokens(), 1000), 6).alias("cost_per_1k_tokens")
    out = _in_range(df, rng).groupBy(*dims).agg(
        _count().alias("sessions"), _total_cost(), _avg_cost("avg_cost_per_session"),
        _tokens("input_tokens", "total_input_tokens"), _tokens("output_tokens", "total_output_tokens"), per_1k)
    return _ranked(out, "total_cost", dims)


def cost_by_model(df: DataFrame) -> DataFrame:
    out = df.groupBy("model_name").agg(
        _count().alias("sessions"), _total_cost(), _avg_cost(),
        _tokens("input_tokens", "total_input_tokens"), _tokens("output_tokens", "total_output_tokens"))
    return _ranked(out, "total_cost", ["model_name"])


def latency_by_model_language(df: DataFrame, dims: list[str] = ["model_name", "language"],
                              rng: Column | None = None) -> DataFrame:
    dims = _dims(dims)
    out = _in_range(df, rng).where("latency_ms > 0").groupBy(*dims).agg(
        _count().alias("sessions"), _avg("latency_ms", "avg_latency_ms"), F.min("latency_ms").alias("min_latency_ms"),
        F.max("latency_ms").alias("max_latency_ms"), _avg("duration_seconds", "avg_duration_sec"))
    return _ranked(out, "avg_latency_ms", dims)


def performance(df: DataFrame, dims: list[str] = ["model_name", "language"], rng: Column | None = None,
                exact: bool = False) -> DataFrame:
    """Latency profile with p95: one pass with a sketch, or exact rank selection joined on the (small) groups."""
    dims = _dims(dims)
    rows = _in_range(df, rng).where("latency_ms > 0")
    if exact:
        base = latency_by_model_language(df, dims, rng)
        p95 = percentiles(rows, dims, "latency_ms", {"p95": 0.95}, exact=True)
        out = join_null_safe(base, p95, dims).withColumn("p95_latency_ms", rounded(F.col("p95"), 2)).drop("p95")
    else:
        out = rows.groupBy(*dims).agg(
            _count().alias("sessions"), _avg("latency_ms", "avg_latency_ms"),
            F.min("latency_ms").alias("min_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
            rounded(F.percentile_approx("latency_ms", 0.95), 2).alias("p95_latency_ms"),
            _avg("duration_seconds", "avg_duration_sec"))
    return _ranked(out, "avg_latency_ms", dims)


def _day() -> Column:
    return F.concat_ws("-", "year", "month", "day")


_GRAINS = {
    "daily": ("date", _day),
    "hourly": ("hour", lambda: F.concat(_day(), F.lit(" "), F.substring("timestamp", 12, 2), F.lit(":00"))),
    "weekly": ("week", lambda: F.date_format(F.date_trunc("week", F.to_timestamp(F.substring("timestamp", 1, 19))),
                                             "yyyy-MM-dd")),
}


def trend(df: DataFrame, grain: str = "daily", dims: list[str] = [], rng: Column | None = None,
          periods: int | None = None, limit: int | None = None, approx: bool = False) -> DataFrame:
    """Trend at daily, hourly or ISO-week grain, newest period first.

    ``periods`` keeps the newest periods with all their groups; ``limit`` keeps rows.
    """
    dims = _dims(dims)
    name, key = _GRAINS[grain]
    out = _in_range(df, rng).groupBy(key().alias(name), *dims).agg(
        _count().alias("sessions"), _families("active_families", approx), _total_cost("daily_cost"),
        _avg("latency_ms", "avg_latency_ms"), _success_rate())
    if periods is not None:
        # as many rows as the caller asks for; the oldest of them bounds the report
        newest = _in_range(df, rng).select(key().alias(name)).distinct().orderBy(F.desc(name)).limit(periods)
        out = out.join(newest, name, "left_semi")
    return _ranked(out, name, dims, limit=limit)


def trend_daily(df: DataFrame, dims: list[str] = [], rng: Column | None = None, **options) -> DataFrame:
    return trend(df, "daily", dims, rng, **options)


def trend_hourly(df: DataFrame, dims: list[str] = [], rng: Column | None = None, **options) -> DataFrame:
    return trend(df, "hourly", dims, rng, **options)


def trend_weekly(df: DataFrame, dims: list[str] = [], rng: Column | None = None, **options) -> DataFrame:
    return trend(df, "weekly", dims, rng, **options)


def trend_ymd(df: DataFrame, n: int | None = None, latency_digits: int = 2, approx: bool = False) -> DataFrame:
    out = df.groupBy("year", "month", "day").agg(
        _count().alias("sessions"), _families("active_families", approx), _total_cost("daily_cost"),
        _avg("latency_ms", "avg_latency_ms", latency_digits))
    out = out.orderBy(F.desc("year"), F.desc("month"), F.desc("day"))
    return out if n is None else out.limit(n)


def breakdown(df: DataFrame, dims: list[str] = ["language", "region"], rng: Column | None = None, approx: bool = False) -> DataFrame:
    """Share of sessions per group, of one scan: the total is the sum of the grouped counts."""
    dims = _dims(dims)
    out = _in_range(df, rng).groupBy(*dims).agg(_count().alias("sessions"), _families(approx=approx), _total_cost(),
                                                _avg("latency_ms", "avg_latency_ms"))
    return _ranked(agg.with_share(out, "sessions"), "sessions", dims)


def comparison(df: DataFrame, dims: list[str] = ["model_name"]) -> DataFrame:
    dims = _dims(dims)
    out = df.groupBy(*dims).agg(_count().alias("sessions"), _total_cost(), _avg_cost(),
                                _avg("latency_ms", "avg_latency_ms"), _success_rate(),
                                _all_tokens().alias("total_tokens"))
    return _ranked(out, "sessions", dims)


def top_n(df: DataFrame, dims: list[str] = ["model_name"], by: str = "sessions", asc: bool = False,
          n: int = 10, approx: bool = False) -> DataFrame:
    dims = _dims(dims)
    if by not in ("total_cost", "avg_latency_ms", "unique_families", "sessions"):
        raise ValueError(f"cannot rank by {by}")
    out = df.groupBy(*dims).agg(_count().alias("sessions"), _families(approx=approx), _total_cost(),
                                _avg("latency_ms", "avg_latency_ms"))
    return _ranked(out, by, dims, asc, n)


def _outcomes(df: DataFrame, dim: str, total: str, digits: int) -> DataFrame:
    return df.groupBy(dim).agg(_count().alias(total), count_true(F.col("success")).alias("successful"),
                               count_true(~F.col("success")).alias("failed"), _success_rate(digits))


def success_rate(df: DataFrame, dims: list[str] = ["model_name"]) -> DataFrame:
    (dim,) = _dims(dims)
    return _ranked(_outcomes(df, dim, "total_sessions", 2), "success_rate", [dim], asc=True)


def success_rate_by_language(df: DataFrame) -> DataFrame:
    return _ranked(_outcomes(df, "language", "total", 1), "total", ["language"])


def _has_error() -> Column:
    return F.col("error_code").isNotNull() & (F.col("error_code") != "")



def error_breakdown(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Errors per code and model; shares are of all errors, also of those that a ``limit`` cuts off."""
    errors = df.where(~F.col("success") & _has_error())
    dims = ["error_code", "model_name"]
    return _ranked(agg.share_of_total(errors, dims, count_name="occurrences"), "occurrences", dims, limit=limit)


def error_impact(df: DataFrame, limit: int | None = None, approx: bool = False) -> DataFrame:
    out = df.where(_has_error()).groupBy("error_code").agg(_count().alias("occurrences"), _families("affected_families", approx))
    return _ranked(out, "occurrences", ["error_code"], limit=limit)


def status_distribution(df: DataFrame) -> DataFrame:
    """Sessions per error code; rows without one (null or empty) count as ``Success``."""
    status = F.coalesce(F.nullif(F.col("error_code"), F.lit("")), F.lit("Success"))
    return _ranked(agg.share_of_total(df.select(status.alias("status")), ["status"], count_name="count"),
                   "count", ["status"])


def overview(df: DataFrame, limit: int | None = None, approx: bool = False) -> DataFrame:
    dims = ["language", "region"]
    out = df.groupBy(*dims).agg(_count().alias("sessions"), _families("families", approx), _total_cost(),
                                _avg("latency_ms", "avg_latency_ms"), _success_rate())
    return _ranked(out, "sessions", dims, limit=limit)


def language_report(df: DataFrame) -> DataFrame:
    dims = ["language", "region"]
    out = df.groupBy(*dims).agg(_count().alias("sessions"), _families("families"), _total_cost(),
                                _avg_cost("avg_cost_per_session"))
    return _ranked(out, "sessions", dims)


def kpi_summary(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.agg(_count().alias("total_sessions"), _families(approx=approx), _children(approx=approx),
                  _distinct("language", "languages", approx), _total_cost(),
                  _avg("latency_ms", "avg_latency_ms", 0), _success_rate(), _all_tokens().alias("total_tokens"))


def session_stats(df: DataFrame, approx: bool = False) -> DataFrame:
    return df.agg(_count().alias("total_sessions"), _families(approx=approx), _children(approx=approx), _total_cost("total_cost_usd"),
                  _avg_cost("avg_cost_per_session"), _tokens("input_tokens", "total_input_tokens"),
                  _tokens("output_tokens", "total_output_tokens"))


def by_language(df: DataFrame, limit: int | None = None, approx: bool = False) -> DataFrame:
    out = df.groupBy("language").agg(_count().alias("sessions"), _families("families", approx), _total_cost("cost"),
                                     _avg("latency_ms", "avg_latency", 0))
    return _ranked(out, "sessions", ["language"], limit=limit)


def by_model(df: DataFrame) -> DataFrame:
    out = df.groupBy("model_name").agg(
        _count().alias("sessions"), _total_cost(), _avg_cost(), _tokens("input_tokens", "input_tokens"),
        _tokens("output_tokens", "output_tokens"), _avg("latency_ms", "avg_latency", 0))
    return _ranked(out, "total_cost", ["model_name"])


def daily_dashboard(df: DataFrame) -> DataFrame:
    out = df.groupBy(_day().alias("date")).agg(
        _count().alias("sessions"), _families("families"), _total_cost("cost"), _avg("latency_ms", "avg_latency", 0),
        _success_rate())
    return out.orderBy("date")


def by_region_share(df: DataFrame) -> DataFrame:
    out = df.groupBy("region").agg(_count().alias("sessions"), _total_cost("cost"))
    return _ranked(agg.with_share(out, "sessions"), "sessions", ["region"])


def top_families(df: DataFrame, n: int = 10, approx: bool = False) -> DataFrame:
    out = df.groupBy("family_id_hash").agg(_count().alias("sessions"), _children("children", approx), _total_cost(),
                                           _avg("latency_ms", "avg_latency", 0))
    return _ranked(out, "sessions", ["family_id_hash"], limit=n)


def model_usage(df: DataFrame) -> DataFrame:
    dims = ["model_provider", "model_name"]
    out = df.groupBy(*dims).agg(
        _count().alias("sessions"), _total_cost(), _avg_cost(), _avg("latency_ms", "avg_latency", 0),
        _tokens("input_tokens", "input_tokens"), _tokens("output_tokens", "output_tokens"))
    return _ranked(out, "total_cost", dims)


def token_efficiency(df: DataFrame) -> DataFrame:
    ratio = rounded(safe_ratio(F.sum("output_tokens"), F.sum("input_tokens")), 2).alias("output_ratio")
    out = df.groupBy("language").agg(_count().alias("sessions"), _avg("input_tokens", "avg_input", 0),
                                     _avg("output_tokens", "avg_output", 0), ratio)
    return _ranked(out, "sessions", ["language"])


def most_efficient_language(df: DataFrame) -> DataFrame:
    return agg.argmax(token_efficiency(df), "language", "output_ratio")


def day_over_day(df: DataFrame) -> DataFrame:
    """Percent change of sessions between the two newest days (the window sees one row per day)."""
    daily = df.groupBy(_day().alias("date")).agg(_count().alias("sessions")).orderBy(F.desc("date")).limit(2)
    return change_from_previous(daily, ["date"], "sessions").where("change_pct is not null")


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, empty flag and column names per table."""
    out = None
    for name, df in tables.items():
        one = df.agg(_count().alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", (F.col("row_count") == 0).alias("is_empty"),
            F.lit(",".join(df.columns)).alias("columns"))
        out = one if out is None else out.unionByName(one)
    return out


def language_shares(df: DataFrame, n: int | None = None) -> DataFrame:
    return _ranked(agg.share_of_total(df, ["language"]), "sessions", ["language"], limit=n)


def dataset_statistics(df: DataFrame) -> DataFrame:
    return df.agg(_count().alias("total_sessions"), _total_cost(), _success_rate(), F.min(_day()).alias("first_day"),
                  F.max(_day()).alias("last_day"), F.count_distinct(_day()).alias("days_with_data"))


def model_costs(df: DataFrame) -> DataFrame:
    return _ranked(df.groupBy("model_name").agg(_count().alias("sessions"), _total_cost()), "sessions", ["model_name"])


def quick_checks(df: DataFrame, top: int | None = None, days: int | None = None) -> dict[str, DataFrame]:
    """Three small reports; ``top`` and ``days`` cut them."""
    by_lang = df.groupBy("language").agg(_count().alias("sessions"))
    cost = df.groupBy("model_name").agg(_count().alias("sessions"), _total_cost())
    daily = df.groupBy("year", "month", "day").agg(_count().alias("sessions"), _total_cost("daily_cost"))
    last = daily.orderBy(F.desc("year"), F.desc("month"), F.desc("day"))
    return {
        "sessions_by_language": _ranked(by_lang, "sessions", ["language"], limit=top),
        "cost_by_model": _ranked(cost, "total_cost", ["model_name"], limit=top),
        "last_days": last if days is None else last.limit(days),
    }


def monthly_trend(df: DataFrame, approx: bool = False) -> DataFrame:
    month = F.concat_ws("-", "year", "month").alias("month")
    return df.groupBy(month).agg(_count().alias("sessions"), _families("active_families", approx),
                                 _total_cost()).orderBy(F.desc("month"))


def cohorts(df: DataFrame, period: Column | None = None) -> DataFrame:
    """Active families per first-seen period and activity period.

    Rows collapse to one per (family, period) first, so the scan for the first period sees at most one row per
    period of a family, however many sessions it has.
    """
    period = F.concat_ws("-", "year", "month") if period is None else period
    active = df.groupBy("family_id_hash", period.alias("period")).agg(_count().alias("n"))
    first = active.groupBy("family_id_hash").agg(F.min("period").alias("cohort"))
    return (active.join(first, "family_id_hash").groupBy("cohort", "period")
            .agg(_count().alias("families"), F.sum("n").alias("sessions")).orderBy("cohort", "period"))


def by_source(df: DataFrame) -> DataFrame:
    out = df.groupBy("source").agg(_count().alias("sessions"), _families(), _total_cost(), _success_rate())
    return _ranked(out, "sessions", ["source"])


def peak_hours(df: DataFrame) -> DataFrame:
    out = df.groupBy(F.substring("timestamp", 12, 2).alias("hour")).agg(_count().alias("sessions"),
                                                                       _avg("latency_ms", "avg_latency_ms"))
    return _ranked(out, "sessions", ["hour"])
