"""Session files: newline JSON under year=/month=/day=, and a generator of realistic sessions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from custodia.schemas import SESSION_PARTITIONS, SESSION_SCHEMA

# fixed values: weights of the generated dimensions
LANGUAGE_WEIGHTS = {
    "en-GB": 0.25, "en-US": 0.15, "es-ES": 0.15, "fr-FR": 0.12, "de-DE": 0.10,
    "it-IT": 0.08, "pt-BR": 0.06, "nl-NL": 0.04, "pl-PL": 0.03, "ja-JP": 0.02,
}
REGION_WEIGHTS = {
    "eu-west-1": 0.35, "eu-west-2": 0.20, "us-east-1": 0.20, "us-west-2": 0.10, "ap-northeast-1": 0.08, "sa-east-1": 0.07,
}
# fixed values: model -> provider, weight, price per 1000 input tokens, price per 1000 output tokens
MODELS = {
    "claude-3-haiku-20240307": ("anthropic", 0.60, 0.00025, 0.00125),
    "claude-3-sonnet-20240229": ("anthropic", 0.25, 0.003, 0.015),
    "claude-3-opus-20240229": ("anthropic", 0.10, 0.015, 0.075),
    "gpt-4o-mini": ("openai", 0.05, 0.00015, 0.0006),
}
SLOW_MODEL, SLOW_EXTRA_MS = "claude-3-opus", 1000
SOURCES = ["mobile_app", "web_app", "alexa_skill", "google_assistant"]
ERROR_CODES = ["TIMEOUT", "RATE_LIMIT", "CONTENT_FILTER", "MODEL_ERROR"]
SUCCESS_SLOTS = 9
# fixed values: input and output token ranges per complexity tier
TOKEN_TIERS = [((50, 200), (30, 150)), ((200, 500), (100, 300)), ((500, 1500), (200, 800))]


def _uniform(seed: int, draw: int, key: str) -> Column:
    """Uniform in [0, 1) from a hash of seed, draw and row key.

    Unlike ``rand`` it does not depend on how rows are split into tasks, so a recomputed task repeats itself.
    """
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(draw), F.col(key)), 11)
    return bits.cast("double") / F.lit(float(2 ** 53))


def _weighted(u: Column, weights: dict[str, float]) -> Column:
    out, total, last = F, 0.0, None
    for name, weight in weights.items():
        total += weight
        out, last = out.when(u < total, name), name
    return out.otherwise(last)


def _between(u: Column, low: int | Column, high: int | Column) -> Column:
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return (low + F.floor(u * (high - low + 1))).cast("int")


def sessions_for(ids: DataFrame, start: dt.datetime, end: dt.datetime, seed: int = 42, key: str = "id",
                 stage: str = "prod") -> DataFrame:
    """One generated session per row of ``ids``; narrow, so it scales with the number of ids."""
    u = lambda draw: _uniform(seed, draw, key)
    n_families = 9000 * 100
    family = F.floor(u(1) * n_families)
    family_id = F.substring(F.sha2(F.concat(F.lit("family_"), family.cast("string")), 256), 1, 16)
    child = _between(u(2), 1, 3)
    tier = F.floor(u(3) * len(TOKEN_TIERS)).cast("int")
    def tokens(side: int, draw: int) -> Column:
        out = F
        for i, bounds in enumerate(TOKEN_TIERS):
            out = out.when(tier == i, _between(u(draw), *bounds[side]))
        return out
    seconds = (end - start).total_seconds()
    stamp = F.timestamp_micros((F.lit(int(start.replace(tzinfo=dt.timezone.utc).timestamp() * 1e6))
                                + F.floor(u(4) * seconds * 1e6)).cast("bigint"))
    def price(i: int) -> Column:
        out = F
        for name, values in MODELS.items():
            out = out.when(F.col("model_name") == name, F.lit(values[i]))
        return out
    provider = F
    for name, values in MODELS.items():
        provider = provider.when(F.col("model_name") == name, values[0])
    slot = F.floor(u(5) * (SUCCESS_SLOTS + len(ERROR_CODES))).cast("int")
    base = ids.select(
        F.sha2(F.concat_ws(":", F.lit(seed), F.col(key)), 256).alias("session_id"), family_id.alias("family_id_hash"),
        child.alias("__child"), _weighted(u(6), LANGUAGE_WEIGHTS).alias("language"), _weighted(u(7), REGION_WEIGHTS).alias("region"),
        F.element_at(F.array(*[F.lit(s) for s in SOURCES]), _between(u(8), 1, len(SOURCES))).alias("source"), F.lit(stage).alias("stage"),
        stamp.alias("__ts"), _between(u(9), 5, 300).alias("duration_seconds"), _between(u(10), 200, 2000).alias("__latency"),
        slot.alias("__slot"), _weighted(u(11), {m: v[1] for m, v in MODELS.items()}).alias("model_name"),
        tokens(0, 12).alias("input_tokens"), tokens(1, 13).alias("output_tokens"))
    cost = F.col("input_tokens") / 1000 * price(2) + F.col("output_tokens") / 1000 * price(3)
    return base.select(
        "session_id", "family_id_hash",
        F.substring(F.sha2(F.concat_ws("_", F.lit("child"), "family_id_hash", "__child"), 256), 1, 16).alias("child_id_hash"),
        "language", "region", "source", "stage", F.date_format("__ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        "duration_seconds", (F.col("__latency") + F.when(F.col("model_name").startswith(SLOW_MODEL), SLOW_EXTRA_MS).otherwise(0)).alias("latency_ms"),
        cost.cast("decimal(18,6)").alias("cost_usd"), (F.col("__slot") < SUCCESS_SLOTS).alias("success"),
        F.when(F.col("__slot") >= SUCCESS_SLOTS, F.element_at(F.array(*[F.lit(e) for e in ERROR_CODES]), F.col("__slot") - SUCCESS_SLOTS + 1)).alias("error_code"),
        provider.alias("model_provider"), "model_name", "input_tokens", "output_tokens",
        F.date_format("__ts", "yyyy").alias("year"), F.date_format("__ts", "MM").alias("month"), F.date_format("__ts", "dd").alias("day"))


def generate_sessions(spark: SparkSession, n: int, start: dt.datetime, end: dt.datetime, seed: int = 42) -> DataFrame:
    return sessions_for(spark.range(n), start, end, seed)


def read_sessions(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Sessions under ``year=/month=/day=``; partition values come from the path only.

    The schema states the partition columns as strings, so ``month=01`` is not read as a number and predicates on
    the partition columns prune directories.
    """
    df = spark.read.schema(SESSION_SCHEMA).format(fmt).load(path)
    return df.withColumn("error_code", F.nullif(F.col("error_code"), F.lit(""))).select(*SESSION_SCHEMA.names)


def write_sessions(df: DataFrame, path: str, fmt: str = "json", mode: str = "append") -> None:
    """Write by day; the body keeps ``""`` for no error.

    Rows are rebalanced by day: small days become one file, a day larger than the advisory partition size is split
    over several tasks and files.
    """
    body = df.withColumn("error_code", F.coalesce("error_code", F.lit("")))
    body.hint("rebalance", *[F.col(c) for c in SESSION_PARTITIONS]).write.mode(mode).partitionBy(
        *SESSION_PARTITIONS).format(fmt).save(path)
