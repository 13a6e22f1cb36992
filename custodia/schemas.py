"""Explicit schemas; nothing is inferred from data."""

from __future__ import annotations

from pyspark.sql import types as T

DIMENSION, METRIC, PARTITION, PLAIN = "dimension", "metric", "partition", "plain"


def _field(name: str, dtype: T.DataType, role: str) -> T.StructField:
    return T.StructField(name, dtype, True, metadata={"role": role})


_S, _I = T.StringType(), T.IntegerType()

SESSION_BODY = T.StructType([
    _field("session_id", _S, DIMENSION),
    _field("family_id_hash", _S, DIMENSION),
    _field("child_id_hash", _S, DIMENSION),
    _field("language", _S, DIMENSION),
    _field("region", _S, DIMENSION),
    _field("source", _S, DIMENSION),
    _field("stage", _S, DIMENSION),
    _field("timestamp", _S, PLAIN),
    _field("duration_seconds", _I, METRIC),
    _field("latency_ms", _I, METRIC),
    # decimal, so that totals do not depend on the order in which tasks add them up
    _field("cost_usd", T.DecimalType(18, 6), METRIC),
    _field("success", T.BooleanType(), DIMENSION),
    _field("error_code", _S, DIMENSION),
    _field("model_provider", _S, DIMENSION),
    _field("model_name", _S, DIMENSION),
    _field("input_tokens", _I, METRIC),
    _field("output_tokens", _I, METRIC),
])

SESSION_PARTITIONS = ["year", "month", "day"]

SESSION_SCHEMA = T.StructType(
    SESSION_BODY.fields + [_field(c, _S, PARTITION) for c in SESSION_PARTITIONS]
)

AUDIT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("event_type", _S),
    T.StructField("user_id", _S),
    T.StructField("action", _S),
    T.StructField("resource", _S),
    T.StructField("outcome", _S),
    T.StructField("details", _S),
])


def columns_with_role(schema: T.StructType, role: str) -> list[str]:
    return [f.name for f in schema.fields if f.metadata.get("role") == role]
