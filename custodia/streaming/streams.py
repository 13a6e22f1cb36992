"""Streaming twins of the session, request, audit and health operators.

Windows, de-duplication and audit streams have a watermark that bounds their state. The health stream keeps four
numbers for each agent it has seen, and no watermark. The ``_in_order`` variants of de-duplication and health hold
rows back until the watermark has passed them, so that their results are those of the batch operators.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from custodia.functions.numbers import count_true, pct
from custodia.operators import events
from custodia.schemas import SESSION_PARTITIONS, SESSION_SCHEMA
from custodia.session import scratch_path, ship_package


def session_stream(spark: SparkSession, path: str, fmt: str = "json", max_files: int | None = None) -> DataFrame:
    """Sessions as they arrive, with ``event_time`` parsed from the ISO string."""
    reader = spark.readStream.schema(SESSION_SCHEMA).format(fmt)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    df = reader.load(path).withColumn("error_code", F.nullif(F.col("error_code"), F.lit("")))
    return df.withColumn("event_time", F.to_timestamp(F.substring("timestamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))


def kafka_stream(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Sessions from a Kafka topic with JSON values (needs the Kafka package on the classpath)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    body = raw.select(F.from_json(F.col("value").cast("string"), SESSION_SCHEMA).alias("s")).select("s.*")
    return body.withColumn("event_time", F.to_timestamp(F.substring("timestamp", 1, 19), "yyyy-MM-dd'T'HH:mm:ss"))


def write_stream(df: DataFrame, path: str, checkpoint: str, partition_by: tuple[str, ...] = (),
                 available_now: bool = True) -> StreamingQuery:
    """Append to Parquet, exactly once through the checkpoint."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


def run_available(df: DataFrame, label: str) -> DataFrame:
    """Process what is there now and return the written result."""
    spark = df.sparkSession
    out = scratch_path(spark, label)
    write_stream(df, f"{out}/data", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/data")


def ingest_sessions(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Arrivals into Parquet by day."""
    return write_stream(stream.select(*SESSION_SCHEMA.names), path, checkpoint, tuple(SESSION_PARTITIONS), available_now)


def session_kpis(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Tumbling-window trend; rows later than the watermark are dropped. Families are counted with a sketch,
    because exact distinct counts are not available on streams."""
    grouped = stream.withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w"))
    return grouped.agg(
        F.count(F.lit(1)).alias("sessions"), F.approx_count_distinct("family_id_hash").alias("active_families"),
        F.sum("cost_usd").alias("total_cost"), F.avg("latency_ms").alias("avg_latency_ms"),
        pct(count_true(F.col("success")), F.count(F.lit(1))).alias("success_rate")).select("w.start", "w.end", *[
            c for c in ("sessions", "active_families", "total_cost", "avg_latency_ms", "success_rate")])


def request_metrics(stream: DataFrame, window: str = "1 minute", delay: str = "5 minutes", ts: str = "ts") -> DataFrame:
    grouped = stream.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "agent", "capability")
    return grouped.agg(*events.request_totals(), F.percentile_approx("duration_ms", 0.5).alias("p50_ms"),
                       F.percentile_approx("duration_ms", 0.99).alias("p99_ms")).select(
        "w.start", "w.end", "agent", "capability", "requests", "errors", "error_rate", "avg_ms", "p50_ms", "p99_ms")


#: Rows of a key that are folded and given out at a time.
_SLICE = 100_000
#: In place of a null number, which plain arrays do not hold: a time before all others, an id behind all others.
_NO_TIME, _NO_ID = -(2 ** 63), 2 ** 63 - 1


def _sorted_rows(batches: Iterator[pd.DataFrame], kinds: Mapping[str, str], order: list[str], held: dict[str, np.ndarray] | None = None) -> dict[str, np.ndarray]:
    """The columns ``kinds`` (name and type) of a key's rows, those of ``held`` first, stably sorted by ``order``.

    A key has as many rows as its trigger brings, so nothing else of them is kept: plain numbers, copied out of each
    batch, and one column at a time is put together and sorted.
    """
    parts = {name: [] if held is None else [held.pop(name)] for name in kinds}
    for batch in batches:
        if len(batch):
            for name, kind in kinds.items():
                parts[name].append(batch[name].astype(kind).to_numpy(copy=True))
    rows = {name: np.concatenate(parts.pop(name)) if parts[name] else np.empty(0, kind) for name, kind in kinds.items()}
    by = np.lexsort([rows[name] for name in reversed(order)])
    for name in rows:
        rows[name] = rows[name][by]
    return rows


def _slices(rows: dict[str, np.ndarray], end: int) -> Iterator[dict[str, np.ndarray]]:
    for start in range(0, end, _SLICE):
        yield {name: column[start:min(start + _SLICE, end)] for name, column in rows.items()}


def _whole(values: np.ndarray, missing: np.ndarray | bool = False) -> pd.arrays.IntegerArray:
    return pd.arrays.IntegerArray(values, (values == _NO_ID) | missing)


_DEDUPE_STATE = "us bigint, id string"
_DEDUPE_OUT = "request_id bigint, executed boolean, served_by bigint"
_REQUEST = {"us": "int64", "request_id": "int64", "ok": "bool"}


def _requests(stream: DataFrame, key: Column, delay: str, ts: str, request_id: str, failed: str) -> DataFrame:
    """Requests by key ``k`` as the folds take them; one without a time or an id has _NO_TIME or _NO_ID there."""
    return stream.withWatermark(ts, delay).select(
        key.alias("k"), F.col(ts), F.coalesce(F.unix_micros(F.col(ts)), F.lit(_NO_TIME)).alias("us"),
        F.coalesce(F.col(request_id).cast("bigint"), F.lit(_NO_ID)).alias("request_id"), F.coalesce(F.expr(f"NOT ({failed})"), F.lit(False)).alias("ok"))


def _ttl_step(ttl_us: int) -> Callable:
    def step(key: tuple, memory: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, pd.DataFrame]:
        last, by = memory
        us, ids, ok = rows["us"], rows["request_id"], rows["ok"]
        n = len(us)
        hit, served = np.zeros(n, bool), np.zeros(n, np.int64)
        # the next success at or behind each row
        following = np.minimum.accumulate(np.where(ok, np.arange(n), n)[::-1])[::-1]
        at = int(np.searchsorted(us, _NO_TIME, "right"))  # without a time: executed, and serves none
        while at < n:
            if last is not None and us[at] < last + ttl_us:
                end = int(np.searchsorted(us, last + ttl_us, "left"))
                hit[at:end], served[at:end] = True, by
                at = end
            else:
                at = int(following[at])
                if at < n:
                    last, by = int(us[at]), int(ids[at])
                    at += 1
        return (last, by), pd.DataFrame({"request_id": _whole(ids), "executed": ~hit, "served_by": _whole(served, ~hit)})
    return step


def _ttl_fold(ttl_us: int):
    step = _ttl_step(ttl_us)

    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last_us, last_id = state.get if state.exists else (None, None)
        memory = last_us, None if last_us is None else int(last_id)
        rows = _sorted_rows(batches, _REQUEST, ["us", "request_id"])
        for part in _slices(rows, len(rows["us"])):
            memory, out = step(key, memory, part)
            yield out
        if memory[0] is not None:
            state.update((memory[0], str(memory[1])))
            # never before the watermark; entries go once it passes the end of their window
            state.setTimeoutTimestamp(max((memory[0] + ttl_us) // 1000, state.getCurrentWatermarkMs() + 1))
    return fold


def dedupe_requests(stream: DataFrame, key: Column, ttl_seconds: int = 3600, delay: str = "10 minutes", ts: str = "ts",
                    request_id: str = "request_id", failed: str = "status = 'ERROR'") -> DataFrame:
    """Executed or served from cache, with the same rule as in batch: the window restarts at each accepted success.

    State is one timestamp and id per key and leaves when the watermark passes its window. Rows are ordered within
    a trigger; a row arriving in a later trigger than its successors is judged against what was accepted by then.
    A task holds 17 bytes of each row that a trigger brings for a key, about twice that while it sorts them.
    """
    ship_package(stream.sparkSession)
    rows = _requests(stream, key, delay, ts, request_id, failed)
    return rows.groupBy("k").applyInPandasWithState(_ttl_fold(ttl_seconds * 1_000_000), _DEDUPE_OUT, _DEDUPE_STATE, "append",
                                                    GroupStateTimeout.EventTimeTimeout)


_HELD = "memory binary, held binary"


def _pack(rows: dict[str, np.ndarray] | None) -> bytes | None:
    """Sorted rows for the state, which Spark hands to the fold with each 10,000 rows that come: times as steps, columns
    laid out by the places of their bytes, so that the bytes that seldom change take next to no room."""
    if rows is None:
        return None
    steps = {**rows, "us": np.diff(rows["us"], prepend=np.int64(0))}
    return pickle.dumps({name: (str(column.dtype), zlib.compress(np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T), 1)) for name, column in steps.items()})


def _unpack(packed: bytes | None) -> dict[str, np.ndarray] | None:
    if packed is None:
        return None
    rows = {}
    for name, (kind, data) in pickle.loads(packed).items():
        wide = np.dtype(kind).itemsize
        rows[name] = np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(wide, -1).T).view(kind).ravel()
    return {**rows, "us": np.cumsum(rows["us"])}


def _in_order(step: Callable, fresh: Any, kinds: Mapping[str, str], order: list[str], wake: Callable) -> Callable:
    """A fold over a key's rows in the order of their event time (``us``, then the rest of ``order``), across triggers.

    Rows wait in the state until the watermark has passed them, as no earlier one can come then; of each its columns
    ``kinds`` (see ``_sorted_rows``). ``step(key, memory, rows)`` folds a slice of what is settled and gives the new
    memory and a frame; ``wake(memory)`` is the event time in microseconds at which a key without waiting rows may be
    forgotten, or None for never.
    """
    def fold(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, held = fresh, None
        if state.exists:
            memory, held = pickle.loads(state.get[0]), _unpack(state.get[1])
        rows = _sorted_rows(batches, kinds, order, held)
        mark = state.getCurrentWatermarkMs()
        settled = int(np.searchsorted(rows["us"], mark * 1000, "left"))
        for part in _slices(rows, settled):
            memory, out = step(key, memory, part)
            yield out
        rest = {name: rows.pop(name)[settled:].copy() for name in kinds} if settled < len(rows["us"]) else None
        due = wake(memory) if rest is None else int(rest["us"][0])
        if due is not None and rest is None and due <= mark * 1000:
            state.remove()
        else:
            state.update((pickle.dumps(memory), _pack(rest)))
            if due is not None:
                state.setTimeoutTimestamp(max(due // 1000 + 1, mark + 1))
    return fold


def dedupe_requests_in_order(stream: DataFrame, key: Column, ttl_seconds: int = 3600, delay: str = "10 minutes", ts: str = "ts",
                             request_id: str = "request_id", failed: str = "status = 'ERROR'") -> DataFrame:
    """``dedupe_requests`` with every request judged in the order of event time, however late it came within ``delay``.

    A request comes out when the watermark passes it; requests later than that are dropped. The rule is folded per
    accepted request, not per row. A key is forgotten when its window has passed. The state holds about 7 bytes of
    each request that waits, in one value per key, and a task about 40 of each that comes or waits for its key.
    """
    ship_package(stream.sparkSession)
    rows = _requests(stream, key, delay, ts, request_id, failed)
    ttl = ttl_seconds * 1_000_000
    fold = _in_order(_ttl_step(ttl), (None, None), _REQUEST, ["us", "request_id"], lambda memory: 0 if memory[0] is None else memory[0] + ttl)
    return rows.groupBy("k").applyInPandasWithState(fold, _DEDUPE_OUT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def rate_breaches(stream: DataFrame, limit: int = events.RATE_LIMIT_PER_MINUTE, window: str = "1 minute",
                  delay: str = "5 minutes", caller: str = "caller", ts: str = "ts") -> DataFrame:
    return events.rate_breaches(stream.withWatermark(ts, delay), limit, caller, ts, window)


def audit_trail(stream: DataFrame, delay: str = "1 hour", event_id: str = "audit_id", ts: str = "ts") -> DataFrame:
    """Normalised audit rows, each event once."""
    once = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([event_id])
    return once.select(F.col(ts).alias("timestamp"), F.lit("data_access").alias("event_type"), "user_id", "action", "resource",
                       F.col("decision").alias("outcome"), F.to_date(ts).alias("event_date"))


def pii_access_alerts(stream: DataFrame, levels: Mapping[str, str]) -> DataFrame:
    """Stateless: the classification is a literal map inside the projection."""
    return events.pii_access_alerts(stream, levels)


_STATE = "status string, good int, bad int, average double"
_OUT = "agent string, seq bigint, from_status string, to_status string, average_ms double"


_CHECK = {"seq": "int64", "status": "int8", "response_time_ms": "float64"}
_KINDS = np.array(["HEALTHY", "DEGRADED", "UNHEALTHY"], object)


def _checks(stream: DataFrame, *times: Column) -> DataFrame:
    """Checks as the folds take them: the status as its place in _KINDS (all others are bad), a missing number as _NO_ID."""
    status = F.when(F.col("status") == "HEALTHY", 0).when(F.col("status") == "DEGRADED", 1).otherwise(2).cast("tinyint")
    return stream.select("agent", *times, F.coalesce(F.col("seq").cast("bigint"), F.lit(_NO_ID)).alias("seq"), status.alias("status"), "response_time_ms")


def _advance(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    status, good, bad, average = state.get if state.exists else ("UNKNOWN", 0, 0, 0.0)
    memory = status, good - bad, average
    rows = _sorted_rows(batches, _CHECK, ["seq"])
    for part in _slices(rows, len(rows["seq"])):
        memory, out = _health_step(key, memory, part)
        yield out
    status, run, average = memory
    state.update((status, max(run, 0), max(-run, 0), average))


def _health_step(key: tuple, memory: tuple, rows: dict[str, np.ndarray]) -> tuple[tuple, pd.DataFrame]:
    status, run, average = memory  # run: good checks in a row, or bad ones as a negative number
    seen, took = _KINDS[rows["status"]], rows["response_time_ms"]
    good = np.isin(seen, ("HEALTHY", "DEGRADED"))
    # runs of good and bad checks; the first goes on with the run held
    begins = np.flatnonzero(np.concatenate(([True], good[1:] != good[:-1])))
    place = np.arange(len(good)) - np.repeat(begins, np.diff(np.append(begins, len(good)))) + 1
    if (run > 0) == good[0] and run:
        place[:begins[1] if len(begins) > 1 else None] += abs(run)
    sets = np.where(good & (place >= events.HEALTHY_AFTER), seen, np.where(~good & (place >= events.UNHEALTHY_AFTER), "UNHEALTHY", None))
    current = pd.Series(sets, dtype=object).ffill().fillna(status).to_numpy(object)
    before = np.concatenate(([status], current[:-1]))
    averages = np.empty(len(took))
    for i, (healthy, x) in enumerate(zip((seen == "HEALTHY").tolist(), took.tolist(), strict=True)):
        if healthy:
            average = x if average == 0 else events.EWMA_ALPHA * x + (1 - events.EWMA_ALPHA) * average
        averages[i] = average
    changed = current != before
    out = pd.DataFrame({"agent": key[0], "seq": _whole(rows["seq"][changed]), "from_status": before[changed], "to_status": current[changed], "average_ms": averages[changed]})
    return (current[-1], int(place[-1]) if good[-1] else -int(place[-1]), float(average)), out


def health_transitions_in_order(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """``health_transitions`` with the checks taken in the order of event time, however late they came within ``delay``.

    A change comes out when the watermark passes its check; checks later than that are dropped. Of each agent three
    values stay, and the checks that wait for the watermark.
    """
    ship_package(stream.sparkSession)
    rows = _checks(stream.withWatermark(ts, delay), F.col(ts), F.unix_micros(F.col(ts)).alias("us"))
    fold = _in_order(_health_step, ("UNKNOWN", 0, 0.0), {"us": "int64", **_CHECK}, ["us", "seq"], lambda memory: None)
    return rows.groupBy("agent").applyInPandasWithState(fold, _OUT, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def health_transitions(stream: DataFrame) -> DataFrame:
    """Status changes per agent with the running latency average; four numbers of state per agent.

    The state machine is sequential per agent by nature. A micro-batch holds one trigger's worth of checks, which
    the source bounds (``maxFilesPerTrigger`` or ``maxOffsetsPerTrigger``).
    """
    ship_package(stream.sparkSession)
    return _checks(stream).groupBy("agent").applyInPandasWithState(
        _advance, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)
