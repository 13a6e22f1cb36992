"""Streams fed in several triggers, with late rows."""

import datetime as dt
import uuid

from pyspark.sql import functions as F

from custodia.session import work_root
from custodia.streaming import streams as st

SCHEMA = "request_id bigint, ts timestamp, agent string, capability string, caller string, status string, duration_ms double"


def _feed(spark, batches):
    """Write each batch as one file, named so that the stream reads them in order."""
    path = f"{work_root(spark)}/feed-{uuid.uuid4().hex}"
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def _row(i, minute, status="SUCCESS", agent="a", caller="c"):
    return (i, dt.datetime(2024, 1, 1, 10, 0) + dt.timedelta(minutes=minute), agent, "x", caller, status, 1.0 * i)


def test_late_rows_are_dropped(spark):
    # the filter for late rows uses the watermark of the trigger before, so it takes two triggers to move on
    batches = [[_row(1, 0), _row(2, 1)], [_row(3, 60)], [_row(6, 61)], [_row(4, 2)], [_row(5, 200)]]
    out = st.run_available(st.request_metrics(_feed(spark, batches), "10 minutes", "5 minutes"), "late")
    got = {r["start"].strftime("%H:%M"): r["requests"] for r in out.collect()}
    # row 4 belongs to the first window but arrives after the watermark passed it
    assert got == {"10:00": 2, "11:00": 2}


def test_dedupe_restarts_its_window(spark):
    batches = [[_row(1, 0, "ERROR"), _row(2, 1)], [_row(3, 30), _row(4, 62)], [_row(5, 90, "ERROR"), _row(6, 125)]]
    out = st.run_available(st.dedupe_requests(_feed(spark, batches), F.col("agent"), 3600), "dedupe-test")
    got = {r["request_id"]: (r["executed"], r["served_by"]) for r in out.collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, 2), 4: (True, None), 5: (False, 4), 6: (True, None)}


def test_health_state_survives_triggers(spark):
    path = f"{work_root(spark)}/health-{uuid.uuid4().hex}"
    schema = "agent string, seq bigint, status string, response_time_ms double"
    for i, status in enumerate(["HEALTHY", "HEALTHY", "UNHEALTHY", "UNHEALTHY", "UNHEALTHY", "DEGRADED", "DEGRADED"]):
        spark.createDataFrame([("a", i, status, 10.0)], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    out = st.run_available(st.health_transitions(stream), "health-test")
    assert {r["seq"]: (r["from_status"], r["to_status"]) for r in out.collect()} == {
        1: ("UNKNOWN", "HEALTHY"), 4: ("HEALTHY", "UNHEALTHY"), 6: ("UNHEALTHY", "DEGRADED")}


def test_late_rows_are_folded_in_order(spark):
    """Five triggers with late rows and an end mark: all columns equal those of a fold over the sorted rows."""
    import random

    from custodia.operators import dedupe, events
    draw = random.Random(5)
    rows = [_row(i, draw.uniform(0, 1000), draw.choice(["SUCCESS", "SUCCESS", "ERROR"]), draw.choice("abc")) for i in range(400)]
    rows.sort(key=lambda r: r[1])
    batches = [[] for _ in range(6)]
    for r in rows:
        at = min(4, int((r[1] - rows[0][1]).total_seconds() / 60 / 200) + (draw.random() < 0.2))
        batches[at].append(r)
    batches[5] = [_row(1000, 100_000, agent="~end")]
    for b in batches:
        draw.shuffle(b)
    out = st.run_available(st.dedupe_requests_in_order(_feed(spark, batches), F.col("agent"), 1800, "220 minutes"), "in-order").collect()
    batch = dedupe.dedupe_requests(spark.createDataFrame(rows, SCHEMA), F.col("agent"), "ts", "request_id", F.col("status") == "ERROR", 1800)
    key = lambda r: (r.request_id, r.executed, r.served_by)
    assert sorted(map(key, out), key=str) == sorted(map(key, batch.select("request_id", "executed", "served_by").collect()), key=str)

    kinds = "HEALTHY", "HEALTHY", "DEGRADED", "UNHEALTHY", "UNHEALTHY"
    checks = [[(*r[:2], r[2], draw.choice(kinds), "", "", 100 * draw.random()) for r in b] for b in batches]
    stream = _feed(spark, checks).selectExpr("agent", "request_id AS seq", "ts", "capability AS status", "duration_ms AS response_time_ms")
    got = st.run_available(st.health_transitions_in_order(stream, delay="220 minutes"), "health-order").collect()
    want = []
    for agent in "abc":
        status, good, bad, average = "UNKNOWN", 0, 0, 0.0
        for seq, _, _, seen, _, _, took in sorted((r for b in checks for r in b if r[2] == agent), key=lambda r: r[1]):
            before = status
            if seen == "HEALTHY":
                average = took if average == 0 else events.EWMA_ALPHA * took + (1 - events.EWMA_ALPHA) * average
            good, bad = (0, bad + 1) if seen == "UNHEALTHY" else (good + 1, 0)
            status = seen if good >= 2 else "UNHEALTHY" if bad >= 3 else status
            if status != before:
                want.append((agent, seq, before, status, round(average, 9)))
    assert sorted((r.agent, r.seq, r.from_status, r.to_status, round(r.average_ms, 9)) for r in got) == sorted(want) and len(want) > 30


class _State:
    """A key's state as the folds see it, without Spark."""
    exists, hasTimedOut = False, False

    def getCurrentWatermarkMs(self):
        return 0

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutTimestamp(self, ms):
        self.due = ms


def test_a_fold_holds_plain_numbers_only_and_gives_out_slices():
    """Half a million rows of one key in one trigger: under 50 bytes of each at the peak, no frame of more than a slice."""
    import tracemalloc

    import numpy as np
    import pandas as pd
    n, ttl = 500_000, 3_600_000_000
    us = np.random.default_rng(1).permutation(n) * 7_000_000

    def batches():
        for i in range(0, n, 10_000):
            ids = np.arange(i, i + 10_000)
            yield pd.DataFrame({"k": [f"key {j % 1}" for j in ids], "ts": us[ids].astype("datetime64[us]"), "us": us[ids], "request_id": ids, "ok": ids % 3 > 0})

    state, rows, last, want = _State(), 0, None, {}
    tracemalloc.start()
    for frame in st._ttl_fold(ttl)((None,), batches(), state):
        assert len(frame) <= 100_000
        rows += len(frame)
        want.update(zip(frame["request_id"][:50], zip(frame["executed"][:50], frame["served_by"][:50], strict=True), strict=True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and peak < 50 * n
    for i in np.argsort(us):
        hit = last is not None and us[i] < us[last] + ttl
        if i in want:
            executed, served = want[i]
            assert executed == (not hit) and (served == last if hit else served is pd.NA)
        last = i if i % 3 and not hit else last
    assert state.get == (us[last], str(last))


def test_requests_without_a_time_or_an_id(spark):
    """One without a time is executed and serves none, as in batch; one without an id serves without naming itself."""
    rows = [(1, None, "a", "x", "c", "SUCCESS", 1.0), _row(-5, 1), _row(2, 2), (None, *_row(0, 90)[1:]), _row(3, 91)]
    out = st.run_available(st.dedupe_requests(_feed(spark, [rows]), F.col("agent"), 3600), "dedupe-nulls")
    got = {r["request_id"]: (r["executed"], r["served_by"]) for r in out.collect()}
    assert got == {1: (True, None), -5: (True, None), 2: (False, -5), None: (True, None), 3: (False, None)}


def test_waiting_rows_are_small_in_the_state():
    """Half a million rows of one key wait in under 10 bytes each, and come out in order over two triggers."""
    import numpy as np
    import pandas as pd
    n = 500_000
    draw = np.random.default_rng(2)
    us, ids, ok = draw.integers(0, 10 ** 12, n) + 1_700_000_000_000_000, draw.permutation(n), draw.random(n) < 0.7
    fold = st._in_order(st._ttl_step(3_600_000_000), (None, None), st._REQUEST, ["us", "request_id"], lambda memory: 0)
    state = _State()

    def trigger(rows, mark):
        state.getCurrentWatermarkMs = lambda: mark
        frame = pd.DataFrame({"us": us[rows], "request_id": ids[rows], "ok": ok[rows]})
        return list(fold((None,), iter([frame]), state))

    assert trigger(slice(0, n // 2), 0) == []
    assert trigger(slice(n // 2, n), 0) == [] and sum(map(len, state.get)) < 10 * n
    half = 1_700_000_500_000
    first = pd.concat(trigger(slice(0, 0), half))
    state.remove = lambda: None
    got = pd.concat([first, *trigger(slice(0, 0), 2 * half)])
    by = np.lexsort([ids, us])
    want = st._ttl_step(3_600_000_000)(None, (None, None), {"us": us[by], "request_id": ids[by], "ok": ok[by]})[1]
    assert len(first) == (us < half * 1000).sum() and got.reset_index(drop=True).equals(want)
