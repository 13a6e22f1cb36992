"""Operators on data where one key holds most rows, against brute force in plain Python."""

import datetime as dt
import random

from pyspark.sql import functions as F

from custodia.operators import aggregates, catalog, dedupe, events, layout, ordered, quantiles

RNG = random.Random(7)


def skewed(n=3000):
    """(key, seq, flag, value): 'hot' has about four rows of five."""
    return [("hot" if RNG.random() < 0.8 else f"k{RNG.randrange(20)}", i, RNG.random() < 0.7, round(RNG.random() * 1000 - 200, 3)) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, seq bigint, flag boolean, value double")


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def test_run_lengths_over_chunks(spark):
    rows = skewed()
    # long runs that span several chunks
    rows = [(k, s, True if 500 < s < 1500 else f, v) for k, s, f, v in rows]
    want = {}
    for key, mine in by_key(rows).items():
        run, prev = 0, None
        for _, seq, flag, _ in mine:
            run = run + 1 if flag == prev else 1
            prev = flag
            want[seq] = run
    df = frame(spark, rows)
    got = ordered.run_lengths(df, ["key"], ["seq"], "flag", ordered.chunk_of(df, "seq", 97)).collect()
    assert {r["seq"]: r["run_length"] for r in got} == want


def test_numbered_previous_and_carry(spark):
    rows = skewed(1500)
    df = frame(spark, rows).withColumn("known", F.when(F.col("seq") % 400 == 7, F.col("value")))
    chunk = ordered.chunk_of(df, "seq", 50)
    out = ordered.numbered(df, ["key"], ["seq"], "n", chunk)
    out = ordered.previous(out, ["key"], ["seq"], "value", "before", chunk)
    out = ordered.carry_forward(out, ["key"], ["seq"], "known", "filled", chunk)
    out = ordered.carry_forward(out, ["key"], ["seq"], "known", "filled_before", chunk, inclusive=False)
    got = {r["seq"]: (r["n"], r["before"], r["filled"], r["filled_before"]) for r in out.collect()}
    for _, mine in by_key(rows).items():
        last, prev = None, None
        for i, (_, seq, _, value) in enumerate(mine):
            before = last
            last = value if seq % 400 == 7 else last
            assert got[seq] == (i + 1, prev, last, before)
            prev = value


def test_exact_percentiles(spark):
    rows = skewed(2000)
    got = {r["key"]: r for r in quantiles.percentiles(frame(spark, rows), ["key"], "value", {"p25": .25, "p95": .95}, exact=True).collect()}
    for key, mine in by_key(rows).items():
        values = sorted(r[3] for r in mine)
        for name, p in (("p25", .25), ("p95", .95)):
            pos = p * (len(values) - 1)
            lo, hi = values[int(pos)], values[min(int(pos) + 1, len(values) - 1)]
            assert abs(got[key][name] - (lo + (hi - lo) * (pos - int(pos)))) < 1e-9


def test_nearest_rank_small_and_large_groups(spark):
    rows = [("a", i, True, float(i)) for i in range(19)] + [("b", i, True, float(i)) for i in range(100)]
    got = {r["key"]: r for r in quantiles.nearest_rank(frame(spark, rows), ["key"], "value").collect()}
    assert (got["a"]["p50"], got["a"]["p95"], got["a"]["max"]) == (9.0, 18.0, 18.0)
    assert (got["b"]["p50"], got["b"]["p95"], got["b"]["p99"]) == (50.0, 95.0, 99.0)


def test_top_per_key_keeps_the_hot_key_exact(spark):
    rows = skewed()
    got = ordered.last_n(frame(spark, rows), ["key"], ["seq"], 25).collect()
    assert {(r["key"], r["seq"]) for r in got} == {(k, r[1]) for k, mine in by_key(rows).items() for r in mine[-25:]}


def test_sample_set(spark):
    rows = skewed()
    got = {r["key"]: r for r in aggregates.sample_set(frame(spark, rows), ["key"], "value", 10).collect()}
    for key, mine in by_key(rows).items():
        values = sorted({r[3] for r in mine})
        assert got[key]["samples"] == values[:10] and got[key]["cardinality"] == len(values)


def brute_dedupe(rows, ttl):
    out, cache = {}, {}
    for rid, key, t, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        hit = key in cache and t < cache[key][0] + ttl
        out[rid] = (not hit, cache[key][1] if hit else None)
        if not hit and ok:
            cache[key] = (t, rid)
    return out


def test_dedupe_chain_on_a_hot_key(spark):
    start = dt.datetime(2024, 1, 1)
    for ttl, chunk_ttls in ((60, 2), (60, 16), (7, 3), (3600, 2)):
        rows = [(i, "hot" if RNG.random() < 0.8 else f"k{RNG.randrange(5)}", RNG.randrange(4000), RNG.random() < 0.7) for i in range(1500)]
        rows += [(5000 + i, "quiet", t, ok) for i, (t, ok) in enumerate([(0, False), (10, True), (100_000, True), (100_001, False), (300_000, False)])]
        df = spark.createDataFrame([(i, k, start + dt.timedelta(seconds=t), ok) for i, k, t, ok in rows], "request_id bigint, key string, ts timestamp, ok boolean")
        got = dedupe.dedupe_requests(df, F.col("key"), "ts", "request_id", ~F.col("ok"), ttl, chunk_ttls).collect()
        assert {r["request_id"]: (r["executed"], r["served_by"]) for r in got} == brute_dedupe(rows, ttl)


def test_health_and_ewma_follow_the_state_machine(spark):
    rows = [("hot" if RNG.random() < 0.8 else "cold", i, RNG.choice(["HEALTHY", "HEALTHY", "DEGRADED", "UNHEALTHY", "UNHEALTHY"]),
             0.0 if i < 20 else round(RNG.random() * 100, 2)) for i in range(1200)]
    changes, averages = {}, {}
    for key, mine in by_key(rows).items():
        status, good, bad, average = "UNKNOWN", 0, 0, 0.0
        for _, seq, seen, ms in mine:
            before = status
            if seen == "HEALTHY":
                average = ms if average == 0 else 0.3 * ms + 0.7 * average
            if seen != "UNHEALTHY":
                good, bad = good + 1, 0
                status = seen if good >= 2 else status
            else:
                good, bad = 0, bad + 1
                status = "UNHEALTHY" if bad >= 3 else status
            if status != before:
                changes[seq] = (before, status)
        averages[key] = average
    df = spark.createDataFrame(rows, "agent string, seq bigint, status string, response_time_ms double")
    got = events.health_transitions(df, chunk_size=61).collect()
    assert {r["seq"]: (r["from_status"], r["to_status"]) for r in got} == changes
    for r in events.ewma_latency(df, chunk_size=61).collect():
        assert abs(r["ewma_ms"] - averages[r["agent"]]) < 1e-6


def test_prefix_anti_joins(spark):
    alphabet = "ab/"
    found = {("b" + str(RNG.randrange(2)), "".join(RNG.choice(alphabet) for _ in range(RNG.randrange(1, 8)))) for _ in range(400)}
    known = {("b0", "a"), ("b0", "b/a"), ("b1", "aa/b"), ("b1", "/")}
    got = layout.uncatalogued_prefixes(spark.createDataFrame(sorted(found), "bucket string, prefix string"),
                                       spark.createDataFrame(sorted(known), "bucket string, prefix string")).collect()
    assert {tuple(r) for r in got} == {(b, p) for b, p in found if not any(kb == b and p.startswith(kp) for kb, kp in known)}
    paths = {b + p for b, p in found}
    targets = {"b0a/", "b1bb", "b0abbbbbbbbbb"}
    got = layout.not_covered(spark.createDataFrame([(p,) for p in sorted(paths)], "path string"), spark.createDataFrame([(t,) for t in targets], "path string")).collect()
    assert {r[0] for r in got} == {p for p in paths if not any(p.startswith(t) or t.startswith(p) for t in targets)}


def test_foreign_keys_count_hot_orphans(spark):
    child = spark.range(1000).selectExpr("CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 99 ELSE id END AS k")
    got = {r["key"]: r["orphan_rows"] for r in catalog.foreign_key_check(child, "k", spark.range(50).toDF("k2"), "k2").collect()}
    assert got[99] == 333 and sum(got.values()) == sum(1 for i in range(1000) if i % 3 and (i % 3 == 1 or i >= 50))
