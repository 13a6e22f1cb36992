"""Exact duplicates against brute force, and the arithmetic of the fingerprints."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from custodia.llm import exact_dedup as ex


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(low(t), []).append(i)
    out = []
    for i, t in rows:
        same = groups[low(t)]
        known = [x for x in same if x is not None]
        out.append((i, max(known) if known else None, len(same), hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in ex.groups(df).collect()), key=str)


def test_fingerprints_compose():
    draw = random.Random(1)
    for _ in range(50):
        data = draw.randbytes(draw.randint(0, 5000))
        k = draw.randint(0, len(data))
        left, right = ex.shifted(ex.fingerprint(data[:k]), len(data) - k), ex.fingerprint(data[k:])
        assert tuple((a + b) % ex.P for a, b in zip(left, right, strict=True)) == ex.fingerprint(data)
    assert ex.fingerprint(b"\0") != ex.fingerprint(b"\0\0") != ex.fingerprint(b"")


ROWS = [(1, "Same text"), (2, "same TEXT"), (3, "other"), (4, None), (5, ""), (6, "É"), (7, "é"), (8, "same text"), (8, "same text"), (None, "other"), (None, "alone"), (9, "alone ")]


def test_odd_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, keep_id string")
    assert got(df.drop("keep_id")) == brute(ROWS) and got(df) == brute(ROWS)
    kept = sorted(((r.doc_id, r.text, r.keep_id) for r in ex.deduplicate(df).collect()), key=str)
    assert kept == sorted([(3, "other", "x"), (5, "", "x"), (6, "É", "x"), (7, "é", "x"), (8, "same text", "x"), (None, "alone", "x"), (9, "alone ", "x")], key=str)
    assert ex.groups(df.limit(0)).count() == 0 and ex.deduplicate(df.limit(0)).count() == 0


def test_huge_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(ex, "CHUNK", 64)
    draw = random.Random(3)
    base = "".join(draw.choice("abcDEF é\U0001f600") for _ in range(3000))
    rows = [(1, base), (2, base.upper() if base.upper().lower() == base else base), (3, base[:-1] + "!"), (4, base), (5, base + "x"), (5, base + "x"), (6, "s")]
    whole = {i: ex.fingerprint(low(t).encode()) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in ex.fingerprints(df).collect():
        # texts above 64 bytes have no hash of their own: these are sums of their pieces' hashes
        assert (r.f0, r.f1, r.f2, r.f3) == whole[r.doc_id]
    assert got(df) == brute(rows)


def test_texts_whose_fingerprints_meet_by_chance(spark, monkeypatch):
    real = ex.fingerprints

    def weak(docs):
        out = real(docs)
        from pyspark.sql import functions as F
        return out.withColumns({f: F.lit(7).cast("long") for f in ex.FP}).withColumn("n_bytes", F.lit(3).cast("long"))

    monkeypatch.setattr(ex, "fingerprints", weak)
    rows = [(1, "aaa"), (2, "bbb"), (3, "AAA"), (4, "ccc"), (5, "bbb"), (6, "ccc"), (7, "ddd")]
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_time_grows_with_the_length(spark):
    """Two equal texts and one that differs at its end: 32 MB take about twice the time of 16 MB."""
    import time
    took = []
    for mb in (2, 16, 32):
        df = spark.range(3).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.lit("Some text "), mb * 100_000), F.when(F.col("id") == 2, "x").otherwise("y")).alias("text"))
        start = time.time()
        assert sorted((r.doc_id, r.keep_id, r.group_size) for r in ex.groups(df).collect()) == [(0, 1, 2), (1, 1, 2), (2, 2, 1)]
        took.append(time.time() - start)
    assert took[2] < 3 * took[1], took
