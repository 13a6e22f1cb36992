"""Hard negatives against all pairs in whole numbers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from custodia.llm import hard_negatives, queries


def brute(rows, is_anchor, positives=5, negatives=10, low=30, high=90):
    """rows: (vec_id, label, vector); the mined rows as a sorted list."""
    good = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) or not math.isfinite(x * 256) for x in v):
            continue
        good[i, label, tuple(math.floor(256 * x) for x in v)] = None
    out = []
    for i, label, v in good:
        if not is_anchor(i):
            continue
        dot = [(max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w, strict=True)))), j, m) for j, m, w in good if j != i and len(w) == len(v)]
        near = sorted((-s, j) for s, j, m in dot if m == label)[:positives]
        for ps, p in near:
            found = sorted((-s, j) for s, j, m in dot if m != label and -low * ps <= 100 * s <= -high * ps)[:negatives]
            out += [(i, p, r, j, -ps, -s) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


def mined(df, anchor):
    return sorted(tuple(r) for r in hard_negatives.mine(df, anchor).collect())


def test_query_is_all_pairs(spark, sf_dir):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_hard_negatives"](spark, sf_dir).collect())
    assert got == brute(rows, lambda i: i % 100 == 0) and len(got) > 200


def test_odd_rows_in_small_cells(spark, monkeypatch):
    """Nulls, clashing columns, repeats, ties, several dimensions, negative and zero scores, in many tiles and groups."""
    draw = random.Random(6)
    vec = lambda d, c: [draw.gauss(c, 0.5) for _ in range(d)]
    rows = [(i, draw.choice("abc"), vec(draw.choice((3, 3, 3, 5)), draw.choice((-1, 0, 1)))) for i in range(400)]
    rows += [(1000 + i, "a", [0.5, 0.5, 0.5]) for i in range(12)] + [(1100 + i, "b", [0.4, 0.4, 0.4]) for i in range(12)]
    rows += rows[:30] + [(20, "c", [9.0, 9.0, 9.0]), (None, "a", [1.0, 1.0, 1.0]), (2000, None, [1.0, 1.0, 1.0]), (2001, "a", None), (2002, "a", []),
                         (2003, "a", [1.0, None, 1.0]), (2004, "a", [float("nan"), 1.0, 1.0]), (2005, "b", [float("inf"), 1.0, 1.0]), (2010, "b", [0.0, 0.0, 0.0]),
                         (2020, "a", [0.0, 0.0, 0.0]), (3000, "z", [1.0] * 7), (3010, "a", [1e-9, -1e-9, 0.0]), (3020, "a", [1e307, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "vec_id long, label string, embedding array<double>, dim int, aid string").repartition(7)
    want = brute(rows, lambda i: i % 10 == 0)
    assert len(want) > 500
    for tile, group, step in ((hard_negatives.TILE, hard_negatives.GROUP, hard_negatives.STEP), (200, 30, 7), (600, 3000, 50)):
        for name, value in (("TILE", tile), ("GROUP", group), ("STEP", step), ("CLUSTERS", 3), ("MEMBERS", 5)):
            monkeypatch.setattr(hard_negatives, name, value)
        assert mined(df, F.col("vec_id") % 10 == 0) == want


def test_huge_numbers(spark):
    """Scores beyond 2^53 keep their last digit; beyond a long they are cut."""
    draw = random.Random(9)
    rows = [(i, "ab"[i % 2], [float(draw.randrange(-10 ** 6, 10 ** 6)) / 256 * 1000, draw.random() * 1e4]) for i in range(60)]
    rows += [(100 + i, "ab"[i % 2], [1e16 * (1 + i % 3), 1e16]) for i in range(8)]
    df = spark.createDataFrame(rows, "vec_id int, label string, embedding array<double>")
    assert mined(df, F.col("vec_id") % 10 == 0) == brute(rows, lambda i: i % 10 == 0)


def test_the_list_certifies(monkeypatch):
    """Where clusters are tight, a walk ends long before its list does."""
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(40, 8)) * 100
    rows = np.floor(centres[np.arange(4000) % 40] + draw.normal(size=(4000, 8)))
    members = rows[::400]  # all of one cluster
    order, bound = hard_negatives.shared_list(members, rows)
    u, n = hard_negatives.unit(members)
    assert ((members @ rows[order].T) <= n[:, None] * bound[None] + 1e-6).all() and (np.diff(bound) <= 0).all()
    seen = []
    monkeypatch.setattr(hard_negatives, "STEP", 64)
    least = np.full((len(members), 1), -np.inf)
    got = hard_negatives.walk(members, rows, np.arange(4000), lambda m, r: seen.append(len(r)) or np.ones((len(m), len(r)), bool), 5, least, -least)
    assert sum(seen) < 800
    want = [(m, 0, i, int(s)) for m in range(len(members)) for s, i in sorted(((members[m] @ r, i) for i, r in enumerate(rows)), key=lambda x: (-x[0], x[1]))[:5]]
    assert got == want


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, "a", [1.0]), (2, "b", [1.0])], "vec_id long, label string, embedding array<float>")
    assert mined(df.limit(0), F.col("vec_id") > 0) == [] and mined(df, F.lit(None).cast("boolean")) == [] and mined(df, F.lit(True)) == []
