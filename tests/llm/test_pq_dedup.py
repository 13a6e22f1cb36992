"""Embedding near-duplicates against brute force."""

import math

import numpy as np

from custodia.llm import pq_dedup
from custodia.llm.queries import QUERIES

from .conftest import components


def brute(rows):
    def ok(v):
        return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, pairs = {i: 0 for i, *_ in rows}, []
    for label in {lab for _, _, lab in rows if lab is not None}:
        for dim in {len(v) for _, v, lab in rows if lab == label and ok(v)}:
            part = [(i, v) for i, v, lab in rows if lab == label and ok(v) and len(v) == dim]
            x = np.array([v for _, v in part], np.float64)
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            a, b = np.nonzero(np.triu(x @ x.T >= 0.93, 1))
            for i, j in zip(a, b, strict=True):
                links[part[i][0]] += 1
                links[part[j][0]] += 1
                pairs.append((part[i][0], part[j][0]))
    low = components(links, pairs)
    return {i: (links[i], low[i], low[i] == i) for i in links}


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in QUERIES["op4_pq_dedup"](spark, sf_dir).collect()}
    assert set(got) == set(want)
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and found >= 0.98 * there
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_dense_groups_in_small_tiles(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(4):
        centre = rng.normal(size=16)
        rows += [(len(rows) + k, [float(x) for x in centre + rng.normal(size=16) * 0.12], g % 2) for k in range(60)]
    rows += [(1000 + k, rows[0][1], 0) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.groups(df, tile=16, probes=64).collect()}
    assert got == brute(rows)  # every list visited: exact, whatever the tiles


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [1.0, None], 1), (7, [nan, 1.0], 1),
            (8, [inf, 1.0], 1), (9, [], 1), (10, [1.0, 0.0, 0.0], 1), (11, [2e200, 0.0], 1), (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1), (14, [1.0, 0.0], 2),
            (15, [3e-300, 0.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in pq_dedup.groups(df).collect()}
    assert got == brute(rows)
    assert pq_dedup.groups(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)], df.schema)
    assert sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in pq_dedup.groups(twice).collect()) == [("1", 1, "1"), ("1", 1, "1"), ("None", 0, "None")]
