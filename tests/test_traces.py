"""Trace trees: odd shapes, and the number of rounds for a deep one."""

import pytest

from custodia.operators import traces


def tree(spark, rows, depth=None):
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, duration_ms long")
    return {r.trace_id: r for r in traces.trace_tree(df, depth).collect()}


def test_a_repeated_id_under_two_parents_ends(spark):
    r = tree(spark, [("t", "A", None, 5), ("t", "B", "A", 3), ("t", "A", "B", 4)])["t"]
    assert (r.reached, r.depth, r.critical_ms, r.critical_path, r.repeated, r.cyclic) == (2, 2, 8, ["A", "B"], 1, 0)


def test_cycles_orphans_and_rootless_traces(spark):
    rows = [("c", "R", None, 1), ("c", "X", "Y", 2), ("c", "Y", "Z", 2), ("c", "Z", "X", 2), ("c", "W", "X", 9), ("c", "S", "S", 1),
            ("o", "A", "gone", 1), ("o", "B", "A", 1), ("o", "R", None, 7), ("m", "R", None, 1), ("m", "Q", None, None), (None, "A", None, 1), ("n", None, None, 1)]
    got = tree(spark, rows)
    assert set(got) == {"c", "o", "m"}
    assert (got["c"].reached, got["c"].cyclic, got["c"].orphaned, got["c"].critical_path) == (1, 5, 0, ["R"])
    assert (got["o"].reached, got["o"].orphaned, got["o"].critical_ms) == (1, 2, 7)
    assert (got["m"].reached, got["m"].critical_path, got["m"].critical_ms) == (2, ["R"], 1)
    only = tree(spark, [("x", "A", "B", 1), ("x", "B", "A", 1)])["x"]
    assert (only.reached, only.depth, only.critical_ms, only.critical_path, only.cyclic) == (0, 0, None, [], 2)


def test_calls_of_one_span_and_ties(spark):
    rows = [("t", "A", None, 1), ("t", "B", "A", 2), ("t", "B", "A", 9), ("t", "C", "B", 0), ("t", "D", "B", 0), ("t", "E", "A", 9)]
    r = tree(spark, rows)["t"]
    assert (r.reached, r.depth, r.critical_ms, r.critical_path, r.repeated) == (1 + 2 + 2 * 2 + 1, 3, 10, ["A", "B", "D"], 0)
    cut = tree(spark, rows, 2)["t"]
    assert (cut.reached, cut.depth, cut.critical_path, cut.truncated) == (4, 2, ["A", "E"], True)
    with pytest.raises(ValueError):
        tree(spark, rows, 0)


def test_a_long_chain_takes_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).selectExpr("'t' AS trace_id", "id AS span_id", "IF(id > 0, id - 1, NULL) AS parent_span_id", "1L AS duration_ms")
    places, rounds = traces.pointers(chain)
    assert len(rounds) <= 18 and places.agg({"depth": "max"}).first()[0] == n
    r = traces.trace_tree(chain).first()
    assert r.reached == r.depth == r.critical_ms == n and r.critical_path == list(range(n))


def test_empty(spark):
    assert tree(spark, []) == {}
