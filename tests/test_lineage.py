"""Walks over laid-out edges, longest paths without listing paths, and walks over time."""

import datetime as dt
import random

from plan_flags import plan_of
from pyspark.sql import functions as F

from custodia.operators import lineage


def edges_of(spark, pairs):
    return spark.createDataFrame([(a, b, "r", None) for a, b in pairs], "src string, dst string, relationship string, transformation string")


def test_a_level_moves_its_frontier_only(spark):
    """The edges are read from their buckets, without an exchange, and one layout serves every level and caller."""
    laid = lineage.laid_out(edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(200)]))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = lineage.reach(laid, ["n0", "n50"], 1)
        lines = plan_of(out).splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    at = next(i for i, line in enumerate(lines) if "Bucketed: true" in line)
    above = []
    depth = len(lines[at]) - len(lines[at].lstrip(" :+-"))
    for line in reversed(lines[:at]):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            above.append(line)
            depth = d
            if "Join" in line:
                break
    assert "Join" in above[-1] and not any("Exchange" in line for line in above)
    assert laid.forward is laid.forward
    assert lineage.reach(laid, ["n0"], None).count() == 200


def listed(pairs, root, depth):
    """All paths as ``walk`` lists them."""
    out, live = [], [[root]]
    level = 0
    while live and (depth is None or level < depth):
        level += 1
        found = [[*p, b] for p in live for a, b in pairs if a == p[-1]]
        out += found
        live = [p for p in found if p[-1] not in p[:-1]]
    return out


def test_longest_path_is_that_of_all_paths(spark):
    draw = random.Random(4)
    for n, m, depth in ((6, 10, None), (7, 12, 4)):
        pairs = sorted({(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(m)})
        paths = listed(pairs, "n0", depth)
        want = min((p for p in paths if len(p) == max(map(len, paths))), default=None)
        got = lineage.longest_path(edges_of(spark, pairs), "n0", depth).first().path
        assert got == want, (pairs, depth)


def test_strong_components(spark):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "e"), ("g", "g"), ("x", "a"), ("f", "y"), ("y", "z")]
    got = {r.node: r.component for r in lineage.strong_components(spark.createDataFrame(pairs, "a string, b string")).collect()}
    assert got == {"a": "c", "b": "c", "c": "c", "e": "f", "f": "f", "g": "g"}


def test_a_ladder_of_diamonds_has_one_longest_path(spark):
    """40 diamonds: 2^40 paths, 121 nodes."""
    pairs = []
    for i in range(40):
        a, b = f"n{i:02}", f"n{i + 1:02}"
        pairs += [(a, f"{a}l"), (a, f"{a}r"), (f"{a}l", b), (f"{a}r", b)]
    r = lineage.lineage_summary(edges_of(spark, pairs), "n00", None).first()
    assert (r.downstream_nodes, r.downstream_depth, r.upstream_nodes) == (120, 80, 0)
    assert len(r.critical_path) == 81 and r.critical_path[:4] == ["n00", "n00l", "n01", "n01l"]


def test_one_walk_over_time_is_a_walk_per_date(spark):
    draw = random.Random(2)
    day = dt.date(2024, 1, 1)
    rows = []
    for _ in range(120):
        start = day + dt.timedelta(draw.randrange(100))
        end = None if draw.random() < 0.2 else start + dt.timedelta(draw.randrange(-2, 40))
        rows.append((f"n{draw.randrange(25)}", f"n{draw.randrange(25)}", "r", None, None if draw.random() < 0.05 else start, end))
    edges = spark.createDataFrame(rows, "src string, dst string, relationship string, transformation string, valid_from date, valid_to date")
    for forward in [True]:
        over = lineage.reach_over_time(edges, ["n0", "n1"], forward)
        spans = over.collect()
        for root in ("n0", "n1"):
            for node in {r.node for r in spans}:
                own = sorted((r.valid_from, r.valid_to or dt.date.max) for r in spans if r.node == node and r.root == root)
                assert all(a < b for a, b in own) and all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))
        laid_dates = [day + dt.timedelta(d) for d in (17, 61)]
        for date in laid_dates:
            at = F.lit(date)
            want = {(r.root, r.node) for r in lineage.reach(lineage.lineage_as_of(edges, at), ["n0", "n1"], None, forward).collect()}
            assert {(r.root, r.node) for r in spans if r.valid_from <= date and (r.valid_to is None or date < r.valid_to)} == want


def test_a_walk_compares_only_nodes_that_two_edges_lead_to(spark):
    """Chains are walked without a look at what was found before; elsewhere only nodes met again are looked up."""
    chain = lineage.reach(edges_of(spark, [(f"n{i}", f"n{i + 1}") for i in range(6)]), ["n0", "n3"], 3)
    assert "LeftAnti" not in plan_of(chain) and chain.count() == 6
    laid = lineage.laid_out(edges_of(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "a")]))
    assert sorted((r["__from"], r["__to"]) for r in laid.forward.where("__again").collect()) == [("a", "c"), ("b", "c")]
    assert lineage.reach(laid, ["d"], None).count() == 3


def test_reach_is_that_of_a_plain_walk(spark):
    """Random graphs with cycles, self-links, edges that come twice and edges to nowhere."""
    draw = random.Random(7)
    for depth, forward in ((None, True), (2, False)):
        rows = [(f"n{draw.randrange(14)}", f"n{draw.randrange(14)}", draw.choice("rs"), draw.choice("tu")) for _ in range(22)]
        rows += [*rows[:3], ("n0", "n0", "r", "t"), ("n0", "n14", "r", "t"), ("n14", "n15", "s", "t"), ("n15", "n14", "r", "u"), ("n1", None, "r", "t"), (None, "n2", "r", "t")]
        roots = ["n0", "n1", "n14", "gone"]
        want = []
        for root in roots:
            seen, frontier, level = {root}, {root}, 0
            while frontier and (depth is None or level < depth):
                level += 1
                step = {}
                for a, b, *rest in rows:
                    a, b = (a, b) if forward else (b, a)
                    if a in frontier and b not in seen:
                        step.setdefault(b, []).append((a, *rest))
                want += [(root, b, level, *min(via)) for b, via in step.items()]
                frontier = {b for b in step if b is not None}
                seen |= frontier
        edges = spark.createDataFrame(rows, "src string, dst string, relationship string, transformation string")
        got = lineage.reach(edges, roots, depth, forward).select("root", "node", "level", "parent", "relationship", "transformation")
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
