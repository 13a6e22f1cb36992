"""Call traces as trees of spans ``(trace_id, span_id, parent_span_id, duration_ms)``.

Depths and path lengths are found by pointer jumping: every span keeps a pointer to an ancestor, the number of spans
before it and their summed duration, and each round replaces the pointer by that ancestor's own. Distances double,
so the rounds grow with the logarithm of the deepest trace, whatever its shape. A span whose pointer is still open
when the distance exceeds its trace's size hangs on a cycle. Paths are rebuilt for the slowest spans alone, by the
same pointers: the ancestors within 2^(k+1) are those within 2^k and the 2^k-th ancestors of these.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from custodia.session import materialize, scratch_path

KEY = ["trace_id", "span_id"]


def _unique(spans: DataFrame) -> DataFrame:
    """One row per span: its parent (none, else the smallest, where rows of one id disagree), the slowest duration of its
    rows with that parent, their number, and how many rows have another parent."""
    rows = spans.where("trace_id IS NOT NULL AND span_id IS NOT NULL").groupBy(*KEY, F.col("parent_span_id").alias("parent")).agg(
        F.max("duration_ms").alias("ms"), F.count(F.lit(1)).alias("times"))
    row = F.struct(F.col("parent").isNotNull().alias("below"), "parent", "ms", "times")
    return rows.groupBy(*KEY).agg(F.min(row).alias("row"), F.sum("times").alias("all")).select(
        *KEY, "row.parent", "row.ms", "row.times", (F.col("all") - F.col("row.times")).alias("repeats"))


def _write(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` written to the shared folder, and how many of its pointers are open."""
    spark, seen, path = df.sparkSession, Observation(), scratch_path(df.sparkSession, "pointers")
    df.observe(seen, F.count_if(F.col("up").isNotNull()).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), seen.get["n"]


def pointers(spans: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Every span's place, and the pointers of each round.

    Places: trace_id, span_id, ms, repeats, depth, total_ms and calls (counted from where the chain of parents ends, the
    span included; calls is the product of the rows of each span), end: ``root``, ``missing`` (a parent that is no span of the trace) or ``cycle``. The k-th pointers
    (trace_id, span_id, up) lead to the 2^k-th ancestor, null where there is none.
    """
    nodes, _ = materialize(_unique(spans), "spans")
    largest = nodes.groupBy("trace_id").count().agg(F.max("count")).first()[0] or 0
    parents = nodes.select("trace_id", F.col("span_id").alias("parent"), F.lit(True).alias("there"))
    at = nodes.join(parents, ["trace_id", "parent"], "left").select(
        *KEY, "ms", "repeats", F.lit(1).alias("depth"), F.col("ms").alias("total_ms"), F.col("times").cast("double").alias("calls"), F.when(F.col("there"), F.col("parent")).alias("up"),
        F.when(F.col("parent").isNull(), "root").when(F.col("there").isNull(), "missing").alias("end"))
    at, going = _write(at)
    rounds, reach = [at.select(*KEY, "up")], 1
    while going and reach <= largest:
        above = at.select("trace_id", F.col("span_id").alias("up"), F.col("depth").alias("d"), F.col("total_ms").alias("t"), F.col("calls").alias("c"), F.col("up").alias("u"), F.col("end").alias("e"))
        moved = at.where("up IS NOT NULL").join(above, ["trace_id", "up"]).select(
            *KEY, "ms", "repeats", (F.col("depth") + F.col("d")).alias("depth"), (F.col("total_ms") + F.col("t")).alias("total_ms"),
            (F.col("calls") * F.col("c")).alias("calls"), F.col("u").alias("up"), F.col("e").alias("end"))
        at, going = _write(at.where("up IS NULL").unionByName(moved))
        rounds.append(at.select(*KEY, "up"))
        reach *= 2
    places = at.select(*KEY, "ms", "repeats", "depth", "total_ms", "calls", F.coalesce("end", F.lit("cycle")).alias("end"))
    return places, rounds


def paths(leaves: DataFrame, places: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(trace_id, span_id, path): the ids from the root down to each of ``leaves`` (trace_id, span_id), which must hang on a root."""
    found = leaves.select("trace_id", F.col("span_id").alias("leaf"), "span_id")
    for step in rounds:
        above = found.join(step.where("up IS NOT NULL"), KEY).select("trace_id", "leaf", F.col("up").alias("span_id"))
        found, _ = materialize(found.union(above), "paths")
    steps = found.join(places.select(*KEY, "depth"), KEY).groupBy("trace_id", "leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "span_id"))).alias("p"))
    return steps.select("trace_id", F.col("leaf").alias("span_id"), F.col("p.span_id").alias("path"))


def trace_tree(spans: DataFrame, max_depth: int | None = None) -> DataFrame:
    """One row per trace: spans reached from its roots, depth, the slowest path from a root, and what hangs on none.

    trace_id, reached, depth, critical_ms, critical_path, truncated (``max_depth`` cut deeper spans off), orphaned
    (spans whose chain of parents ends at one that is missing), cyclic (whose chain never ends), repeated (rows of
    a span id that name another parent; only the rows without one, else with the smallest, count). Rows that agree on
    id and parent are calls of their own, each with all that lies below: ``reached`` counts paths, the slowest call
    makes the critical one. A trace without a root has 0 reached, depth 0 and no path. Of equally slow paths the
    longer, then the greater, is critical; a path with an unknown duration is the fastest of all. Rows without trace
    or span id are ignored.
    """
    if max_depth is not None and max_depth < 1:
        raise ValueError("depth must be at least 1")
    places, rounds = pointers(spans)
    rooted = F.col("end") == "root"
    near = rooted if max_depth is None else rooted & (F.col("depth") <= max_depth)
    totals = places.groupBy("trace_id").agg(
        F.least(F.sum(F.when(near, F.col("calls")).otherwise(0.0)), F.lit(2.0 ** 62)).cast("long").alias("reached"), F.coalesce(F.max(F.when(near, F.col("depth"))), F.lit(0)).alias("depth"),
        F.max(F.when(near, F.struct("total_ms", F.col("depth").alias("n")))).alias("best"),
        (F.count_if(rooted) > F.count_if(near)).alias("truncated"), F.count_if(F.col("end") == "missing").alias("orphaned"),
        F.count_if(F.col("end") == "cycle").alias("cyclic"), F.sum("repeats").alias("repeated"))
    totals, _ = materialize(totals, "traces")
    slowest = places.where(near).join(totals.select("trace_id", "best"), "trace_id").where(
        F.col("total_ms").eqNullSafe(F.col("best.total_ms")) & (F.col("depth") == F.col("best.n")))
    # of equally slow spans of one parent the greatest id has the greatest path
    slowest = slowest.join(rounds[0], KEY).groupBy("trace_id", "up").agg(F.max("span_id").alias("span_id")).select(*KEY)
    slowest, _ = materialize(slowest, "slowest")
    path = paths(slowest, places, rounds).groupBy("trace_id").agg(F.max("path").alias("critical_path"))
    return totals.join(path, "trace_id", "left").select(
        "trace_id", "reached", "depth", F.col("best.total_ms").alias("critical_ms"),
        F.coalesce("critical_path", F.array().cast(path.schema["critical_path"].dataType)).alias("critical_path"), "truncated", "orphaned", "cyclic", "repeated")


def subtree_totals(spans: DataFrame) -> DataFrame:
    """(trace_id, span_id, spans, total_ms, self_ms): of each rooted span the spans below it, itself included, their summed duration, and what its children leave of its own.

    A span whose rows repeat counts once, by its slowest. Every span adds itself to all its ancestors, found by doubling: a round hands the sums of the spans within
    2^k below to the 2^k-th ancestor, so that sums are combined before each shuffle.
    """
    places, rounds = pointers(spans)
    sums = places.where("end = 'root'").select(*KEY, F.lit(1).cast("long").alias("spans"), F.coalesce(F.col("ms").cast("long"), F.lit(0)).alias("total_ms"))
    for step in rounds:
        handed = sums.join(step.where("up IS NOT NULL"), KEY).select("trace_id", F.col("up").alias("span_id"), "spans", "total_ms")
        sums, _ = materialize(sums.union(handed).groupBy(*KEY).agg(F.sum("spans").alias("spans"), F.sum("total_ms").alias("total_ms")), "subtrees")
    children = places.join(rounds[0], KEY).where("up IS NOT NULL").groupBy("trace_id", F.col("up").alias("span_id")).agg(F.sum("ms").alias("below"))
    return sums.join(places.select(*KEY, "ms"), KEY).join(children, KEY, "left").select(
        *KEY, "spans", "total_ms", F.greatest(F.lit(0), F.col("ms") - F.coalesce("below", F.lit(0))).cast("long").alias("self_ms"))
