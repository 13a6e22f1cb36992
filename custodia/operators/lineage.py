"""Lineage over an edge table ``(src, dst, relationship, transformation)``.

Walks run level by level as equi-joins of the frontier with the edges. The edges are laid out once, in buckets by the
node that they leave (see ``session.lay_out``), so a level moves its frontier and nothing else; ``laid_out`` gives a
layout that several walks share. Each finished level is written to the shared folder (see ``session.materialize``),
which stops the plan from growing, tells Catalyst the real size of the frontier and lets the walk end as soon as a
level is empty. Nothing is collected. A depth of None walks until that happens: a node, or a node of a path, is
never expanded twice, so cycles end too. To know which nodes it has been to, ``reach`` remembers only those that more
than one edge leads to: no walk comes to another one twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import cached_property
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custodia.session import lay_out, materialize


def _levels(depth: int | None, first: int = 1) -> Iterable[int]:
    if depth is not None and depth < 1:
        raise ValueError("depth must be at least 1")
    return count(first) if depth is None else range(first, depth + 1)


def _roots(edges: DataFrame | LaidOut, roots: Sequence[str] | DataFrame) -> DataFrame:
    """One column ``root``: given as a list of URIs or as the first column of a DataFrame."""
    if isinstance(roots, DataFrame):
        return roots.select(F.col(roots.columns[0]).alias("root")).distinct()
    return laid_out(edges).edges.sparkSession.createDataFrame([(r,) for r in dict.fromkeys(roots)], "root string")


class LaidOut:
    """Edges laid out for walks; each direction when it is first walked."""

    def __init__(self, edges: DataFrame):
        self.edges = edges
        self.met_again: dict[str, int] = {}

    @cached_property
    def forward(self) -> DataFrame:
        return self._by("src", "dst")

    @cached_property
    def backward(self) -> DataFrame:
        return self._by("dst", "src")

    def _by(self, a: str, b: str) -> DataFrame:
        """(__from, __to, __again: does more than one edge lead there, the edges' other columns)."""
        rest = [c for c in self.edges.columns if c not in ("src", "dst")]
        hops = self.edges.where(F.col(a).isNotNull()).select(F.col(a).alias("__from"), F.col(b).alias("__to"), *rest)
        # by hash, which is shorter: where two nodes share one, both count as met again, and reach compares the nodes themselves
        meets, self.met_again[a] = materialize(hops.groupBy(F.xxhash64("__to").alias("__met")).count().where("count > 1").select("__met"), "meets")
        again = F.lit(False)
        if self.met_again[a]:
            hops, again = hops.join(meets, F.xxhash64("__to") == F.col("__met"), "left"), F.col("__met").isNotNull()
        return lay_out(hops.select("__from", "__to", again.alias("__again"), *rest), "__from", "edges")


def laid_out(edges: DataFrame | LaidOut) -> LaidOut:
    return edges if isinstance(edges, LaidOut) else LaidOut(edges)


def _hops(edges: DataFrame | LaidOut, forward: bool) -> DataFrame:
    """(__from, __to, __again, the edges' other columns), in buckets by __from."""
    return laid_out(edges).forward if forward else laid_out(edges).backward


def walk(edges: DataFrame | LaidOut, roots: Sequence[str] | DataFrame, depth: int | None = 3, forward: bool = True) -> DataFrame:
    """Every edge of every path from the roots, up to ``depth`` edges.

    One row per edge and path: an edge reached over two paths appears twice. A path never expands a node twice,
    but the edge that closes a cycle is still reported.
    """
    hops = _hops(edges, forward)
    frontier = _roots(edges, roots).select("root", F.col("root").alias("node"),
                                           F.array().cast("array<string>").alias("path"))
    levels: list[DataFrame] = []
    for level in _levels(depth):
        live = frontier.where(~F.array_contains("path", F.col("node")))
        found = live.join(hops, live["node"] == hops["__from"]).select(
            "root", F.lit(level).alias("level"), F.col("node").alias("parent"), F.col("__to").alias("node"),
            "relationship", "transformation", F.array_append("path", F.col("node")).alias("path"))
        if depth is None or level < depth:
            found, rows_found = materialize(found, "walk")
            if not rows_found:
                break
        levels.append(found)
        frontier = found.select("root", "node", "path")
    out = levels[0] if levels else found
    for part in levels[1:]:
        out = out.unionAll(part)
    return out


def reach(edges: DataFrame | LaidOut, roots: Sequence[str] | DataFrame, depth: int | None = 3, forward: bool = True) -> DataFrame:
    """Each reachable node once, at its first level, with the smallest edge that leads to it there."""
    edges = laid_out(edges)
    hops = _hops(edges, forward)
    frontier = _roots(edges, roots).select("root", F.col("root").alias("node"))
    seen = None  # of the nodes that more than one edge leads to
    levels: list[DataFrame] = []
    for level in _levels(depth):
        step = frontier.join(hops, frontier["node"] == hops["__from"]).where(~F.col("__to").eqNullSafe(F.col("root")))
        # a node is expanded once for a root, so its one edge leads there once
        found = step.where("NOT __again").select("root", F.col("__to").alias("node"), F.lit(level).alias("level"), F.col("node").alias("parent"), "relationship", "transformation", "__again")
        if edges.met_again["src" if forward else "dst"]:
            met = step.where("__again").groupBy("root", F.col("__to").alias("node")).agg(F.min(F.struct(F.col("node").alias("parent"), "relationship", "transformation")).alias("via"))
            if seen is not None:
                met = met.join(seen, ["root", "node"], "left_anti")
            found = found.unionAll(met.select("root", "node", F.lit(level).alias("level"), "via.*", F.lit(True).alias("__again")))
        if depth is None or level < depth:
            found, rows_found = materialize(found, "reach")
            if not rows_found:
                break
        levels.append(found.drop("__again"))
        frontier = found.select("root", "node")
        met = found.where("__again").select("root", "node")
        seen = met if seen is None else seen.unionAll(met)
    out = levels[0] if levels else found.drop("__again")
    for part in levels[1:]:
        out = out.unionAll(part)
    return out


def upstream(edges: DataFrame | LaidOut, roots, depth: int | None = 3, paths: bool = False) -> DataFrame:
    """Sources of the roots; ``paths`` keeps one row per path instead of one per node."""
    return walk(edges, roots, depth, forward=False) if paths else reach(edges, roots, depth, forward=False)


def downstream(edges: DataFrame | LaidOut, roots, depth: int | None = 3, paths: bool = False) -> DataFrame:
    return walk(edges, roots, depth) if paths else reach(edges, roots, depth)


def impact_analysis(edges: DataFrame | LaidOut, roots, depth: int | None = 3) -> DataFrame:
    return reach(edges, roots, depth)


def lineage(edges: DataFrame | LaidOut, roots, depth: int | None = 3) -> DataFrame:
    """Both directions: (root, node, direction, distance)."""
    edges = laid_out(edges)
    up = reach(edges, roots, depth, forward=False).select("root", "node", F.lit("upstream").alias("direction"),
                                                          F.col("level").alias("distance"))
    down = reach(edges, roots, depth).select("root", "node", F.lit("downstream").alias("direction"),
                                             F.col("level").alias("distance"))
    return up.unionAll(down)


def direct_upstream(edges: DataFrame, uri: str) -> DataFrame:
    return edges.where(F.col("dst") == uri).select(F.col("src").alias("uri"), "relationship", "transformation")


def direct_downstream(edges: DataFrame, uri: str) -> DataFrame:
    return edges.where(F.col("src") == uri).select(F.col("dst").alias("uri"), "relationship", "transformation")


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("uri")).unionAll(edges.select(F.col("dst").alias("uri"))).distinct()


def has_lineage(uris: DataFrame, edges: DataFrame) -> DataFrame:
    """The URIs that occur on either side of an edge."""
    return uris.join(nodes(edges), "uri", "left_semi")


def find_path(edges: DataFrame | LaidOut, src: str, dst: str, max_nodes: int | None = None) -> DataFrame:
    """Shortest downstream path (of at most ``max_nodes``) as an array of URIs, or no row. The smallest path wins among equals."""
    start = laid_out(edges).edges.sparkSession.createDataFrame([(src, [src])], "node string, path array<string>")
    if src == dst:
        return start.select("path")
    hops = _hops(edges, True)
    seen, frontier = start.select("node"), start
    for _ in _levels(max_nodes, 2):
        step = frontier.join(hops, frontier["node"] == hops["__from"])
        found = step.groupBy(F.col("__to").alias("node")).agg(
            F.min(F.array_append("path", F.col("__to"))).alias("path"))
        found, rows_found = materialize(found.join(seen, "node", "left_anti"), "path")
        hit = found.where(F.col("node") == dst)
        if not hit.isEmpty():
            return hit.select("path")
        if not rows_found:
            break
        frontier, seen = found, seen.unionAll(found.select("node"))
    return start.select("path").where(F.lit(False))


def domain_of(uri: Column) -> Column:
    return F.regexp_extract(uri, r"^catalog://([^.]+)\.", 1)


def strong_components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b) that lie on a cycle; the component is its largest node.

    Nodes without a link in or without one out lie on none and are peeled off. In the rest every node learns the
    largest node that leads to it; those that lead back to the node they learned form its component. What is found
    goes, and the rest starts anew. A self-link is a cycle.
    """
    left, n = materialize(links.select("a", "b").distinct(), "links")
    found = left.select(F.col("a").alias("node"), F.col("a").alias("component")).limit(0)
    while n:
        before = None
        while n and n != before:
            before = n
            left, n = materialize(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
                                  .join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"), "links")
        if not n:
            break
        color = left.select(F.col("a").alias("node"), F.col("a").alias("color")).distinct()
        moved = 1
        while moved:
            told = left.join(color, left["a"] == color["node"]).groupBy(F.col("b").alias("node")).agg(F.max("color").alias("told"))
            color, _ = materialize(color.join(told, "node").select("node", F.greatest("color", "told").alias("color"), (F.col("told") > F.col("color")).alias("moved")), "colors")
            moved = color.where("moved").limit(1).count()
            color = color.select("node", "color")
        inner = left.join(color.select(F.col("node").alias("a"), F.col("color").alias("c")), "a").join(color.select(F.col("node").alias("b"), F.col("color").alias("d")), "b").where("c = d")
        inner, _ = materialize(inner.select("a", "b", "c"), "links")
        back, size = materialize(color.where("node = color").select("node", F.col("color").alias("component")), "component")
        edge = back
        while size:
            step = inner.join(edge.withColumnRenamed("node", "b"), "b").where("c = component").select(F.col("a").alias("node"), "component").distinct()
            edge, size = materialize(step.join(back, ["node", "component"], "left_anti"), "component")
            back = back.unionByName(edge)
        back, _ = materialize(back, "component")
        # a color's root that nothing of its color leads to and that has no self-link is on no cycle
        cyclic = back.join(inner.where("a = b").select(F.col("a").alias("node")).union(
            back.groupBy("component").count().where("count > 1").join(back, "component").select("node")).distinct(), "node", "left_semi")
        found = found.unionByName(cyclic.select("node", "component"))
        gone = back.select("node")
        left, n = materialize(left.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "links")
    return materialize(found, "components")[0]


def longest_path(edges: DataFrame | LaidOut, root: str, depth: int | None = None, near: DataFrame | None = None) -> DataFrame:
    """One row, ``path``: the longest downstream path from ``root`` of up to ``depth`` edges (null without any), as ``walk`` would list it.

    A path never expands a node twice, but may end in one of its own. Of equally long paths the smallest wins.
    ``near`` is ``reach`` of the root, if that is known already. Paths are not listed: all that matters of a path for
    its continuations is where it stands and which nodes of that node's strongly connected component it has been to,
    so a level keeps the smallest path of each such state. Without cycles that is one path per node and level.
    """
    hops = _hops(edges, True)
    start = _roots(edges, [root]).select(F.col("root").alias("node"))
    near = reach(edges, [root], depth) if near is None else near
    reached = near.select("node", "level").unionByName(start.select("node", F.lit(0).alias("level")))
    open_ = reached if depth is None else reached.where(F.col("level") < depth)
    links = open_.join(hops, open_["node"] == hops["__from"]).select(F.col("node").alias("a"), F.col("__to").alias("b"))
    cycles = strong_components(links)
    member, other = (cycles.select(F.col("node").alias(n), F.col("component").alias(c)) for n, c in (("a", "ca"), ("b", "cb")))
    links = links.distinct().join(member, "a", "left").join(other, "b", "left").select("a", "b", F.coalesce(F.col("ca") == F.col("cb"), F.col("a") == F.col("b")).alias("inside"))
    links = lay_out(links, "a", "links")
    frontier = start.select("node", F.array("node").alias("been"), F.array("node").alias("path"))
    last = None
    for _ in _levels(depth):
        step = frontier.join(links, frontier["node"] == links["a"]).select(
            F.col("b").alias("node"), F.when(F.col("inside"), F.array_sort(F.array_union("been", F.array("b")))).otherwise(F.array("b")).alias("been"),
            (F.col("inside") & F.array_contains("been", F.col("b"))).alias("closed"), F.array_append("path", F.col("b")).alias("path"))
        found, n = materialize(step.groupBy("node", "been", "closed").agg(F.min("path").alias("path")), "longest")
        if not n:
            break
        last, frontier = found, found.where("NOT closed").drop("closed")
    return (frontier.limit(0) if last is None else last).agg(F.min("path").alias("path"))


def lineage_summary(edges: DataFrame | LaidOut, root: str, depth: int | None = 3) -> DataFrame:
    """Totals and depth per direction, domains touched and the longest downstream path."""
    edges = laid_out(edges)
    up, down = (reach(edges, [root], depth, forward=f) for f in (False, True))
    down, _ = materialize(down, "downstream")
    near = up.select("node", F.lit("upstream").alias("direction"), F.col("level").alias("distance")).unionAll(
        down.select("node", F.lit("downstream").alias("direction"), F.col("level").alias("distance")))
    totals = near.agg(
        F.count_if(F.col("direction") == "upstream").alias("upstream_nodes"),
        F.count_if(F.col("direction") == "downstream").alias("downstream_nodes"),
        F.coalesce(F.max(F.when(F.col("direction") == "upstream", F.col("distance"))), F.lit(0)).alias("upstream_depth"),
        F.coalesce(F.max(F.when(F.col("direction") == "downstream", F.col("distance"))), F.lit(0)).alias("downstream_depth"),
        F.array_sort(F.collect_set(domain_of(F.col("node")))).alias("domains"))
    return totals.withColumn("critical_path", longest_path(edges, root, depth, down).scalar())


def lineage_graph(edges: DataFrame | LaidOut, root: str, depth: int | None = 3) -> tuple[DataFrame, DataFrame]:
    """Node table (uri, direction, distance, is_root) and the edges between those nodes."""
    laid = laid_out(edges)
    edges, near = laid.edges, lineage(laid, [root], depth)
    start = edges.sparkSession.createDataFrame([(root, "root", 0)], "uri string, direction string, distance int")
    table = start.unionAll(near.select(F.col("node").alias("uri"), "direction", "distance"))
    table = table.withColumn("is_root", F.col("uri") == root)
    member = table.select("uri").distinct()
    inner = (edges.join(member, edges["src"] == member["uri"], "left_semi")
             .join(member, edges["dst"] == member["uri"], "left_semi"))
    return table, inner


def column_key(dataset: Column, column: Column) -> Column:
    return F.concat_ws("#", dataset, column)


def column_lineage(col_edges: DataFrame, target_dataset: str, target_column: str, depth: int | None = 3) -> DataFrame:
    """Source columns of one column, nearest first, with the transformation of the edge used."""
    edges = col_edges.select(
        column_key(F.col("source_dataset"), F.col("source_column")).alias("src"),
        column_key(F.col("target_dataset"), F.col("target_column")).alias("dst"),
        F.lit("column").alias("relationship"), "transformation")
    found = reach(edges, [f"{target_dataset}#{target_column}"], depth, forward=False)
    return found.select(F.substring_index("node", "#", 1).alias("source_dataset"),
                        F.substring_index("node", "#", -1).alias("source_column"), "level", "transformation")


def lineage_as_of(edges: DataFrame, ts: Column) -> DataFrame:
    """Edges valid at ``ts``: valid_from <= ts < valid_to, an open end never expires."""
    return edges.where((F.col("valid_from") <= ts) & (F.col("valid_to").isNull() | (F.col("valid_to") > ts)))


def reach_over_time(edges: DataFrame | LaidOut, roots: Sequence[str] | DataFrame, forward: bool = True) -> DataFrame:
    """(root, node, valid_from, valid_to): when each node is reachable from a root, for all dates in one walk.

    A node is reachable at a date if some path leads to it whose edges are all valid then: intervals are
    intersected along paths, and those of a node merged into as few as there are. Only intervals that are new or
    have grown are walked on, so cycles end. ``lineage_as_of`` of the result are the nodes that ``reach`` finds over
    the edges as of that date. Edges without a start, or that end when they start, are never valid.
    """
    hops = _hops(edges, forward).where("valid_from < valid_to OR (valid_from IS NOT NULL AND valid_to IS NULL)")
    dates = dict(hops.dtypes)["valid_from"]
    always = F.lit(None).cast(dates)
    seen = _roots(edges, roots).select("root", F.col("root").alias("node"), always.alias("since"), always.alias("till"))  # no start: ever
    frontier = seen
    order = Window.partitionBy("root", "node").orderBy(F.asc_nulls_first("since"))
    while True:
        found = frontier.join(hops, frontier["node"] == hops["__from"]).select(
            "root", F.col("__to").alias("node"), F.greatest("since", "valid_from").alias("since"), F.least("till", "valid_to").alias("till")
        ).where("till IS NULL OR since < till").distinct()
        # a null end is after all others: compared by (is open, end)
        end = F.max(F.struct(F.col("till").isNull().alias("open"), "till"))
        rows = seen.unionByName(found).withColumn("before", end.over(order.rowsBetween(Window.unboundedPreceding, -1)))
        starts = F.col("before").isNull() | (~F.col("before.open") & (F.col("before.till") < F.col("since")))
        islands = rows.withColumn("island", F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("root", "node", "island").agg(
            F.min(F.struct(F.col("since").isNotNull().alias("bounded"), "since")).alias("s"), end.alias("e")).select("root", "node", "s.since", "e.till")
        islands, _ = materialize(islands, "islands")
        frontier, n = materialize(islands.subtract(seen), "islands")
        seen = islands
        if not n:
            return seen.where("node <> root").select("root", "node", F.col("since").alias("valid_from"), F.col("till").alias("valid_to"))


def lineage_hints(tables: DataFrame) -> DataFrame:
    """Edges named in table parameters plus the storage tier read from the location (first hit wins)."""
    where = F.lower("location")
    tier = F.when(where.contains("raw"), "raw").when(where.contains("processed"), "processed").when(
        where.contains("curated"), "curated")

    def listed(column: str, direction: str) -> Column:
        pairs = F.transform(F.split(F.col(column), ","),
                            lambda x: F.struct(F.lit(direction).alias("direction"), x.alias("related")))
        return F.coalesce(pairs, F.array().cast("array<struct<direction:string,related:string>>"))

    hinted = F.concat(listed("source_tables", "upstream"), listed("downstream_tables", "downstream"))
    return tables.select("table_name", tier.alias("tier"), F.explode_outer(hinted).alias("h")).select(
        "table_name", "tier", "h.direction", "h.related")


def lineage_for_tables(edges: DataFrame, tables: Sequence[str] | DataFrame) -> DataFrame:
    """Distinct direct sources and targets of a set of tables."""
    wanted = _roots(edges, tables)
    up = edges.join(wanted, edges["dst"] == wanted["root"], "left_semi").select(F.lit("upstream").alias("direction"), F.col("src").alias("uri"))
    down = edges.join(wanted, edges["src"] == wanted["root"], "left_semi").select(F.lit("downstream").alias("direction"), F.col("dst").alias("uri"))
    return up.unionAll(down).distinct()


def lineage_from_metastore(rows: DataFrame) -> DataFrame:
    """Edges from metastore rows (table_name, upstream_source, downstream_target)."""
    up = rows.where("upstream_source IS NOT NULL").select(F.col("upstream_source").alias("src"), F.col("table_name").alias("dst"))
    down = rows.where("downstream_target IS NOT NULL").select(F.col("table_name").alias("src"), F.col("downstream_target").alias("dst"))
    return up.unionAll(down).withColumn("relationship", F.lit("metastore")).withColumn("transformation", F.lit(None).cast("string"))


def lineage_consistency(up: DataFrame, down: DataFrame) -> DataFrame:
    """Edges stated in one direction only (multiset difference both ways)."""
    a, b = up.select("src", "dst"), down.select("src", "dst")
    return (a.exceptAll(b).withColumn("missing_in", F.lit("downstream"))
            .unionAll(b.exceptAll(a).withColumn("missing_in", F.lit("upstream"))))
