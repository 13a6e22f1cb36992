"""Lineage walks over a five-level graph with cycles, started from one region."""

from pyspark.sql import functions as F

from checks.registry import check
from custodia.operators import lineage as ln
from custodia.operators import traces

E, ROOT = "lineage_edges", "catalog://region.r0"
LEAF = "catalog://order.o77"


def _paths(fwd=True, depth=3, root=ROOT):
    a, b = ("src", "dst") if fwd else ("dst", "src")
    return f"""w AS (
 SELECT 1 AS level, {a} AS parent, {b} AS node, relationship, transformation, [{a}] AS path FROM lineage_edges WHERE {a} = '{root}'
 UNION ALL SELECT level + 1, e.{a}, e.{b}, e.relationship, e.transformation, list_append(w.path, w.node) FROM w JOIN lineage_edges e ON e.{a} = w.node
  WHERE level < {depth} AND NOT list_contains(w.path, w.node))"""


def _first(fwd=True, depth=3, root=ROOT):
    return f"{_paths(fwd, depth, root)}, r AS (SELECT node, MIN(level) AS level FROM w WHERE node <> '{root}' GROUP BY node)"




@check("n1_upstream_paths", f"WITH RECURSIVE {_paths(False, 4, LEAF)} SELECT level, parent, node, relationship, transformation, array_to_string(path, ' > ') AS path FROM w", E)
def _(t):
    return ln.upstream(t.lineage_edges, [LEAF], 4, paths=True).drop("root").withColumn("path", F.array_join("path", " > "))


@check("n2_downstream_paths", f"WITH RECURSIVE {_paths()} SELECT level, parent, node, relationship, transformation, array_to_string(path, ' > ') AS path FROM w", E)
def _(t):
    return ln.downstream(t.lineage_edges, [ROOT], 3, paths=True).drop("root").withColumn("path", F.array_join("path", " > "))


@check("n3_lineage", f"""WITH RECURSIVE {_paths(True, 3, 'catalog://nation.n3')}, u AS (
 SELECT 1 AS level, src AS node FROM lineage_edges WHERE dst = 'catalog://nation.n3'
 UNION SELECT level + 1, e.src FROM u JOIN lineage_edges e ON e.dst = u.node WHERE level < 3)
 SELECT node, 'downstream' AS direction, MIN(level) AS distance FROM w WHERE node <> 'catalog://nation.n3' GROUP BY node
 UNION ALL SELECT node, 'upstream', MIN(level) FROM u WHERE node <> 'catalog://nation.n3' GROUP BY node""", E)
def _(t):
    return ln.lineage(t.lineage_edges, ["catalog://nation.n3"], 3).drop("root")


@check("n4_direct_downstream", "SELECT dst AS uri, relationship, transformation FROM lineage_edges WHERE src = 'catalog://nation.n5'", E)
def _(t):
    return ln.direct_downstream(t.lineage_edges, "catalog://nation.n5")


@check("n4_direct_upstream", "SELECT src AS uri, relationship, transformation FROM lineage_edges WHERE dst = 'catalog://order.o5'", E)
def _(t):
    return ln.direct_upstream(t.lineage_edges, "catalog://order.o5")


@check("n5_has_lineage", "WITH u AS (SELECT DISTINCT concat('catalog://customer.c', CAST(p_partkey AS VARCHAR)) AS uri FROM part) SELECT uri FROM u WHERE uri IN (SELECT src FROM lineage_edges UNION SELECT dst FROM lineage_edges)", E)
def _(t):
    uris = t.part.select(F.concat(F.lit("catalog://customer.c"), F.col("p_partkey").cast("string")).alias("uri"))
    return ln.has_lineage(uris, t.lineage_edges)


def _path_sql(src, dst):
    return f"""WITH RECURSIVE p AS (SELECT src AS start, dst AS node, [src, dst] AS path FROM lineage_edges WHERE src = '{src}'
 UNION ALL SELECT start, e.dst, list_append(path, e.dst) FROM p JOIN lineage_edges e ON e.src = p.node WHERE len(path) < 6 AND NOT list_contains(path, e.dst))
 SELECT array_to_string(path, ' > ') AS path FROM p WHERE node = '{dst}' ORDER BY len(path), p.path LIMIT 1"""


@check("n6_find_path", _path_sql(ROOT, "catalog://order.o45"), E)
def _(t):
    return ln.find_path(t.lineage_edges, ROOT, "catalog://order.o45").select(F.array_join("path", " > ").alias("path"))


@check("n7_impact_analysis", f"WITH RECURSIVE {_first()} SELECT node, level FROM r", E)
def _(t):
    return ln.impact_analysis(t.lineage_edges, [ROOT], 3).select("node", "level")


@check("n8_lineage_summary", f"""WITH RECURSIVE {_first()}, u AS (
 SELECT 1 AS level, src AS node FROM lineage_edges WHERE dst = '{ROOT}'
 UNION SELECT level + 1, e.src FROM u JOIN lineage_edges e ON e.dst = u.node WHERE level < 3),
 ur AS (SELECT node, MIN(level) AS level FROM u WHERE node <> '{ROOT}' GROUP BY node),
 best AS (SELECT list_append(path, node) AS p FROM w ORDER BY -len(list_append(path, node)), list_append(path, node) LIMIT 1)
 SELECT (SELECT COUNT(*) FROM ur) AS upstream_nodes, (SELECT COUNT(*) FROM r) AS downstream_nodes, (SELECT COALESCE(MAX(level), 0) FROM ur) AS upstream_depth,
 (SELECT COALESCE(MAX(level), 0) FROM r) AS downstream_depth,
 (SELECT string_agg(d, ',' ORDER BY d) FROM (SELECT DISTINCT regexp_extract(node, '^catalog://([^.]+)[.]', 1) AS d FROM (SELECT node FROM r UNION ALL SELECT node FROM ur))) AS domains,
 (SELECT array_to_string(p, ' > ') FROM best) AS critical_path""", E)
def _(t):
    out = ln.lineage_summary(t.lineage_edges, ROOT, 3)
    return out.withColumn("domains", F.array_join("domains", ",")).withColumn("critical_path", F.array_join("critical_path", " > "))


@check("n9_lineage_graph_nodes", f"""WITH RECURSIVE {_paths(True, 2, 'catalog://supplier.s25')}, u AS (
 SELECT 1 AS level, src AS node FROM lineage_edges WHERE dst = 'catalog://supplier.s25'
 UNION SELECT level + 1, e.src FROM u JOIN lineage_edges e ON e.dst = u.node WHERE level < 2)
 SELECT 'catalog://supplier.s25' AS uri, 'root' AS direction, 0 AS distance, true AS is_root
 UNION ALL SELECT node, 'downstream', MIN(level), false FROM w WHERE node <> 'catalog://supplier.s25' GROUP BY node
 UNION ALL SELECT node, 'upstream', MIN(level), false FROM u WHERE node <> 'catalog://supplier.s25' GROUP BY node""", E)
def _(t):
    return ln.lineage_graph(t.lineage_edges, "catalog://supplier.s25", 2)[0]


@check("n9_lineage_graph_edges", f"""WITH RECURSIVE {_paths(True, 2, 'catalog://supplier.s25')}, u AS (
 SELECT 1 AS level, src AS node FROM lineage_edges WHERE dst = 'catalog://supplier.s25'
 UNION SELECT level + 1, e.src FROM u JOIN lineage_edges e ON e.dst = u.node WHERE level < 2),
 m AS (SELECT node FROM w UNION SELECT node FROM u UNION SELECT 'catalog://supplier.s25')
 SELECT src, dst, relationship FROM lineage_edges WHERE src IN (SELECT node FROM m) AND dst IN (SELECT node FROM m)""", E)
def _(t):
    return ln.lineage_graph(t.lineage_edges, "catalog://supplier.s25", 2)[1].select("src", "dst", "relationship")


@check("n10_column_lineage", """WITH a AS (SELECT source_dataset AS d, source_column AS c, MIN(transformation) AS tr FROM column_edges WHERE target_dataset = 'mart.t3' AND target_column = 'c2' GROUP BY ALL),
 b AS (SELECT e.source_dataset AS d, e.source_column AS c, MIN(e.transformation) AS tr FROM a JOIN column_edges e ON e.target_dataset = a.d AND e.target_column = a.c GROUP BY ALL)
 SELECT d AS source_dataset, c AS source_column, 1 AS level, tr AS transformation FROM a
 UNION ALL SELECT d, c, 2, tr FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.d = b.d AND a.c = b.c)""", "column_edges")
def _(t):
    return ln.column_lineage(t.column_edges, "mart.t3", "c2", 3)


@check("n11_lineage_as_of", "SELECT src, dst FROM versioned_edges WHERE valid_from <= TIMESTAMP '1998-06-01' AND (valid_to IS NULL OR valid_to > TIMESTAMP '1998-06-01')", "versioned_edges")
def _(t):
    return ln.lineage_as_of(t.versioned_edges, F.expr("TIMESTAMP_NTZ '1998-06-01 00:00:00'")).select("src", "dst")


@check("n11_reach_over_time", """WITH RECURSIVE e AS (SELECT src, dst, valid_from AS f, coalesce(valid_to, DATE '9999-12-31') AS t FROM temporal_edges WHERE valid_to IS NULL OR valid_from < valid_to),
 w AS (SELECT dst AS node, f, t FROM e WHERE src = 'region.r1'
  UNION SELECT e.dst, greatest(w.f, e.f), least(w.t, e.t) FROM w JOIN e ON e.src = w.node WHERE greatest(w.f, e.f) < least(w.t, e.t)),
 b AS (SELECT *, max(t) OVER (PARTITION BY node ORDER BY f, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM w WHERE node <> 'region.r1'),
 i AS (SELECT *, sum(CASE WHEN before IS NULL OR before < f THEN 1 ELSE 0 END) OVER (PARTITION BY node ORDER BY f, t ROWS UNBOUNDED PRECEDING) AS island FROM b)
 SELECT node, min(f) AS valid_from, CASE WHEN max(t) < DATE '9999-12-31' THEN max(t) END AS valid_to FROM i GROUP BY node, island""", "temporal_edges")
def _(t):
    return ln.reach_over_time(t.temporal_edges, ["region.r1"]).drop("root")


@check("n12_lineage_hints", """WITH x AS (SELECT table_name, table_id, CASE WHEN lower(location) LIKE '%raw%' THEN 'raw' WHEN lower(location) LIKE '%processed%' THEN 'processed' WHEN lower(location) LIKE '%curated%' THEN 'curated' END AS tier, source_tables, downstream_tables FROM catalog_tables),
 h AS (SELECT table_id, 'upstream' AS direction, unnest(string_split(source_tables, ',')) AS related FROM x WHERE source_tables IS NOT NULL
  UNION ALL SELECT table_id, 'downstream', unnest(string_split(downstream_tables, ',')) FROM x WHERE downstream_tables IS NOT NULL)
 SELECT table_name, tier, direction, related FROM x LEFT JOIN h USING (table_id)""", "catalog_tables")
def _(t):
    return ln.lineage_hints(t.catalog_tables)


@check("n13_lineage_for_tables", """WITH x AS (SELECT DISTINCT concat('catalog://customer.c', CAST(s_suppkey AS VARCHAR)) AS u FROM supplier)
 SELECT DISTINCT 'upstream' AS direction, src AS uri FROM lineage_edges WHERE dst IN (SELECT u FROM x)
 UNION ALL SELECT DISTINCT 'downstream', dst FROM lineage_edges WHERE src IN (SELECT u FROM x)""", E)
def _(t):
    return ln.lineage_for_tables(t.lineage_edges, t.supplier.selectExpr("concat('catalog://customer.c', CAST(s_suppkey AS STRING)) AS uri"))


@check("n14_lineage_from_metastore", """SELECT source_tables AS src, table_name AS dst, 'metastore' AS relationship FROM catalog_tables WHERE source_tables IS NOT NULL
 UNION ALL SELECT table_name, downstream_tables, 'metastore' FROM catalog_tables WHERE downstream_tables IS NOT NULL""", "catalog_tables")
def _(t):
    rows = t.catalog_tables.selectExpr("table_name", "source_tables AS upstream_source", "downstream_tables AS downstream_target")
    return ln.lineage_from_metastore(rows).drop("transformation")


@check("n15_lineage_consistency", """WITH a AS (SELECT src, dst FROM lineage_edges WHERE relationship <> 'union'), b AS (SELECT src, dst FROM lineage_edges WHERE NOT (src LIKE '%customer%' AND dst LIKE '%0'))
 SELECT *, 'downstream' AS missing_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT *, 'upstream' FROM (FROM b EXCEPT ALL FROM a)""", E)
def _(t):
    e = t.lineage_edges
    return ln.lineage_consistency(e.where("relationship <> 'union'"), e.where("NOT (src LIKE '%customer%' AND dst LIKE '%0')"))


@check("t12_trace_tree", """WITH RECURSIVE w AS (SELECT trace_id, span_id, 1 AS depth, [span_id] AS path, duration_ms AS total FROM spans WHERE parent_span_id IS NULL
 UNION ALL SELECT s.trace_id, s.span_id, depth + 1, list_append(path, s.span_id), total + s.duration_ms FROM w JOIN spans s ON s.trace_id = w.trace_id AND s.parent_span_id = w.span_id WHERE depth < 5),
 k AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY total DESC, len(path) DESC, path DESC) AS rn, COUNT(*) OVER (PARTITION BY trace_id) AS reached, MAX(depth) OVER (PARTITION BY trace_id) AS d FROM w)
 SELECT trace_id, reached, d AS depth, total AS critical_ms, array_to_string(path, '>') AS critical_path FROM k WHERE rn = 1""", "spans")
def _(t):
    return traces.trace_tree(t.spans, 5).where("reached > 0").withColumn("critical_path", F.array_join("critical_path", ">")).drop("truncated", "orphaned", "cyclic", "repeated")


# every order of a customer is called by the one before: chains as long as a customer's history. The first order of some
# customers is called by their last one (a cycle), of others by an order that nobody placed; some ids come twice.
_ORDER_SPANS = """o AS (SELECT o_custkey AS trace_id, o_orderkey AS span_id, CAST(o_orderkey % 1000 AS BIGINT) AS duration_ms,
  lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, max(o_orderkey) OVER (PARTITION BY o_custkey) AS top,
  last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS final FROM orders),
 order_spans AS (SELECT trace_id, span_id, coalesce(before, CASE WHEN trace_id % 5 = 1 THEN final WHEN trace_id % 5 = 2 THEN -1 END) AS parent_span_id, duration_ms FROM o
  UNION ALL SELECT trace_id, span_id, top, duration_ms FROM o WHERE trace_id % 5 = 3 AND span_id % 4 = 0 AND before IS NULL)"""


def _order_spans(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(f"WITH {_ORDER_SPANS} SELECT * FROM order_spans")


_CHAIN_SQL = f"""WITH RECURSIVE {_ORDER_SPANS}, k AS (SELECT *, trace_id % 5 = 3 AND span_id % 4 = 0 AND before IS NULL AS twice, trace_id % 5 IN (1, 2) AS loose FROM o),
 n AS (SELECT trace_id, span_id, duration_ms, twice, loose, (SELECT COUNT(*) FROM orders x JOIN orders y ON y.o_orderkey = k.span_id
   WHERE x.o_custkey = k.trace_id AND (x.o_orderdate, x.o_orderkey) <= (y.o_orderdate, y.o_orderkey)) AS place FROM k)"""


@check("t12_trace_tree_deep", f"""{_CHAIN_SQL}
 SELECT trace_id, CASE WHEN loose THEN 0 ELSE COUNT(*) END AS reached, CAST(CASE WHEN loose THEN 0 ELSE COUNT(*) END AS INT) AS depth,
  CAST(CASE WHEN NOT loose THEN SUM(duration_ms) END AS BIGINT) AS critical_ms,
  CASE WHEN loose THEN '' ELSE string_agg(CAST(span_id AS VARCHAR), '>' ORDER BY place) END AS critical_path, false AS truncated,
  CASE WHEN trace_id % 5 = 2 THEN COUNT(*) ELSE 0 END AS orphaned, CASE WHEN trace_id % 5 = 1 THEN COUNT(*) ELSE 0 END AS cyclic,
  CAST(COUNT(*) FILTER (WHERE twice) AS BIGINT) AS repeated FROM n GROUP BY trace_id, loose""")
def _(t):
    return traces.trace_tree(_order_spans(t)).withColumn("critical_path", F.array_join("critical_path", ">"))


@check("t12_trace_tree_cut", f"""{_CHAIN_SQL}
 SELECT trace_id, COUNT(*) FILTER (WHERE place <= 7) AS reached, CAST(least(COUNT(*), 7) AS INT) AS depth, COUNT(*) > 7 AS truncated,
  CAST(SUM(duration_ms) FILTER (WHERE place <= 7) AS BIGINT) AS critical_ms FROM n WHERE NOT loose GROUP BY trace_id""")
def _(t):
    return traces.trace_tree(_order_spans(t), 7).where("reached > 0").select("trace_id", "reached", "depth", "truncated", "critical_ms")


@check("t12_subtree_totals", """WITH RECURSIVE u AS (SELECT trace_id, span_id, parent_span_id, MAX(duration_ms) AS ms FROM spans GROUP BY ALL),
 r AS (SELECT trace_id, span_id, parent_span_id, ms FROM u WHERE parent_span_id IS NULL
  UNION ALL SELECT u.trace_id, u.span_id, u.parent_span_id, u.ms FROM r JOIN u ON u.trace_id = r.trace_id AND u.parent_span_id = r.span_id),
 w AS (SELECT trace_id, span_id, span_id AS up, ms FROM r
  UNION ALL SELECT w.trace_id, w.span_id, r.parent_span_id, w.ms FROM w JOIN r ON r.trace_id = w.trace_id AND r.span_id = w.up WHERE r.parent_span_id IS NOT NULL),
 c AS (SELECT trace_id, parent_span_id AS span_id, SUM(ms) AS below FROM r GROUP BY ALL)
 SELECT w.trace_id, w.up AS span_id, COUNT(*) AS spans, CAST(SUM(w.ms) AS BIGINT) AS total_ms, CAST(greatest(0, any_value(r.ms) - coalesce(any_value(c.below), 0)) AS BIGINT) AS self_ms
 FROM w JOIN r ON r.trace_id = w.trace_id AND r.span_id = w.up LEFT JOIN c ON c.trace_id = w.trace_id AND c.span_id = w.up GROUP BY w.trace_id, w.up""", "spans")
def _(t):
    return traces.subtree_totals(t.spans)


# a chain of the orders of each customer, by date; the longest histories grow with the table
_CHAIN_EDGES = """o AS (SELECT o_custkey, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS place FROM orders),
 chain_edges AS (SELECT concat('o', CAST(before AS {S})) AS src, concat('o', CAST(o_orderkey AS {S})) AS dst, 'next' AS relationship, CAST(NULL AS {S}) AS transformation FROM o WHERE before IS NOT NULL)"""
_DUCK_CHAIN = _CHAIN_EDGES.format(S="VARCHAR")


def _chain_edges(t):
    t.orders.createOrReplaceTempView("orders")
    return t.spark.sql(f"WITH {_CHAIN_EDGES.format(S='STRING')} SELECT * FROM chain_edges")


# customer 1's history from its first order to its last
_ENDS = "SELECT concat('o', CAST(min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS STRING)) AS a, concat('o', CAST(max_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS STRING)) AS b FROM orders WHERE o_custkey = 1"


@check("n6_find_path_long", f"WITH {_DUCK_CHAIN} SELECT string_agg('o' || o_orderkey, ' > ' ORDER BY place) AS path FROM o WHERE o_custkey = 1")
def _(t):
    edges = _chain_edges(t)
    ends = t.spark.sql(_ENDS).first()
    return ln.find_path(edges, ends.a, ends.b).select(F.array_join("path", " > ").alias("path"))


@check("n2_downstream_all_levels", f"""WITH {_DUCK_CHAIN} SELECT concat('o', CAST(a.o_orderkey AS VARCHAR)) AS root, concat('o', CAST(b.o_orderkey AS VARCHAR)) AS node, CAST(b.place - a.place AS INT) AS level
 FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.place = 1 AND b.place > 1""")
def _(t):
    edges = _chain_edges(t)
    firsts = t.spark.sql("SELECT concat('o', CAST(min_by(o_orderkey, struct(o_orderdate, o_orderkey)) AS STRING)) AS root FROM orders GROUP BY o_custkey")
    return ln.downstream(edges, firsts, None).select("root", "node", "level")


@check("n8_longest_path", f"WITH {_DUCK_CHAIN} SELECT string_agg('o' || o_orderkey, ' > ' ORDER BY place) AS path FROM o WHERE o_custkey = 2")
def _(t):
    edges = _chain_edges(t)
    first = t.spark.sql(_ENDS.replace("o_custkey = 1", "o_custkey = 2")).first().a
    return ln.longest_path(edges, first).select(F.array_join("path", " > ").alias("path"))
