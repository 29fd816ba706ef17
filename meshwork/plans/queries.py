"""Named queries over the driver's tables, with their DuckDB equivalents.

Doubles are rounded in both engines, since sums may differ in the last digit. Queries without an
equivalent draw from hashes or depend on the order of moves; tests hold them to invariants.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.operators import centrality, community, components, degree, nulls, pagerank, paths, structural, timeseries, triangles
from meshwork.sources import projections as on

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Rounds of the fixed-point oracles: more than the graphs need.
ROUNDS = 40

CO = """i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
g AS (SELECT DISTINCT x.l_partkey AS src, y.l_partkey AS dst FROM i x JOIN i y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey),
v AS (SELECT range AS node FROM range((SELECT max(p_partkey) + 1 FROM part))),
s AS (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)"""
TRADE = """g AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, l_extendedprice AS w FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
v AS (SELECT range AS node FROM range((SELECT max(n_nationkey) + 1 FROM nation)))"""
PARTS = """p AS (SELECT max(p_partkey) + 1 AS n FROM part), q AS (SELECT max(s_suppkey) + 1 AS n FROM supplier),
g AS (SELECT l_partkey AS src, l_suppkey + (SELECT n FROM p) AS dst FROM lineitem),
v AS (SELECT range AS node FROM range((SELECT p.n + q.n FROM p, q)))"""
SERIES = "e AS (SELECT user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value FROM events)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rounded(df: DataFrame, *columns: str, digits: int = 9) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


_ENDS = "SELECT src AS node FROM g UNION ALL SELECT dst FROM g WHERE src <> dst"
_DEGREE = f"d AS (SELECT v.node, count(x.node) AS degree FROM v LEFT JOIN ({_ENDS}) x ON v.node = x.node GROUP BY v.node)"


@query("degree", f"WITH {CO}, {_DEGREE} SELECT node, degree FROM d")
def _(spark, d):
    return degree.degree(on.copurchase(spark, d))


@query("degree_multigraph", f"WITH {PARTS}, {_DEGREE} SELECT node, degree FROM d")
def _(spark, d):
    return degree.degree(on.part_supplier(spark, d))


@query("in_degree", f"WITH {TRADE} SELECT v.node, count(g.dst) AS degree FROM v LEFT JOIN g ON v.node = g.dst GROUP BY v.node")
def _(spark, d):
    return degree.in_degree(on.trade(spark, d))


@query("out_degree", f"WITH {TRADE} SELECT v.node, count(g.src) AS degree FROM v LEFT JOIN g ON v.node = g.src GROUP BY v.node")
def _(spark, d):
    return degree.out_degree(on.trade(spark, d))


@query("degree_total", f"WITH {TRADE}, x AS (SELECT src AS node FROM g UNION ALL SELECT dst FROM g) SELECT v.node, count(x.node) AS centrality FROM v LEFT JOIN x ON v.node = x.node GROUP BY v.node")
def _(spark, d):
    return degree.centrality(on.trade(spark, d), "degree")


@query("degree_distribution", f"WITH {PARTS}, {_DEGREE} SELECT degree, count(*) AS n_nodes FROM d GROUP BY degree")
def _(spark, d):
    return degree.degree_distribution(on.part_supplier(spark, d))


@query("strength", f"WITH {TRADE} SELECT v.node, round(coalesce(sum(w), 0), 1) AS strength FROM v LEFT JOIN g ON v.node = g.src GROUP BY v.node")
def _(spark, d):
    return rounded(degree.strength(on.trade(spark, d)), "strength", digits=1)


@query("adjacency_coo", f'WITH {TRADE} SELECT src AS "row", dst AS col, round(w, 2) AS value FROM g')
def _(spark, d):
    return rounded(degree.adjacency(on.trade(spark, d), "coo"), "value", digits=2)


@query("adjacency_csr", f'WITH {TRADE} SELECT src AS "row", dst AS col, round(sum(w), 1) AS value FROM g GROUP BY src, dst')
def _(spark, d):
    return rounded(degree.adjacency(on.trade(spark, d), "csr"), "value", digits=1)


@query("adjacency_dense", f'WITH {CO} SELECT src AS "row", dst AS col, CAST(1 AS DOUBLE) AS value FROM s')
def _(spark, d):
    return degree.adjacency(on.copurchase(spark, d), "dense")


def _small_parts(spark, d):
    """The co-purchases among the parts of at most the middle size."""
    parts = on.table(spark, d, "part").filter("p_size <= 25").select(F.col("p_partkey").alias("node"))
    return on.copurchase(spark, d).view(parts)


_SMALL = f"{CO}, p AS (SELECT DISTINCT p_partkey AS node FROM part WHERE p_size <= 25), h AS (SELECT src, dst FROM g WHERE src IN (SELECT node FROM p) AND dst IN (SELECT node FROM p))"


@query("subgraph_edges", f"WITH {_SMALL} SELECT src, dst FROM h")
def _(spark, d):
    return _small_parts(spark, d).edges.select("src", "dst")


@query("subgraph_summary", f"WITH {_SMALL}, n AS (SELECT count(*) AS n FROM p), m AS (SELECT count(*) AS m FROM h) SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / n, 9) AS avg_degree, round(2.0 * m / (CAST(n AS DOUBLE) * (n - 1)), 12) AS density FROM n, m")
def _(spark, d):
    return degree.summary(_small_parts(spark, d)).withColumns({"avg_degree": F.round("avg_degree", 9), "density": F.round("density", 12)})


@query("graph_summary", f"WITH {CO}, n AS (SELECT count(*) AS n FROM v), m AS (SELECT count(*) AS m FROM g) SELECT n AS n_nodes, m AS n_edges, round(2.0 * m / n, 9) AS avg_degree, round(2.0 * m / (CAST(n AS DOUBLE) * (n - 1)), 12) AS density FROM n, m")
def _(spark, d):
    return degree.summary(on.copurchase(spark, d)).withColumns({"avg_degree": F.round("avg_degree", 9), "density": F.round("density", 12)})


@query("validate_report", f"WITH {TRADE} SELECT count(*) AS n_edges, count(*) FILTER (src IS NULL OR dst IS NULL) AS null_ends, count(*) FILTER (src < 0 OR dst < 0) AS negative_ids, count(*) FILTER (greatest(src, dst) >= (SELECT count(*) FROM v)) AS ids_past_n, count(*) FILTER (w IS NULL) AS null_weights, count(*) FILTER (NOT isfinite(w)) AS non_finite_weights FROM g")
def _(spark, d):
    return degree.validation_report(on.trade(spark, d))


_TRI = "t AS (SELECT x.src AS a, x.dst AS b, y.dst AS c FROM g x JOIN g y ON x.dst = y.src JOIN g z ON z.src = x.src AND z.dst = y.dst), tn AS (SELECT unnest([a, b, c]) AS node FROM t), tc AS (SELECT v.node, count(tn.node) AS triangles FROM v LEFT JOIN tn ON v.node = tn.node GROUP BY v.node)"
_CC = f"{_DEGREE}, {_TRI}, cc AS (SELECT node, degree, CASE WHEN degree >= 2 THEN 2.0 * triangles / (degree * (degree - 1)) ELSE 0.0 END AS c FROM d JOIN tc USING (node))"


@query("triangles", f"WITH {CO}, {_TRI} SELECT node, triangles FROM tc")
def _(spark, d):
    return triangles.triangles(on.copurchase(spark, d))


@query("clustering", f"WITH {CO}, {_CC} SELECT node, round(CAST(c AS DOUBLE), 9) AS clustering FROM cc")
def _(spark, d):
    return rounded(triangles.local_clustering(on.copurchase(spark, d)), "clustering")


@query("average_clustering", f"WITH {CO}, {_CC} SELECT round(coalesce(avg(c) FILTER (degree >= 2), 0), 9) AS average_clustering, round(coalesce(avg(c), 0), 9) AS mean_clustering FROM cc")
def _(spark, d):
    return rounded(triangles.average_clustering(on.copurchase(spark, d)), "average_clustering", "mean_clustering")


@query("assortativity", f"WITH {CO}, {_DEGREE} SELECT round(corr(CAST(a.degree AS DOUBLE), CAST(b.degree AS DOUBLE)), 9) AS assortativity FROM g JOIN d a ON g.src = a.node JOIN d b ON g.dst = b.node")
def _(spark, d):
    return rounded(triangles.assortativity(on.copurchase(spark, d)), "assortativity")


@query(
    "modularity_region",
    f"""WITH {TRADE}, p AS (SELECT a.n_regionkey AS cs, b.n_regionkey AS cd, sum(w) AS w FROM g JOIN nation a ON src = a.n_nationkey JOIN nation b ON dst = b.n_nationkey GROUP BY ALL),
o AS (SELECT cs AS c, sum(w) AS o, sum(CASE WHEN cs = cd THEN w ELSE 0 END) AS l FROM p GROUP BY cs), n AS (SELECT cd AS c, sum(w) AS i FROM p GROUP BY cd), m AS (SELECT sum(w) AS m FROM p)
SELECT round(sum(l) / any_value(m) - sum(o * i) / (any_value(m) * any_value(m)), 9) AS modularity FROM o JOIN n USING (c), m""",
)
def _(spark, d):
    regions = on.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("node"), F.col("n_regionkey").alias("community"))
    return rounded(community.modularity(on.trade(spark, d), regions, collapse=False), "modularity")


@query(
    "pagerank_20",
    f"""WITH RECURSIVE {TRADE}, k AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS o FROM g GROUP BY src),
a AS (SELECT g.src, g.dst, CAST(count(*) AS DOUBLE) / any_value(o.o) AS share FROM g JOIN o ON g.src = o.src GROUP BY g.src, g.dst UNION ALL SELECT node, node, 0.0 FROM v),
r(i, node, p) AS (SELECT 0, node, 1.0::DOUBLE / n FROM v, k UNION ALL
SELECT any_value(r.i) + 1, a.dst, 0.15::DOUBLE / any_value(k.n) + 0.85::DOUBLE * sum(a.share * r.p) FROM r JOIN a ON a.src = r.node, k WHERE r.i < 20 GROUP BY a.dst)
SELECT node, round(p, 9) AS pagerank FROM r WHERE i = 20""",
)
def _(spark, d):
    return rounded(pagerank.pagerank(on.trade(spark, d), tol=None, max_iter=20), "pagerank")


@query(
    "pagerank_tolerance",
    f"""WITH RECURSIVE {CO}, k AS (SELECT count(*) AS n FROM v), o AS (SELECT src, count(*) AS o FROM g GROUP BY src),
a AS (SELECT g.src, g.dst, 1.0::DOUBLE / o.o AS share FROM g JOIN o ON g.src = o.src UNION ALL SELECT node, node, 0.0 FROM v),
r(i, node, p) AS (SELECT 0, node, 1.0::DOUBLE / n FROM v, k UNION ALL
SELECT any_value(r.i) + 1, a.dst, 0.15::DOUBLE / any_value(k.n) + 0.85::DOUBLE * sum(a.share * r.p) FROM r JOIN a ON a.src = r.node, k WHERE r.i < 60 GROUP BY a.dst),
c AS (SELECT y.i, sqrt(sum((y.p - x.p) * (y.p - x.p))) AS change FROM r x JOIN r y ON x.node = y.node AND y.i = x.i + 1 GROUP BY y.i)
SELECT node, round(p, 9) AS pagerank FROM r WHERE i = (SELECT min(i) - 1 FROM c WHERE change < 1e-6)""",
)
def _(spark, d):
    return rounded(pagerank.pagerank(on.copurchase(spark, d)), "pagerank")


_SOURCE = "f AS (SELECT min(src) AS node FROM g)"
_BFS = f"WITH RECURSIVE {CO}, {_SOURCE}, b(node, dist) AS (SELECT node, 0::BIGINT FROM f UNION SELECT s.dst, b.dist + 1 FROM b JOIN s ON s.src = b.node WHERE b.dist < {ROUNDS}), m AS (SELECT node, min(dist) AS dist FROM b GROUP BY node)"


def _first(graph):
    return graph.edges.agg(F.min("src")).first()[0]


@query("bfs_from_first", f"{_BFS} SELECT v.node, coalesce(m.dist, 9223372036854775807) AS distance FROM v LEFT JOIN m ON v.node = m.node")
def _(spark, d):
    graph = on.copurchase(spark, d).stored()
    return paths.shortest_paths(graph, _first(graph))


@query("reachable_from_first", f"{_BFS} SELECT v.node, m.dist IS NOT NULL AS reachable FROM v LEFT JOIN m ON v.node = m.node")
def _(spark, d):
    graph = on.copurchase(spark, d).stored()
    return paths.reachability(graph, _first(graph))


_PAIRS = f"WITH RECURSIVE {CO}, b(root, node, dist) USING KEY (root, node) AS (SELECT node, node, 0::BIGINT FROM v UNION SELECT b.root, s.dst, min(b.dist) + 1 FROM b JOIN s ON s.src = b.node LEFT JOIN recurring.b AS o ON o.root = b.root AND o.node = s.dst WHERE o.node IS NULL GROUP BY b.root, s.dst)"


@query("mean_shortest_path", f"{_PAIRS} SELECT round(avg(dist), 9) AS mean_shortest_path FROM b WHERE root < node")
def _(spark, d):
    return rounded(paths.mean_shortest_path(on.copurchase(spark, d)), "mean_shortest_path")


@query("closeness", f"{_PAIRS}, c AS (SELECT node, count(*) AS r, sum(dist) AS d FROM b WHERE root <> node GROUP BY node) SELECT v.node, round(coalesce(1.0 * r / d * r / ((SELECT count(*) FROM v) - 1), 0), 9) AS centrality FROM v LEFT JOIN c ON v.node = c.node")
def _(spark, d):
    return rounded(paths.closeness(on.copurchase(spark, d)), "centrality")


# forwards path counts by level, backwards dependencies from the deepest level on
@query(
    "betweenness_suppliers",
    f"""WITH RECURSIVE {PARTS}, s AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM g UNION ALL SELECT dst, src FROM g)), f AS (SELECT DISTINCT s_suppkey + (SELECT n FROM p) AS node FROM supplier),
b(root, node, dist, paths) USING KEY (root, node) AS (SELECT node, node, 0::BIGINT, 1::DOUBLE FROM f UNION SELECT b.root, s.dst, min(b.dist) + 1, sum(b.paths) FROM b JOIN s ON s.src = b.node LEFT JOIN recurring.b AS o ON o.root = b.root AND o.node = s.dst WHERE o.node IS NULL GROUP BY b.root, s.dst),
r AS (SELECT root, node, dist, paths FROM b),
d(level, root, node, part, dep) AS (SELECT dist, root, node, 1 / paths, 0::DOUBLE FROM r WHERE dist = (SELECT max(dist) FROM r) UNION ALL
SELECT l.level - 1, v.root, v.node, (1 + v.paths * coalesce(sum(x.part), 0)) / v.paths, v.paths * coalesce(sum(x.part), 0) FROM (SELECT DISTINCT level FROM d) l JOIN r v ON v.dist = l.level - 1
LEFT JOIN (SELECT d.root, s.src AS node, d.part FROM d JOIN s ON s.dst = d.node) x ON x.root = v.root AND x.node = v.node GROUP BY l.level, v.root, v.node, v.paths),
t AS (SELECT node, sum(dep) / 2 AS c FROM d WHERE root <> node GROUP BY node)
SELECT v.node, round(coalesce(t.c, 0), 6) AS centrality FROM v LEFT JOIN t ON v.node = t.node""",
)
def _(spark, d):
    suppliers = on.table(spark, d, "supplier").select((F.col("s_suppkey") + on.n_parts(spark, d)).alias("node"))
    return rounded(centrality.betweenness(on.part_supplier(spark, d), suppliers), "centrality", digits=6)


@query(
    "eigenvector_10",
    f"""WITH RECURSIVE {CO}, a AS (SELECT src, dst FROM s UNION ALL SELECT node, node FROM v),
r(i, node, x) AS (SELECT 0, node, 1 / sqrt((SELECT count(*) FROM v)) FROM v UNION ALL SELECT i + 1, node, y / sqrt(sum(y * y) OVER ()) FROM (SELECT r.i AS i, a.dst AS node, sum(r.x) AS y FROM r JOIN a ON a.src = r.node WHERE r.i < 10 GROUP BY r.i, a.dst))
SELECT node, round(x, 9) AS centrality FROM r WHERE i = 10""",
)
def _(spark, d):
    return rounded(centrality.eigenvector(on.copurchase(spark, d), tol=None, max_iter=10), "centrality")


@query(
    "cheapest_from_first",
    f"""WITH RECURSIVE p AS (SELECT max(p_partkey) + 1 AS n FROM part), q AS (SELECT max(s_suppkey) + 1 AS n FROM supplier), g AS (SELECT l_partkey AS src, l_suppkey + (SELECT n FROM p) AS dst, l_extendedprice AS w FROM lineitem),
v AS (SELECT range AS node FROM range((SELECT p.n + q.n FROM p, q))), a AS (SELECT src, dst, min(w) AS w FROM (SELECT src, dst, w FROM g UNION ALL SELECT dst, src, w FROM g UNION ALL SELECT node, node, 0 FROM v) GROUP BY src, dst),
r(i, node, d) AS (SELECT 0, min(src), 0::DOUBLE FROM g UNION ALL SELECT r.i + 1, a.dst, min(r.d + a.w) FROM r JOIN a ON a.src = r.node WHERE r.i < {ROUNDS} GROUP BY r.i, a.dst)
SELECT v.node, round(coalesce(r.d, 'infinity'::DOUBLE), 4) AS distance FROM v LEFT JOIN (SELECT * FROM r WHERE i = {ROUNDS}) r ON v.node = r.node""",
)
def _(spark, d):
    graph = on.supply_costs(spark, d)
    return rounded(paths.weighted_paths(graph, _first(graph)), "distance", digits=4)


_ROOTS = f"WITH RECURSIVE {CO}, b(node, root) AS (SELECT node, node FROM v UNION SELECT s.dst, b.root FROM b JOIN s ON s.src = b.node WHERE b.root < s.dst), m AS (SELECT node, min(root) AS root FROM b GROUP BY node)"


@query("components", f"{_ROOTS} SELECT node, CAST(dense_rank() OVER (ORDER BY root) - 1 AS BIGINT) AS component FROM m")
def _(spark, d):
    return components.components(on.copurchase(spark, d))


@query("component_count", f"{_ROOTS} SELECT count(DISTINCT root) AS n_components FROM m")
def _(spark, d):
    return components.component_count(on.copurchase(spark, d))


# rounds go on until no value falls, as the operator's
@query(
    "core_number",
    f"""WITH RECURSIVE {CO}, c(i, node, core, falls) AS (SELECT 0, src, count(*), true FROM s GROUP BY src UNION ALL
SELECT i + 1, node, h, max(h < core) OVER () FROM (SELECT i, node, any_value(own) AS core, max(least(x, r)) AS h FROM (SELECT c.i, s.src AS node, o.core AS own, c.core AS x, row_number() OVER (PARTITION BY s.src ORDER BY c.core DESC) AS r FROM c JOIN s ON s.dst = c.node JOIN c o ON o.node = s.src WHERE c.falls) GROUP BY i, node))
SELECT v.node, CAST(coalesce(c.core, 0) AS BIGINT) AS core FROM v LEFT JOIN (SELECT * FROM c WHERE i = (SELECT max(i) FROM c)) c ON v.node = c.node""",
)
def _(spark, d):
    return community.core_numbers(on.copurchase(spark, d))


@query(
    "label_propagation_8",
    f"""WITH RECURSIVE {CO}, a AS (SELECT src, dst FROM s UNION ALL SELECT node, node FROM v WHERE node NOT IN (SELECT src FROM s)),
l(i, node, community) AS (SELECT 0, node, node FROM v UNION ALL
SELECT i + 1, node, community FROM (SELECT i, node, community, row_number() OVER (PARTITION BY node ORDER BY n DESC, community) AS r FROM
(SELECT l.i AS i, a.src AS node, l.community, count(*) AS n FROM l JOIN a ON a.dst = l.node WHERE l.i < 8 GROUP BY ALL)) WHERE r = 1)
SELECT node, community FROM l WHERE i = 8""",
)
def _(spark, d):
    return community.label_propagation(on.copurchase(spark, d), 8)


# which labels win depends on hashes; that each is among the heaviest around its node does not
@query("label_propagation_settled", f"WITH {PARTS} SELECT count(*) AS n_nodes, 0::BIGINT AS n_unsettled FROM v")
def _(spark, d):
    graph = on.part_supplier(spark, d).stored()
    return community.unsettled(graph, community.semi_synchronous_labels(graph))


@query("louvain")
def _(spark, d):
    return community.louvain(on.copurchase(spark, d))


@query("walk_2", f"WITH {TRADE}, o AS (SELECT src, count(*) AS o FROM g GROUP BY src), a AS (SELECT g.src, g.dst, CAST(count(*) AS DOUBLE) / any_value(o.o) AS p FROM g JOIN o ON g.src = o.src GROUP BY g.src, g.dst) SELECT x.src, y.dst, round(sum(x.p * y.p), 9) AS probability FROM a x JOIN a y ON x.dst = y.src GROUP BY x.src, y.dst")
def _(spark, d):
    return rounded(paths.walk_metrics(on.trade(spark, d), 2), "probability")


@query("confidence_interval", "SELECT round(avg(value) - 1.959963984540054 * stddev_pop(value), 6) AS low, round(avg(value) + 1.959963984540054 * stddev_pop(value), 6) AS high FROM events")
def _(spark, d):
    return rounded(nulls.confidence_interval(on.table(spark, d, "events"), "value"), "low", "high", digits=6)


@query("bootstrap_mean")
def _(spark, d):
    return nulls.bootstrap(on.table(spark, d, "supplier"), "s_acctbal", n_bootstrap=200, seed=7)


@query("null_configuration")
def _(spark, d):
    return nulls.null_models(on.copurchase(spark, d), "configuration", 5, 7)


@query("null_er")
def _(spark, d):
    return nulls.null_models(on.copurchase(spark, d), "erdos_renyi", 5, 7)


@query("null_swap")
def _(spark, d):
    return nulls.null_models(on.copurchase(spark, d), "degree_preserving", 5, 7)


@query("null_swap_summary", f"WITH {CO} SELECT range AS sample, (SELECT count(*) FROM g) AS n_edges, 0::BIGINT AS n_loops, 0::BIGINT AS n_parallel, 0::BIGINT AS n_moved_degrees, true AS mixed FROM range(3)")
def _(spark, d):
    graph = on.copurchase(spark, d).stored()
    found = nulls.null_summary(graph, nulls.null_models(graph, "degree_preserving", 3, 7))
    return found.select("sample", "n_edges", "n_loops", "n_parallel", "n_moved_degrees", (F.col("n_kept") < 0.5 * F.col("n_edges")).alias("mixed"))


@query("null_er_summary", f"WITH {CO}, m AS (SELECT count(*) AS m FROM g) SELECT range AS sample, 0::BIGINT AS n_loops, 0::BIGINT AS n_parallel, true AS as_dense FROM range(5)")
def _(spark, d):
    graph = on.copurchase(spark, d).stored()
    m = graph.n_edges()
    found = nulls.null_summary(graph, nulls.null_models(graph, "erdos_renyi", 5, 7))
    # six standard deviations of the number of edges
    return found.select("sample", "n_loops", "n_parallel", (F.abs(F.col("n_edges") - m) < 6 * F.sqrt(F.lit(float(m)))).alias("as_dense"))


@query("permutation_test")
def _(spark, d):
    def edges_to_lower_half(edges):
        return edges.groupBy("sample").agg(F.avg((F.col("src") < F.col("dst")).cast("double")).alias("value"))

    return nulls.permutation_test(on.copurchase(spark, d), edges_to_lower_half, 20, 7)


@query(
    "hvg_degree",
    f"""WITH {SERIES}, p AS (SELECT x.id, x.t AS i, y.t AS j FROM e x JOIN e y ON x.id = y.id AND y.t > x.t WHERE NOT EXISTS (SELECT 1 FROM e z WHERE z.id = x.id AND z.t > x.t AND z.t < y.t AND z.value >= least(x.value, y.value))),
n AS (SELECT id, unnest([i, j]) AS t FROM p) SELECT e.id, e.t, count(n.t) AS degree FROM e LEFT JOIN n ON e.id = n.id AND e.t = n.t GROUP BY e.id, e.t""",
)
def _(spark, d):
    series = on.event_series(spark, d)
    return timeseries.visibility_degree(series, timeseries.hvg_edges(series))


@query(
    "nvg_degree_limit",
    f"""WITH {SERIES}, p AS (SELECT x.id, x.t AS i, y.t AS j, (y.value - x.value) / (y.t - x.t) AS s FROM e x JOIN e y ON x.id = y.id AND y.t > x.t AND y.t <= x.t + 10),
q AS (SELECT *, max(s) OVER (PARTITION BY id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p),
n AS (SELECT id, unnest([i, j]) AS t FROM q WHERE m IS NULL OR s >= m) SELECT e.id, e.t, count(n.t) AS degree FROM e LEFT JOIN n ON e.id = n.id AND e.t = n.t GROUP BY e.id, e.t""",
)
def _(spark, d):
    series = on.event_series(spark, d)
    return timeseries.visibility_degree(series, timeseries.nvg_edges(series, 10))


# values are rounded: a point on a chord is told from one above it by more than that explains, whichever end slopes are taken from
@query(
    "nvg_degree",
    f"""WITH {SERIES}, p AS (SELECT x.id, x.t AS i, y.t AS j, (y.value - x.value) / (y.t - x.t) AS s, pow(2, -51) * (abs(x.value) + abs(y.value)) / (y.t - x.t) AS o FROM e x JOIN e y ON x.id = y.id AND y.t > x.t),
q AS (SELECT *, max(s - o) OVER (PARTITION BY id, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM p),
n AS (SELECT id, unnest([i, j]) AS t FROM q WHERE m IS NULL OR s + o >= m) SELECT e.id, e.t, count(n.t) AS degree FROM e LEFT JOIN n ON e.id = n.id AND e.t = n.t GROUP BY e.id, e.t""",
)
def _(spark, d):
    series = on.event_series(spark, d)
    return timeseries.visibility_degree(series, timeseries.nvg_edges(series))


@query("transition_network", "WITH x AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events) SELECT src, dst, count(*) AS n FROM x WHERE dst IS NOT NULL GROUP BY src, dst")
def _(spark, d):
    return timeseries.transition_network(on.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(
    "ordinal_transitions",
    f"""WITH {SERIES}, x AS (SELECT id, t, value AS a, lead(value) OVER w AS b, lead(value, 2) OVER w AS c FROM e WINDOW w AS (PARTITION BY id ORDER BY t)),
y AS (SELECT id, t, CASE WHEN a <= b AND b <= c THEN '012' WHEN a <= c AND c < b THEN '021' WHEN b < a AND a <= c THEN '102' WHEN b <= c AND c < a THEN '120' WHEN c < a AND a <= b THEN '201' ELSE '210' END AS symbol FROM x WHERE c IS NOT NULL),
z AS (SELECT symbol AS src, lead(symbol) OVER (PARTITION BY id ORDER BY t) AS dst FROM y) SELECT src, dst, count(*) AS n FROM z WHERE dst IS NOT NULL GROUP BY src, dst""",
)
def _(spark, d):
    return timeseries.transition_network(timeseries.ordinal_patterns(on.event_series(spark, d), 3), "id", ["t"], "symbol")


@query(
    "recurrence_knn",
    f"""WITH {SERIES}, x AS (SELECT id, t, value AS a, lag(value) OVER (PARTITION BY id ORDER BY t) AS b FROM e), y AS (SELECT * FROM x WHERE b IS NOT NULL),
p AS (SELECT m.id, m.t AS i, n.t AS j, sqrt((m.a - n.a) * (m.a - n.a) + (m.b - n.b) * (m.b - n.b)) AS s FROM y m JOIN y n ON m.id = n.id AND m.t <> n.t),
r AS (SELECT id, i, j, CAST(row_number() OVER (PARTITION BY id, i ORDER BY s, j) AS INTEGER) AS rank, round(s, 9) AS distance FROM p) SELECT * FROM r WHERE rank <= 3""",
)
def _(spark, d):
    return rounded(timeseries.recurrence_knn(on.event_series(spark, d)), "distance")


def _radius(metric: str, distance: str):
    @query(
        f"recurrence_radius_{metric}",
        f"""WITH {SERIES}, x AS (SELECT id, t, value AS a, lag(value) OVER (PARTITION BY id ORDER BY t) AS b FROM e), y AS (SELECT * FROM x WHERE b IS NOT NULL),
p AS (SELECT m.id, m.t AS i, n.t AS j, {distance} AS s FROM y m JOIN y n ON m.id = n.id AND m.t < n.t) SELECT id, i, j, round(s, 9) AS distance FROM p WHERE s < 20""",
    )
    def _(spark, d):
        return rounded(timeseries.recurrence_radius(on.event_series(spark, d), 20.0, metric=metric), "distance")


_radius("euclidean", "sqrt((m.a - n.a) * (m.a - n.a) + (m.b - n.b) * (m.b - n.b))")
_radius("manhattan", "abs(m.a - n.a) + abs(m.b - n.b)")
_radius("maximum", "greatest(abs(m.a - n.a), abs(m.b - n.b))")


@query("series_resample", "SELECT user_id AS id, date_trunc('day', ts) AS t, round(avg(value), 9) AS value FROM events GROUP BY ALL")
def _(spark, d):
    from meshwork.sources.edges import resample

    rows = on.table(spark, d, "events").select(F.col("user_id").alias("id"), "ts", "value")
    return rounded(resample(rows, "day"), "value")


@query(
    "series_decomposed",
    f"""WITH {SERIES}, x AS (SELECT *, count(value) OVER w AS n, sum(value) OVER (PARTITION BY id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) + 0.5 * (lag(value, 3) OVER (PARTITION BY id ORDER BY t) + lead(value, 3) OVER (PARTITION BY id ORDER BY t)) AS s FROM e WINDOW w AS (PARTITION BY id ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
y AS (SELECT id, t, value, t % 6 AS phase, CASE WHEN n = 7 THEN s / 6 END AS trend FROM x), o AS (SELECT id, phase, avg(value - trend) AS o FROM y WHERE trend IS NOT NULL GROUP BY id, phase),
z AS (SELECT id, phase, o - avg(o) OVER (PARTITION BY id) AS seasonal FROM o)
SELECT y.id, y.t, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(value - trend - seasonal, 9) AS residual FROM y LEFT JOIN z ON y.id = z.id AND y.phase = z.phase""",
)
def _(spark, d):
    return rounded(timeseries.decompose(on.event_series(spark, d), 6), "trend", "seasonal", "residual").drop("value")


#: Filter and smoother of a level whose shocks have a tenth of the noise's variance.
_FILTER = f"""WITH RECURSIVE {SERIES},
f AS (SELECT id, t, 0.0::DOUBLE AS before, 1000000.1::DOUBLE AS p, value AS y, 1000000.1 / 1000001.1 * value AS m, (1000000.1 / 1000001.1)::DOUBLE AS k FROM e WHERE t = 0
UNION ALL SELECT e.id, e.t, f.m, f.k + 0.1, e.value, f.m + (f.k + 0.1) / (f.k + 1.1) * (e.value - f.m), (f.k + 0.1) / (f.k + 1.1) FROM f JOIN e ON e.id = f.id AND e.t = f.t + 1)"""


@query(
    "series_structural",
    f"""{_FILTER}, n AS (SELECT id, max(t) AS last FROM e GROUP BY id),
b AS (SELECT f.id, f.t, f.y, f.m AS s, f.k AS v FROM f JOIN n ON f.id = n.id AND f.t = n.last
UNION ALL SELECT f.id, f.t, f.y, f.m + f.k / (f.k + 0.1) * (b.s - f.m), f.k + (f.k / (f.k + 0.1)) * (f.k / (f.k + 0.1)) * (b.v - f.k - 0.1) FROM b JOIN f ON f.id = b.id AND f.t = b.t - 1)
SELECT id, t, round(s, 4) AS level, round(v, 4) AS level_spread, round(y - s, 4) AS residual FROM b""",
)
def _(spark, d):
    found = structural.structural(on.event_series(spark, d), level=0.1)
    return rounded(found, "level", "level_spread", "residual", digits=4).select("id", "t", "level", "level_spread", "residual")


@query(
    "series_likelihoods",
    f"""{_FILTER}, x AS (SELECT id, count(*) AS n, sum((y - before) * (y - before) / (p + 1)) AS q, sum(ln(p + 1)) AS l FROM f WHERE t > 0 GROUP BY id)
SELECT id, n, round(q / n, 4) AS noise, CASE WHEN q > 0 THEN round(-0.5 * (n * (ln(2 * pi() * q / n) + 1) + l), 4) END AS log_likelihood FROM x""",
)
def _(spark, d):
    found = structural.likelihoods(on.event_series(spark, d), level=0.1).filter("n > 0")
    return rounded(found, "noise", "log_likelihood", digits=4)


@query("sliding_windows", f"WITH {SERIES}, b AS (SELECT id, max(t) AS last FROM e GROUP BY id), w AS (SELECT id, unnest(range(0, CAST(last - 19 AS BIGINT) + 1, 10)) AS start FROM b WHERE last >= 19), x AS (SELECT w.id, w.start, e.t, e.value FROM w JOIN e ON e.id = w.id AND e.t >= w.start AND e.t < w.start + 20) SELECT id, start, count(*) AS n, round(avg(value), 9) AS mean FROM x GROUP BY id, start HAVING max(value) > min(value)")
def _(spark, d):
    rows = timeseries.sliding_windows(on.event_series(spark, d), 20, 10)
    return rounded(rows.groupBy("id", "start").agg(F.count("*").alias("n"), F.avg("value").alias("mean")), "mean")


@query("members_per_community", f"{_ROOTS} SELECT root AS community, count(*) AS size FROM m GROUP BY root")
def _(spark, d):
    return components.roots(on.copurchase(spark, d)).groupBy(F.col("root").alias("community")).agg(F.count("*").alias("size"))


@query("top_degrees", f"WITH {PARTS}, {_DEGREE} SELECT node, degree FROM d ORDER BY degree DESC, node LIMIT 20")
def _(spark, d):
    return degree.degree(on.part_supplier(spark, d)).orderBy(F.desc("degree"), "node").limit(20)


@query("value_histogram", "WITH r AS (SELECT min(value) AS a, (max(value) - min(value)) / 10 AS w FROM events) SELECT CAST(least(floor((value - a) / w), 9) AS BIGINT) AS bin, count(*) AS n FROM events, r GROUP BY 1")
def _(spark, d):
    return nulls.distribution(on.table(spark, d, "events"), "value").select("bin", "n")
