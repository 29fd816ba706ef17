"""Tasks that keep their size as tables grow: the results stay those of the plain form, and what is shuffled stays small."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshwork.functions import ranking
from meshwork.model import Graph
from meshwork.operators import nulls, paths, timeseries, triangles
from meshwork.sources import projections


def tables(spark, folder, n_orders=40):
    r = np.random.default_rng(3)
    items = [(o, int(p), int(p) % 5, 1.0) for o in range(n_orders) for p in r.integers(0, 30, 6)]
    for name, rows, schema in (
        ("lineitem", items, "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double"),
        ("part", [(p,) for p in range(30)], "p_partkey long"),
        ("supplier", [(s, s % 3) for s in range(5)], "s_suppkey long, s_nationkey long"),
        ("orders", [(o, o % 7) for o in range(n_orders)], "o_orderkey long, o_custkey long"),
        ("customer", [(c, c % 3) for c in range(7)], "c_custkey long, c_nationkey long"),
        ("nation", [(n,) for n in range(3)], "n_nationkey long"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return items


def test_projections_get_more_tasks_with_more_items(spark, tmp_path, monkeypatch):
    items = tables(spark, tmp_path)
    monkeypatch.setattr(projections, "LINES_A_TASK", 20, raising=False)
    graph = projections.copurchase(spark, str(tmp_path))
    assert graph.edges.rdd.getNumPartitions() == 12
    orders = {o: sorted({p for q, p, *_ in items if q == o}) for o in range(40)}
    assert {(e.src, e.dst) for e in graph.edges.collect()} == {pair for parts in orders.values() for pair in combinations(parts, 2)}
    trade = projections.trade(spark, str(tmp_path))
    assert "rangepartitioning" not in trade.edges._jdf.queryExecution().toString() and ", 12), REPARTITION_BY_NUM" in trade.edges._jdf.queryExecution().toString()
    want = sorted(((o % 7) % 3, s % 3) for o, _, s, _ in items)
    assert sorted((e.src, e.dst) for e in trade.edges.collect()) == want


@pytest.mark.parametrize("bounds", [{}, {"ARCS_A_TASK": 12, "WEDGES": 7}])
def test_triangles_by_blocks_equal_all_triples(spark, monkeypatch, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(triangles, name, value, raising=False)
    r = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 40, (260, 2))] + [(0, k) for k in range(1, 40)] + [(50, 51)]
    simple = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    want = sorted((a, b, c) for a, b, c in combinations(range(52), 3) if {(a, b), (a, c), (b, c)} <= simple)
    found = triangles.triangle_list(Graph.from_tuples(spark, edges, 52))
    assert sorted(tuple(sorted(t)) for t in found.collect()) == want
    # the closing edges are looked up inside a task: no join of wedges is left in the plan
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert triangles.triangle_list(Graph.from_tuples(spark, [(0, 1)], 3)).isEmpty()


def test_two_blocks_meet_in_one_task(spark, monkeypatch):
    """Lists go to a task for each two blocks, in one order, 4 bytes a node: half as many tasks as ordered pairs, and no row for each node."""
    monkeypatch.setattr(triangles, "LEAST_BLOCKS", 6)
    monkeypatch.setattr(triangles, "ARCS_A_CHUNK", 100)
    r = np.random.default_rng(8)
    edges = sorted({(int(min(e)), int(max(e))) for e in r.integers(0, 2**20, 60)[r.integers(0, 60, (500, 2))] if e[0] != e[1]})
    found = triangles.triangle_list(Graph.from_tuples(spark, edges, 2**20))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [task" in plan and ", 21" in plan and "collect_list" not in plan
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    assert sorted(tuple(sorted(t)) for t in found.collect()) == sorted((a, b, c) for a in near for b in near[a] for c in near[a] & near.get(b, set())) != []


def test_configuration_pairs_across_ranges(spark, monkeypatch):
    graph = Graph.from_tuples(spark, [(k, (7 * k + 1) % 50) for k in range(50)] * 3, 50)
    stubs = graph.edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("d")).select("node", F.explode(F.sequence(F.lit(1), F.col("d"))).alias("stub"))
    stubs = stubs.crossJoin(spark.range(3).withColumnRenamed("id", "sample")).withColumn("key", F.xxhash64(F.lit(7), "sample", "node", "stub"))
    whole = sorted((k.sample, k.key, k.node) for k in stubs.collect())
    want = sorted((a[0], min(a[2], b[2]), max(a[2], b[2])) for a, b in zip(whole[::2], whole[1::2]))
    monkeypatch.setattr(ranking, "ROWS_A_BLOCK", 16)
    # ranges go by the key's leading bits, unsigned: those of keys below zero come last
    order = sorted(((k.sample, k.key % (1 << 64), k.node) for k in stubs.collect()))
    want = sorted((a[0], min(a[2], b[2]), max(a[2], b[2])) for a, b in zip(order[::2], order[1::2]))
    got = sorted(tuple(x) for x in nulls._neighbours_in_order(stubs, 300, 3).collect())
    assert got == want and len(got) == 450


def test_permuted_edges_are_exploded_behind_the_joins(spark):
    graph = Graph.from_tuples(spark, [(k, (k + 3) % 20) for k in range(20)] + [(1, 1), (1, 4)], 20)
    kept = []

    def statistic(edges):
        kept.append(edges)
        return edges.groupBy("sample").agg(F.count("*").cast("double").alias("value"))

    assert nulls.permutation_test(graph, statistic, 4, 1).first()["null_mean"] == 22.0
    rows = kept[0].collect()
    degrees = lambda s: sorted(np.bincount([x for r in rows if r.sample == s for x in (r.src, r.dst)], minlength=20).tolist())
    assert all(degrees(s) == degrees(-1) for s in range(4))
    plan = kept[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Join")


def test_sliding_windows_make_no_join_of_windows(spark):
    points = [(s, t, float((t * 7 + s) % 5) if s != 2 else 1.0) for s, n in ((1, 23), (2, 30), (3, 4), (4, 10)) for t in range(n) if (s, t) != (1, 9)]
    series = spark.createDataFrame(points, "id long, t long, value double")
    for size, step in ((5, 2), (4, 7), (5, 5)):
        want = []
        for s in (1, 2, 3, 4):
            own = {t: v for i, t, v in points if i == s}
            for start in range(0, max(own) - size + 2, step):
                inside = [(s, start, t, own[t]) for t in range(start, start + size) if t in own]
                if len({v for *_, v in inside}) > 1:
                    want += inside
        found = timeseries.sliding_windows(series, size, step)
        assert sorted(tuple(r) for r in found.collect()) == sorted(want)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


@pytest.mark.parametrize("directed", [False, True])
@pytest.mark.parametrize("bounds", [{}, {"NODES_A_BLOCK": 50, "SOURCES_A_BATCH": 64, "STATE_BYTES": 2_500, "GATHERED_BYTES": 64}])
def test_distances_by_batches_and_blocks_equal_searches_from_each_node(spark, monkeypatch, directed, bounds):
    for name, value in bounds.items():
        monkeypatch.setattr(paths, name, value, raising=False)
    r = np.random.default_rng(11)
    n = 140
    edges = [(int(a), int(b)) for a, b in r.integers(0, 120, (360, 2))] + [(k, k + 1) for k in range(125, 129)] + [(3, 3), (0, 1), (0, 1)]
    out = {k: set() for k in range(n)}
    for a, b in edges:
        if a != b:
            out[a].add(b)
            if not directed:
                out[b].add(a)
    want, below = {}, {}
    for s in range(n):
        seen, near, depth = {s}, {s}, 0
        while near:
            near = {y for x in near for y in out[x]} - seen
            seen, depth = seen | near, depth + 1
            for y in near:
                want[y, depth] = want.get((y, depth), 0) + 1
                below[y, depth] = below.get((y, depth), 0) + (s < y)
    graph = Graph.from_tuples(spark, edges, n, directed=directed)
    found = paths.distance_counts(graph).groupBy("node", "distance").agg(F.sum("n").alias("n"), F.sum("below").alias("below")).collect()
    assert {(x.node, x.distance): x.n for x in found} == want
    assert {(x.node, x.distance): x.below for x in found} == below
    some = paths.distance_counts(graph, spark.createDataFrame([(0,), (139,), (0,)], "node long"))
    assert some.agg(F.max("n")).first()[0] == 1


@pytest.mark.parametrize("directed", [False, True])
def test_distances_in_tasks_equal_those_by_levels_and_move_no_bits(spark, monkeypatch, directed):
    """Within the bound of arcs a task makes all levels itself: three tables are stored, however many levels there are."""
    from meshwork.plans import searches

    for name, value in {"LONG": 4, "GATHERED_BYTES": 64, "ARCS_A_ROW": 30, "ROWS_HELD": 50, "PULLED": 20}.items():
        monkeypatch.setattr(searches, name, value)
    stored = []
    for module in (paths, searches):
        monkeypatch.setattr(module, "materialised", lambda df, keep=module.materialised: stored.append(df) or keep(df))
    r = np.random.default_rng(6)
    edges = [(int(a), int(b)) for a, b in zip(r.integers(80, size=160), r.integers(80, size=160) ** 2 // 80)] + [(90 + k, 91 + k) for k in range(8)]
    graph = Graph.from_tuples(spark, edges, 110, directed=directed)
    sums = lambda df: sorted(map(tuple, df.groupBy("node", "distance").agg(F.sum("n"), F.sum("below")).collect()))
    found = sums(paths.distance_counts(graph, against=True))
    assert len(stored) == 3 and max(x[1] for x in found) >= 8
    monkeypatch.setattr(searches, "ARCS_HELD", 0)
    assert sums(paths.distance_counts(graph, against=True)) == found
    assert len(stored) > 10


def test_rounds_get_more_tasks_with_more_arcs(spark, monkeypatch):
    from meshwork.operators import components
    from meshwork.plans import fixpoint

    graph = Graph.from_tuples(spark, [(0, 2), (2, 3), (3, 0), (5, 4), (6, 5), (4, 4)], 8)
    plans = []
    stored = components.materialised
    monkeypatch.setattr(components, "materialised", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    monkeypatch.setattr(fixpoint, "ROWS_A_TASK", 2, raising=False)
    assert sorted(map(tuple, components.roots(graph).collect())) == [(0, 0), (1, 1), (2, 0), (3, 0), (4, 4), (5, 4), (6, 4), (7, 7)]
    assert all("RepartitionByExpression [other" in p for p in plans[1:]) and len(plans) > 1


def test_components_of_dense_graphs_make_rounds_over_few_edges(spark, monkeypatch):
    """Two dense parts, a chain of dense parts that single edges join, and a path: rounds read a share of the edges, and no edge is lost."""
    from meshwork.operators import components

    parts = [range(0, 30), range(30, 55), *(range(60 + 12 * k, 72 + 12 * k) for k in range(4))]
    edges = [e for p in parts for e in combinations(p, 2)] + [(71 + 12 * k, 75 + 12 * k) for k in range(3)] + [(120, 119), (119, 118)]
    rounds = []
    keep = components._rounds
    monkeypatch.setattr(components, "EDGES_A_NODE", 1)
    monkeypatch.setattr(components, "_rounds", lambda nodes, e: rounds.append(e.count()) or keep(nodes, e))
    graph = Graph.from_tuples(spark, edges, 124)
    want = {v: v for v in range(124)} | dict.fromkeys(range(0, 30), 0) | dict.fromkeys(range(30, 55), 30) | dict.fromkeys(range(60, 108), 60) | dict.fromkeys((118, 119, 120), 118)
    assert dict(map(tuple, components.roots(graph).collect())) == want
    assert len(rounds) == 2 and max(rounds) < 0.3 * len(edges)
    assert components.component_count(graph).first()[0] == len(set(want.values()))


def test_simple_projections_of_distinct_pairs_take_no_shuffle(spark, tmp_path):
    tables(spark, tmp_path)
    graph = projections.copurchase(spark, str(tmp_path))
    assert "Aggregate [a#" not in graph.simple()._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, graph.simple().collect())) == sorted({(min(e), max(e)) for e in graph.edges.select("src", "dst").collect()})
