import math

import numpy as np
import pandas as pd
import pytest

from meshwork.errors import BackendError, GraphError, ValidationError
from meshwork.model import Graph
from meshwork.operators import community, components, degree, pagerank, paths, triangles

from meshwork.sources.edges import read_edges

INF = paths.UNREACHABLE
#: name: (edges, n, directed, degree, triangles, clustering, labels, distances from 0, mean path, core, assortativity)
CASES = {
    "K3": ([(0, 1), (1, 2), (2, 0)], 3, False, [2, 2, 2], [1, 1, 1], [1, 1, 1], [0, 0, 0], [0, 1, 1], 1, [2, 2, 2], math.nan),
    "C3d": ([(0, 1), (1, 2), (2, 0)], 3, True, [1, 1, 1], [1, 1, 1], [1, 1, 1], [0, 0, 0], [0, 1, 2], 4 / 3, [2, 2, 2], math.nan),
    "P3d": ([(0, 1), (1, 2)], 3, True, [1, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 1, 2], 4 / 3, [1, 1, 1], math.nan),
    "2E": ([(0, 1), (2, 3)], 4, False, [1, 1, 1, 1], [0] * 4, [0] * 4, [0, 0, 1, 1], [0, 1, INF, INF], 1, [1] * 4, math.nan),
    "2K3b": ([(0, 1), (1, 2), (2, 0), (3, 4), (4, 5), (5, 3), (2, 3)], 6, False, [2, 2, 3, 3, 2, 2], [1] * 6, [1, 1, 1 / 3, 1 / 3, 1, 1], [0] * 6, [0, 1, 1, 2, 3, 3], 1.8, [2] * 6, -1 / 6),
    "PAW": ([(0, 1), (1, 2), (2, 0), (2, 3)], 4, False, [2, 2, 3, 1], [1, 1, 1, 0], [1, 1, 1 / 3, 0], [0] * 4, [0, 1, 1, 2], 4 / 3, [2, 2, 2, 1], -0.707107),
    "EMPTY": ([], 3, False, [0, 0, 0], [0, 0, 0], [0, 0, 0], [0, 1, 2], [0, INF, INF], math.nan, [0, 0, 0], 0),
    "LOOP": ([(0, 0), (0, 1), (0, 1), (1, 2)], 4, False, [3, 3, 1, 0], [0] * 4, [1, 0, 0, 0], [0, 0, 0, 1], [0, 1, 2, INF], 4 / 3, [1, 1, 1, 0], math.nan),
}
PAGERANK = {
    "K3": [1 / 3] * 3,
    "P3d": [0.05, 0.0925, 0.128625],
    "2K3b": [0.064446, 0.079779, 0.092812, 0.268888, 0.253555, 0.240521],
    "PAW": [0.096668, 0.119668, 0.139218, 0.096668],
    "EMPTY": [0.05] * 3,
    "LOOP": [0.052326, 0.067152, 0.09458, 0.0375],
}


def vector(df):
    rows = sorted(map(tuple, df.collect()))
    assert [r[0] for r in rows] == list(range(len(rows)))
    return [r[1] for r in rows]


def graph(spark, name):
    edges, n, directed = CASES[name][:3]
    return Graph.from_tuples(spark, edges, n, directed) if edges else Graph.of(spark.createDataFrame([], "src long, dst long"), n, directed)


@pytest.mark.parametrize("name", CASES)
def test_fixture(spark, name):
    g = graph(spark, name)
    *_, degrees, tri, cc, labels, far, mean, core, assortativity = CASES[name]
    assert vector(degree.degree(g)) == degrees
    assert vector(triangles.triangles(g)) == tri
    assert np.allclose(vector(triangles.local_clustering(g)), cc)
    assert vector(components.components(g)) == labels
    assert vector(paths.shortest_paths(g, 0)) == far
    assert np.allclose(paths.mean_shortest_path(g).first()[0], mean, equal_nan=True)
    assert vector(community.core_numbers(g)) == core
    assert np.allclose(triangles.assortativity(g).first()[0], assortativity, atol=1e-6, equal_nan=True)


@pytest.mark.parametrize("name", PAGERANK)
def test_pagerank(spark, name):
    assert np.allclose(vector(pagerank.pagerank(graph(spark, name))), PAGERANK[name], atol=1e-6)


def test_strength_and_modes(spark):
    w = Graph.from_tuples(spark, [(0, 1, 0.5), (1, 2, 1.5), (2, 0, 2.0)], 3, weighted=True)
    assert vector(degree.strength(w)) == [2.5, 2.0, 3.5]
    loop = Graph.from_tuples(spark, [(0, 0, 2.0)], 1, weighted=True)
    assert vector(degree.strength(loop)) == [4.0] and vector(degree.strength(loop, loop_once=True)) == [2.0]
    d = graph(spark, "P3d")
    assert vector(degree.in_degree(d)) == [0, 1, 1] and vector(degree.degree(d, "total")) == [1, 2, 1]
    with pytest.raises(GraphError):
        degree.in_degree(w)
    assert vector(paths.reachability(d, 2)) == [False, False, True]
    assert paths.shortest_paths(d, 0, 2).first()[0] == 2 and paths.shortest_paths(d, 2, 0).first()[0] == -1


def test_modularity_and_communities(spark):
    g = graph(spark, "2K3b")
    parts = spark.createDataFrame([(k, k // 3) for k in range(6)], "node long, community long")
    assert np.isclose(community.modularity(g, parts).first()[0], 0.357143, atol=1e-6)
    found = vector(community.communities(g))
    assert found == [0, 0, 0, 3, 3, 3]
    assert len(set(vector(community.label_propagation(graph(spark, "K3"))))) == 1
    with pytest.raises(ValidationError):
        community.communities(g, "other")


@pytest.mark.parametrize(
    "rows,n,said",
    [([(0, -1, 1.0)], 3, "below 0"), ([(0, 5, 1.0)], 3, "n_nodes"), ([(0, 1, None)], 3, "weight is null"), ([(0, 1, math.inf)], 3, "finite"), ([(0, 1, math.nan)], 3, "finite"), ([(None, 1, 1.0)], 3, "dst is null")],
)
def test_validation(spark, rows, n, said):
    g = Graph.of(spark.createDataFrame(rows, "src long, dst long, weight double"), n, weighted=True)
    with pytest.raises(ValidationError, match=said):
        degree.validate(g)


def test_view_adjacency_summary(spark):
    g = graph(spark, "2K3b")
    kept = g.view(spark.createDataFrame([(0,), (1,), (2,), (3,)], "node long"))
    assert sorted(map(tuple, kept.edges.select("src", "dst").collect())) == [(0, 1), (1, 2), (2, 0), (2, 3)]
    loop = graph(spark, "LOOP")
    assert {(r.row, r.col): r.value for r in degree.adjacency(loop, "csr").collect()} == {(0, 0): 2, (0, 1): 2, (1, 0): 2, (1, 2): 1, (2, 1): 1}
    assert {r.value for r in degree.adjacency(loop, "dense").collect()} == {1.0}
    last = Graph.from_tuples(spark, [(0, 1, 5.0), (0, 1, 3.0)], 2, directed=True, weighted=True)
    assert [r.value for r in degree.adjacency(last, "dense").collect()] == [3.0]
    s = degree.summary(graph(spark, "K3")).first()
    assert (s.n_nodes, s.n_edges, s.avg_degree, s.density) == (3, 3, 2.0, 1.0)
    assert len(g.to_pandas_edges()) == 7
    with pytest.raises(ValidationError):
        g.to_pandas_edges(3)


def test_logs(capsys):
    from meshwork.logs import set_up

    set_up(style="json").info("said")
    assert '"message": "said"' in capsys.readouterr().err


def test_sources_and_round_trip(spark, tmp_path):
    from meshwork.cli import main
    from meshwork.sources.edges import read_edges, read_graph, write_graph

    pdf = pd.DataFrame({"u": [0, 1], "v": [1, 2], "w": [0.5, 1.5]})
    pdf.to_csv(f"{tmp_path}/e.csv", index=False)
    spark.createDataFrame(pdf).write.parquet(f"{tmp_path}/e.parquet")
    for source in (pdf, f"{tmp_path}/e.csv", f"{tmp_path}/e.parquet", spark.createDataFrame(pdf)):
        g = read_edges(spark, source, "u", "v", "w")
        assert g.n_nodes == 3 and sorted((r.src, r.dst, r.weight) for r in g.edges.collect()) == [(0, 1, 0.5), (1, 2, 1.5)]
    assert read_edges(spark, np.array([[0, 1], [1, 4]])).n_nodes == 5
    for bad in ("x.txt", 7, np.zeros((2, 1))):
        with pytest.raises(ValidationError):
            read_edges(spark, bad, "u", "v")
    with pytest.raises(ValidationError):
        read_edges(spark, pdf)
    write_graph(g, f"{tmp_path}/g")
    back = read_graph(spark, f"{tmp_path}/g")
    assert (back.n_nodes, back.weighted, back.n_edges()) == (3, True, 2)
    assert main(["compute-degree", "--input", f"{tmp_path}/e.parquet", "--out", f"{tmp_path}/d.parquet"]) == 0
    assert vector(spark.read.parquet(f"{tmp_path}/d.parquet")) == [1, 2, 1]


def test_streaming_degree(spark, tmp_path):
    from meshwork.streaming.degree import streaming_degree

    spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "src long, dst long").write.parquet(f"{tmp_path}/in")
    stream = streaming_degree(spark.readStream.schema("src long, dst long").parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("degrees").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.node: r.degree for r in spark.table("degrees").collect()} == {0: 2, 1: 2, 2: 1}


def test_louvain_goes_on_until_nothing_gains(spark):
    """A path, on which four rounds in one direction each leave nearly every node alone."""
    graph = Graph.of(spark.createDataFrame([(k, k + 1) for k in range(39)], "src long, dst long"), 40)
    found = community.louvain(graph)
    assert found.count() == 40
    assert community.modularity(graph, found).first()[0] > 0.6


def distances(edges, n, directed):
    near = {k: set() for k in range(n)}
    for a, b in edges:
        near[a].add(b)
        if not directed:
            near[b].add(a)
    out = []
    for s in range(n):
        far, front = {s: 0}, [s]
        while front:
            front = [y for x in front for y in sorted(near[x]) if y not in far and far.setdefault(y, far[x] + 1)]
        out.append(far)
    return out


def test_all_pairs_by_bits_equal_breadth_first_searches(spark):
    r = np.random.default_rng(3)
    n = 140
    edges = [(int(a), int(b)) for a, b in r.integers(0, n - 5, (420, 2))] + [(k, k + 1) for k in range(8)]
    for directed in (False, True):
        g = Graph.from_tuples(spark, edges, n, directed)
        far = distances(edges, n, directed)
        pairs = [d for s in range(n) for t, d in far[s].items() if s < t]
        assert np.isclose(paths.mean_shortest_path(g).first()[0], np.mean(pairs))
        want = [0.0 if len(f) == 1 else (len(f) - 1) / sum(f.values()) * (len(f) - 1) / (n - 1) for f in far]
        assert np.allclose(vector(paths.closeness(g)), want)


def test_core_numbers_of_a_long_path_are_whole_or_an_error(spark):
    g = Graph.from_tuples(spark, [(k, k + 1) for k in range(16)], 17)
    assert vector(community.core_numbers(g)) == [1] * 17
    with pytest.raises(BackendError):
        community.core_numbers(g, max_iter=2)


def test_a_view_has_its_own_nodes(spark):
    g = graph(spark, "2K3b")
    v = g.view(spark.createDataFrame([(0,), (1,), (2,), (5,), (99,)], "node long"))
    assert v.n_nodes == 4 and v.n_edges() == 3
    assert sorted(map(tuple, degree.degree(v).collect())) == [(0, 2), (1, 2), (2, 2), (5, 0)]
    assert degree.summary(v).first()["density"] == 0.5
    degree.validate(v)
    assert sorted(map(tuple, components.components(v).collect())) == [(0, 0), (1, 0), (2, 0), (5, 1)]


def test_one_node(spark):
    g = graph(spark, "PAW")
    assert [tuple(r) for r in degree.degree(g, node=2).collect()] == [(2, 3)]
    assert [tuple(r) for r in degree.strength(g, node=3).collect()] == [(3, 1.0)]
    assert [tuple(r) for r in triangles.local_clustering(g, node=0).collect()] == [(0, 1.0)]
    for wrong in (-1, 4, 1.5, "1", True):
        with pytest.raises(ValidationError):
            degree.strength(g, node=wrong)


@pytest.mark.parametrize("rows,n", [([(0, 1.7)], 3), ([(0, -1)], 3), ([(0, 3)], 3), ([("0", 1)], 3), ([(0,)], 3), ([(True, 1)], 3)])
def test_the_constructor_takes_only_node_ids(spark, rows, n):
    with pytest.raises(ValidationError):
        Graph.from_tuples(spark, rows, n)


def test_the_last_of_parallel_edges_wins_whatever_the_source(spark):
    rows = pd.DataFrame({"a": [0, 1, 0, 0], "b": [1, 2, 1, 1], "w": [5.0, 1.0, 9.0, 2.0]})
    for source in (rows, spark.createDataFrame(rows).coalesce(1)):
        g = read_edges(spark, source, "a", "b", "w", directed=True)
        assert sorted(map(tuple, degree.adjacency(g, "dense").collect())) == [(0, 1, 2.0), (1, 2, 1.0)]
    assert degree.adjacency(g, "coo").count() == 4
    with pytest.raises(ValidationError):
        degree.adjacency(g, "other")


def test_partition_summary(spark):
    g = graph(spark, "2K3b")
    assert np.allclose(tuple(community.partition_summary(g, community.louvain(g)).first()), (0.357143, 2), atol=1e-6)
    # a node without a community is one of its own
    some = spark.createDataFrame([(k, 0) for k in range(3)], "node long, community long")
    whole = spark.createDataFrame([(k, 0 if k < 3 else k) for k in range(6)], "node long, community long")
    assert np.isclose(community.modularity(g, some).first()[0], community.modularity(g, whole).first()[0])
