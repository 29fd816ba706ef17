"""Degrees, strengths, adjacency and summaries: single-pass aggregates over the edge table."""

from __future__ import annotations

from numbers import Integral

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshwork.errors import GraphError, ValidationError
from meshwork.model import Graph


def _ends(graph: Graph, mode: str, loop_once: bool = True) -> DataFrame:
    """(node, weight): an edge's ends that count for the mode."""
    out = graph.edges.select(F.col("src").alias("node"), "weight")
    if graph.directed and mode == "out":
        return out
    into = graph.edges.select("src", F.col("dst").alias("node"), "weight")
    if graph.directed and mode == "in":
        return into.select("node", "weight")
    if not graph.directed and loop_once:
        into = into.filter("src <> node")
    return out.union(into.select("node", "weight"))


def only(graph: Graph, values: DataFrame, node: int | None) -> DataFrame:
    """``values`` (node, ...), of one node where it is given: the filter reaches the scans below."""
    return values if node is None else values.filter(F.col("node") == check_node(graph, node))


def degree(graph: Graph, mode: str = "out", node: int | None = None) -> DataFrame:
    """(node, degree). Directed: out, in, or their sum for any other mode. Undirected: a self-loop counts once."""
    return only(graph, graph.dense(_ends(graph, mode).groupBy("node").agg(F.count("*").alias("degree")), "degree", 0), node)


def in_degree(graph: Graph, node: int | None = None) -> DataFrame:
    if not graph.directed:
        raise GraphError("in-degree needs a directed graph")
    return degree(graph, "in", node)


def out_degree(graph: Graph, node: int | None = None) -> DataFrame:
    if not graph.directed:
        raise GraphError("out-degree needs a directed graph")
    return degree(graph, "out", node)


def strength(graph: Graph, mode: str = "out", loop_once: bool = False, node: int | None = None) -> DataFrame:
    """(node, strength). Unweighted graphs give degrees; an undirected self-loop counts its weight twice unless ``loop_once``."""
    if not graph.weighted:
        return degree(graph, mode, node).select("node", F.col("degree").cast("double").alias("strength"))
    return only(graph, graph.dense(_ends(graph, mode, loop_once).groupBy("node").agg(F.sum("weight").alias("strength")), "strength", 0.0), node)


def centrality(graph: Graph, method: str = "degree", **options) -> DataFrame:
    """(node, centrality): degree (not normalised), pagerank, closeness, betweenness or eigenvector."""
    if method == "degree":
        return degree(graph, "total").withColumnRenamed("degree", "centrality")
    if method == "pagerank":
        from meshwork.operators.pagerank import pagerank

        return pagerank(graph, **options).withColumnRenamed("pagerank", "centrality")
    if method == "closeness":
        from meshwork.operators.paths import closeness

        return closeness(graph, **options)
    if method in ("betweenness", "eigenvector"):
        from meshwork.operators import centrality as more

        return getattr(more, method)(graph, **options)
    raise ValidationError(f"Unknown centrality: {method}")


def degree_distribution(graph: Graph, mode: str = "out") -> DataFrame:
    return degree(graph, mode).groupBy("degree").agg(F.count("*").alias("n_nodes"))


def adjacency(graph: Graph, form: str = "csr") -> DataFrame:
    """(row, col, value) of the adjacency matrix.

    dense: parallel edges collapse (the last weight by eid wins); coo: every entry is kept; csr: they add up. An
    undirected matrix is mirrored, which puts a self-loop in twice in coo and csr.
    """
    value: Column = F.col("weight") if graph.weighted else F.lit(1.0)
    own = graph.edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), value.alias("value"), "eid")
    if not graph.directed:
        own = own.union(own.select("col", "row", "value", "eid"))
    if form == "coo":
        return own.select("row", "col", "value")
    if form == "csr":
        return own.groupBy("row", "col").agg(F.sum("value").alias("value"))
    if form == "dense":
        return own.groupBy("row", "col").agg(F.max_by("value", F.coalesce("eid", F.lit(0))).alias("value"))
    raise ValidationError(f"Unknown adjacency form: {form}")


def summary(graph: Graph) -> DataFrame:
    """One row: n_nodes, n_edges, avg_degree, density (edges over possible pairs)."""
    n = graph.n_nodes
    pairs = n * (n - 1) / (1 if graph.directed else 2)
    counted = graph.edges.agg(F.count("*").alias("n_edges"), F.count_if(F.col("src") == F.col("dst")).alias("loops"))
    total = F.col("n_edges") if graph.directed else 2 * F.col("n_edges") - F.col("loops")
    return counted.select(F.lit(n).cast("long").alias("n_nodes"), "n_edges", (total / F.lit(float(max(1, n)))).alias("avg_degree"), (F.col("n_edges") / F.lit(float(max(1.0, pairs)))).alias("density"))


def validation_report(graph: Graph) -> DataFrame:
    """One row of counts from one pass: null ends, negative ids, ids past n_nodes, null and non-finite weights."""
    infinite = F.isnan("weight") | (F.abs("weight") == float("inf"))
    return graph.edges.agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("null_ends"),
        F.count_if((F.col("src") < 0) | (F.col("dst") < 0)).alias("negative_ids"),
        F.count_if(F.greatest("src", "dst") >= graph.n_ids).alias("ids_past_n"),
        F.count_if(F.col("weight").isNull()).alias("null_weights"),
        F.count_if(infinite).alias("non_finite_weights"),
    )


def validate(graph: Graph) -> Graph:
    """The graph, or a ValidationError that names what is wrong."""
    if graph.n_nodes < 0:
        raise ValidationError("n_nodes is below 0")
    found = validation_report(graph).first()
    for column, said in (("null_ends", "src or dst is null"), ("negative_ids", "an id is below 0"), ("ids_past_n", "an id is not below n_nodes"), ("null_weights", "a weight is null"), ("non_finite_weights", "a weight is not finite")):
        if found[column]:
            raise ValidationError(f"{said} in {found[column]} rows")
    return graph


def check_node(graph: Graph, node: int) -> int:
    if isinstance(node, bool) or not isinstance(node, Integral) or not 0 <= node < graph.n_ids:
        raise ValidationError(f"{node!r} is no node: ids are whole numbers from 0 to {graph.n_ids - 1}")
    return node
