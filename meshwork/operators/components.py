"""Weakly connected components: least-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshwork.model import Graph
from meshwork.plans.fixpoint import dealt, discard, iterate, materialised

#: Edges for each node that the first rounds go over, about.
EDGES_A_NODE = 4


def roots(graph: Graph) -> DataFrame:
    """(node, root): the least node of each node's component.

    A round takes the least label around, then the label of that label, so long chains halve. Of a dense graph the rounds go over a share of
    the edges, about ``EDGES_A_NODE`` for each node, which leaves most nodes in one component; all other edges then count by the
    components at their ends, and rounds go over those that join two. Only nodes outside the largest component need to be looked up for that.
    """
    edges = materialised(graph.simple())
    share = edges.count() // (EDGES_A_NODE * max(1, graph.n_nodes))
    if share < 2:
        return _rounds(graph.vertices, edges)
    few = edges.filter(F.pmod(F.xxhash64("a", "b"), F.lit(share)) == 0)
    labels = _rounds(graph.vertices, few)
    top = labels.groupBy("root").agg(F.count("*").alias("n")).agg(F.max_by("root", F.struct("n", "root"))).first()[0]
    outside = materialised(labels.filter(F.col("root") != top))
    ends = lambda c: outside.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    at = lambda c: F.coalesce(f"root_{c}", F.lit(top))
    joins = edges.join(ends("a"), "a", "left").join(ends("b"), "b", "left").filter(at("a") != at("b"))
    joins = materialised(joins.select(F.least(at("a"), at("b")).alias("a"), F.greatest(at("a"), at("b")).alias("b")).distinct())
    heads = joins.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    joined = _rounds(heads, joins).select(F.col("node").alias("root"), F.col("root").alias("least"))
    found = materialised(labels.join(joined, "root", "left").select("node", F.coalesce("least", "root").alias("root")))
    for table in (edges, labels, outside, joins):
        discard(table)
    return found


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) of ``nodes`` (node) and stored ``edges`` (a, b) among them."""
    arcs = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
    by_other = dealt(arcs, "other", nodes.count())

    def step(labels: DataFrame) -> DataFrame:
        near = by_other(arcs).join(by_other(labels.select(F.col("node").alias("other"), "root")), "other").groupBy("node").agg(F.min("root").alias("near"))
        hooked = labels.join(near, "node", "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        # read back: with two plain shuffles, the nodes that share a root are a skewed partition that can be split
        hooked = materialised(hooked)
        jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("further"))
        return hooked.join(jump, "root").select("node", F.col("further").alias("root"))

    total = lambda df: df.agg(F.sum("root")).first()[0]  # noqa: E731  labels only fall
    _, labels, _ = iterate(nodes.withColumn("root", F.col("node")), step, lambda a, b: total(a) == total(b))
    return labels


def components(graph: Graph) -> DataFrame:
    """(node, component): labels 0 .. k - 1 in order of each component's least node."""
    labels = roots(graph)
    # ranks over the distinct roots: by ranges, so that no window sees them all
    heads = labels.filter("node = root").select("root")
    size = max(1, graph.n_ids // 64)
    block = F.floor(F.col("root") / size)
    before = heads.groupBy(block.alias("block")).agg(F.count("*").alias("n"))
    before = before.select("block", F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("block").orderBy("root")) - 1
    ranked = heads.withColumn("block", block).withColumn("own", own).join(before, "block").select("root", (F.col("own") + F.col("before")).cast("long").alias("component"))
    return labels.join(ranked, "root").select("node", "component")


def component_count(graph: Graph) -> DataFrame:
    return roots(graph).agg(F.count_if(F.col("node") == F.col("root")).alias("n_components"))
