"""PageRank along stored edges, parallel edges counted, mass of nodes without outgoing edges dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.model import Graph
from meshwork.plans.fixpoint import dealt, materialised


def pagerank(graph: Graph, alpha: float = 0.85, tol: float | None = 1e-6, max_iter: int = 200, dangling: str = "drop") -> DataFrame:
    """(node, pagerank).

    Edges are followed as stored, whatever the graph's orientation. Stops when the Euclidean change is below
    ``tol`` and then returns the state before it; with ``tol`` None all ``max_iter`` rounds are made. ``dangling``
    may be "redistribute" to spread the lost mass evenly.
    """
    n = max(1, graph.n_nodes)
    # the edges' own plan runs once: out-degrees add up the counted arcs
    counted = materialised(graph.edges.groupBy("src", "dst").agg(F.count("*").alias("m")))
    by_src = dealt(counted, "src", graph.n_nodes)
    out = counted.groupBy("src").agg(F.sum("m").alias("out"))
    arcs = by_src(counted).join(by_src(out), "src")
    arcs = materialised(arcs.select("src", "dst", (F.col("m") / F.col("out")).alias("share")))
    ranks = graph.vertices.withColumn("pagerank", F.lit(1.0 / n))
    for k in range(1, max_iter + 1):
        sent = by_src(arcs).join(by_src(ranks.withColumnRenamed("node", "src")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum(F.col("share") * F.col("pagerank")).alias("got"))
        base = F.lit((1 - alpha) / n)
        if dangling == "redistribute":
            lost = ranks.join(out.withColumnRenamed("src", "node"), "node", "left_anti").agg(F.coalesce(F.sum("pagerank"), F.lit(0.0))).first()[0]
            base = base + F.lit(alpha * lost / n)
        after = ranks.join(sent, "node", "left").select("node", (base + alpha * F.coalesce("got", F.lit(0.0))).alias("pagerank"))
        if tol is None:
            ranks = materialised(after) if k % 5 == 0 else after
            continue
        after = materialised(after)
        change = after.join(ranks.withColumnRenamed("pagerank", "old"), "node").agg(F.sqrt(F.sum((F.col("pagerank") - F.col("old")) ** 2))).first()[0]
        if (change or 0.0) < tol:
            return ranks
        ranks = after
    return ranks
