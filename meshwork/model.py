"""The graph handle: an edge table with its orientation, and the shapes that operators read it in.

Edges have columns src, dst (long), weight (double) and eid (long, the input order where it matters).
Node ids are 0 .. n_nodes - 1; nodes without edges exist through ``n_nodes``. Undirected edges are
stored once, in either orientation; parallel edges and self-loops are kept.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from numbers import Integral

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.errors import ValidationError
from meshwork.plans.fixpoint import materialised

EDGE_SCHEMA = "src long, dst long, weight double, eid long"


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n_nodes: int
    directed: bool = False
    weighted: bool = False
    nodes: DataFrame | None = None  # of a view: its nodes (column node), whose ids are those of the whole graph
    id_bound: int | None = None  # of a view: the whole graph's n_nodes
    plain: bool = False  # the edges are known to be their own simple projection, src < dst

    @classmethod
    def of(cls, edges: DataFrame, n_nodes: int | None = None, directed: bool = False, weighted: bool = False) -> Graph:
        """A graph of any frame with src and dst; without ``n_nodes`` the greatest id decides (one aggregate)."""
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
        eid = F.col("eid").cast("long") if "eid" in edges.columns else F.lit(None).cast("long")
        own = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), weight.alias("weight"), eid.alias("eid"))
        if n_nodes is None:
            top = own.agg(F.max(F.greatest("src", "dst")).alias("m")).first()["m"]
            if top is None:
                raise ValidationError("n_nodes can't be inferred from no edges")
            n_nodes = top + 1
        return cls(own, int(n_nodes), directed, weighted)

    @classmethod
    def from_tuples(cls, spark: SparkSession, rows: Iterable[tuple], n_nodes: int | None = None, directed: bool = False, weighted: bool = False) -> Graph:
        rows = list(rows)
        if any(len(r) not in (2, 3) for r in rows) or weighted and any(len(r) != 3 for r in rows):
            raise ValidationError("edges are (src, dst), or (src, dst, weight) in a weighted graph")
        for r in rows:
            for end in r[:2]:
                if isinstance(end, bool) or not isinstance(end, Integral) or end < 0 or n_nodes is not None and end >= n_nodes:
                    raise ValidationError(f"{end!r} is no node id: ids are whole numbers from 0, below n_nodes")
        full = [(int(r[0]), int(r[1]), float(r[2]) if len(r) == 3 else 1.0, k) for k, r in enumerate(rows)]
        return cls.of(spark.createDataFrame(full, EDGE_SCHEMA), n_nodes, directed, weighted)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        """(node): all nodes, those without edges too."""
        return self.spark.range(self.n_nodes).withColumnRenamed("id", "node") if self.nodes is None else self.nodes

    @property
    def n_ids(self) -> int:
        """All ids are below this: n_nodes, but for a view."""
        return self.n_nodes if self.id_bound is None else self.id_bound

    def stored(self) -> Graph:
        """The same graph, its edges' plan run once: for operators that read them more than once."""
        return replace(self, edges=materialised(self.edges))

    def n_edges(self) -> int:
        return self.edges.count()

    def symmetric(self) -> DataFrame:
        """(src, dst, weight): both directions of every edge, a self-loop once."""
        own = self.edges.select("src", "dst", "weight")
        return own.unionByName(own.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))

    def simple(self) -> DataFrame:
        """(a, b), a < b: the undirected projection without loops and multiplicity."""
        if self.plain:
            return self.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        return self.edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def neighbours(self) -> DataFrame:
        """(node, other): the simple projection in both directions."""
        own = self.simple()
        return own.select(F.col("a").alias("node"), F.col("b").alias("other")).union(own.select("b", "a"))

    def view(self, mask: DataFrame) -> Graph:
        """The subgraph induced by the nodes in ``mask`` (column node). Ids stay; n_nodes is the number of nodes in the mask (one count)."""
        own = mask.select(F.col("node").cast("long").alias("node")).join(self.vertices, "node", "left_semi").distinct()
        kept = self.edges.join(own.withColumnRenamed("node", "src"), "src", "left_semi").join(own.withColumnRenamed("node", "dst"), "dst", "left_semi")
        return Graph(kept.select("src", "dst", "weight", "eid"), own.count(), self.directed, self.weighted, own, self.n_ids, self.plain)

    def to_pandas_edges(self, max_rows: int = 200_000):
        """The edges on the driver, for other libraries; refuses to collect more than ``max_rows``."""
        if self.edges.limit(max_rows + 1).count() > max_rows:
            raise ValidationError(f"more than {max_rows} edges: raise max_rows to collect them")
        return self.edges.select("src", "dst", "weight").toPandas()

    def dense(self, values: DataFrame, column: str, default) -> DataFrame:
        """(node, column) for every node, ``default`` where ``values`` has none."""
        return self.vertices.join(values, "node", "left").select("node", F.coalesce(F.col(column), F.lit(default)).alias(column))
