"""Degrees over a stream of edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ends(directed: bool) -> Column:
    return F.explode(F.array("src") if directed else F.when(F.col("src") == F.col("dst"), F.array("src")).otherwise(F.array("src", "dst")))


def streaming_degree(edges: DataFrame, directed: bool = False) -> DataFrame:
    """(node, degree) of all edges so far (update or complete mode); an undirected self-loop counts once."""
    return edges.select(_ends(directed).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def windowed_degree(edges: DataFrame, time: str = "ts", every: str = "5 minutes", late: str = "10 minutes", directed: bool = False) -> DataFrame:
    """(window, node, degree) in tumbling windows; edges later than the watermark are dropped (append mode)."""
    own = edges.withWatermark(time, late).select(time, _ends(directed).alias("node"))
    return own.groupBy(F.window(time, every), "node").agg(F.count("*").alias("degree"))
