"""Graphs and series made from the driver's relational tables."""

from __future__ import annotations

from dataclasses import replace
from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwork.model import Graph

#: Line items of one task, about.
LINES_A_TASK = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks_of(lines: DataFrame) -> int:
    """How many tasks share line items, so that none gets more as there are more of them (one count, from the files' footers)."""
    return max(lines.sparkSession.sparkContext.defaultParallelism, ceil(lines.count() / LINES_A_TASK))


def n_parts(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "part").agg(F.max("p_partkey")).first()[0] + 1


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected and simple: two parts on one order."""
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_of(lines)
    items = lines.select("l_orderkey", "l_partkey").repartition(tasks, "l_orderkey").distinct()
    pairs = items.alias("x").join(items.alias("y"), "l_orderkey").filter("x.l_partkey < y.l_partkey")
    edges = pairs.select(F.col("x.l_partkey").alias("src"), F.col("y.l_partkey").alias("dst")).repartition(tasks, "src", "dst").distinct()
    return replace(Graph.of(edges, n_parts(spark, sf_dir)), plain=True)


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Directed, weighted multigraph: customer nation to supplier nation, an edge for each line item."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem")
    tasks = tasks_of(lines)
    # orders meet their customers before the items, whose tasks hold their own orders alone
    orders = orders.join(customers, orders.o_custkey == customers.c_custkey).select("o_orderkey", "c_nationkey").repartition(tasks, "o_orderkey").hint("merge")
    items = lines.select("l_orderkey", "l_suppkey", "l_extendedprice").repartition(tasks, "l_orderkey")
    rows = items.join(orders, items.l_orderkey == orders.o_orderkey).join(suppliers, items.l_suppkey == suppliers.s_suppkey)
    n = table(spark, sf_dir, "nation").agg(F.max("n_nationkey")).first()[0] + 1
    return Graph.of(rows.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), F.col("l_extendedprice").alias("weight")), n, directed=True, weighted=True)


def part_supplier(spark: SparkSession, sf_dir: str) -> Graph:
    """Undirected bipartite multigraph: an edge for each line item; suppliers come after the parts."""
    parts = n_parts(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst"))
    return Graph.of(edges, parts + suppliers)


def supply_costs(spark: SparkSession, sf_dir: str) -> Graph:
    """As :func:`part_supplier`, weighted by the items' extended prices."""
    parts = n_parts(spark, sf_dir)
    suppliers = table(spark, sf_dir, "supplier").agg(F.max("s_suppkey")).first()[0] + 1
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + parts).alias("dst"), F.col("l_extendedprice").alias("weight"))
    return Graph.of(edges, parts + suppliers, weighted=True)


def event_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, t, value): the events of each user in order of time, t from zero."""
    from pyspark.sql import Window

    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), (F.row_number().over(order) - 1).cast("long").alias("t"), "value")
