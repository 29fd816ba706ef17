"""Reading edge lists and writing results."""

from __future__ import annotations

import json
from datetime import datetime
from typing import Any
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshwork.errors import ValidationError
from meshwork.model import Graph


def read_edges(spark: SparkSession, source: Any, src_col: str | None = None, dst_col: str | None = None, weight_col: str | None = None, directed: bool = False, n_nodes: int | None = None) -> Graph:
    """A graph from a Parquet, CSV, JSON or ORC path, a Spark or pandas frame, an Arrow table or a 2-D array.

    Columns are projected and cast in the scan's plan, so only they are read. CSV files have a header.
    """
    if isinstance(source, str):
        suffix = source.rstrip("/").rpartition(".")[2].lower()
        if suffix not in ("parquet", "csv", "json", "orc"):
            raise ValidationError(f"no reader for {source}: Parquet, CSV, JSON and ORC are known by their suffix")
        df = spark.read.option("header", True).format(suffix).load(source)
    elif isinstance(source, DataFrame):
        df = source
    elif hasattr(source, "ndim") and hasattr(source, "shape") and not hasattr(source, "columns"):
        if source.ndim != 2 or source.shape[1] < 2:
            raise ValidationError("an array of edges has two or three columns")
        df = spark.createDataFrame(source[:, :3].tolist(), ["src", "dst", "weight"][: min(3, source.shape[1])])
        src_col, dst_col, weight_col = "src", "dst", "weight" if source.shape[1] > 2 else None
    elif hasattr(source, "iloc") or hasattr(source, "to_batches"):
        df = spark.createDataFrame(source)
    elif hasattr(source, "to_arrow"):
        df = spark.createDataFrame(source.to_arrow())
    else:
        raise ValidationError(f"no edges can be read from a {type(source).__name__}")
    if not src_col or not dst_col:
        raise ValidationError("src_col and dst_col are needed for this source")
    picked = [F.col(src_col).cast("long").alias("src"), F.col(dst_col).cast("long").alias("dst")]
    if weight_col:
        picked.append(F.col(weight_col).cast("double").alias("weight"))
    # where the last of parallel edges wins, order is that of the rows of the source's partitions
    return Graph.of(df.select(*picked, F.monotonically_increasing_id().alias("eid")), n_nodes, directed, bool(weight_col))


def write_vector(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A node vector or any other result, as files."""
    df.write.mode("overwrite").format(fmt).save(path)


def write_graph(graph: Graph, path: str) -> None:
    """Edges and metadata, for :func:`read_graph`."""
    graph.edges.write.mode("overwrite").parquet(f"{path}/edges")
    meta = json.dumps({"n_nodes": graph.n_nodes, "directed": graph.directed, "weighted": graph.weighted})
    graph.spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_graph(spark: SparkSession, path: str) -> Graph:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return Graph(spark.read.parquet(f"{path}/edges"), **meta)


def read_series(
    source: str | DataFrame, spark: SparkSession | None = None, id_col: str = "id", time_col: str = "ts", value_col: str = "value",
    start: str | datetime | None = None, end: str | datetime | None = None, tz: str = "UTC", ids: list | None = None, unit: str | None = None, how: str = "mean",
) -> DataFrame:
    """(id, t, ts, value): series of a Parquet path or a frame, from ``start`` on and before ``end``, t = 0, 1, ... in order of time.

    Bounds without a time zone are in ``tz``. They and ``ids`` are compared with the stored columns themselves, so the scan skips what
    lies outside. With ``unit`` values are first aggregated by that calendar unit of ``tz``, see :func:`resample`. Rows
    with a null in any of the three columns are left out; of equal times the smaller value comes first.
    """
    if isinstance(source, str):
        if spark is None:
            raise ValidationError("a path needs a session")
        source = spark.read.parquet(source)
    try:
        zone = ZoneInfo(tz)
        bounds = [None if x is None else x if isinstance(x, datetime) else datetime.fromisoformat(x) for x in (start, end)]
    except (ZoneInfoNotFoundError, ValueError) as e:
        raise ValidationError(f"no time: {e}") from e
    low, high = [None if x is None else x if x.tzinfo else x.replace(tzinfo=zone) for x in bounds]
    if low and high and low >= high:
        raise ValidationError("a range starts before it ends")
    rows = source.filter(F.col(id_col).isNotNull() & F.col(time_col).isNotNull() & F.col(value_col).isNotNull())
    # whole seconds and microseconds of the instant: a literal of a local time would depend on the session's zone
    instant = lambda x: F.timestamp_micros(F.lit(int(x.timestamp()) * 1_000_000 + x.microsecond))
    if low:
        rows = rows.filter(F.col(time_col) >= instant(low))
    if high:
        rows = rows.filter(F.col(time_col) < instant(high))
    if ids is not None:
        rows = rows.filter(F.col(id_col).isin(ids))
    rows = rows.select(F.col(id_col).alias("id"), F.col(time_col).alias("ts"), F.col(value_col).cast("double").alias("value"))
    if unit:
        local = rows.withColumn("ts", F.convert_timezone(F.lit(rows.sparkSession.conf.get("spark.sql.session.timeZone")), F.lit(tz), F.col("ts").cast("timestamp_ntz")))
        rows = resample(local, unit, how).withColumnRenamed("t", "ts")
    order = Window.partitionBy("id").orderBy("ts", "value")
    return rows.select("id", (F.row_number().over(order) - 1).cast("long").alias("t"), "ts", "value")


def resample(df: DataFrame, unit: str, how: str = "mean") -> DataFrame:
    """(id, t, value): a series table (id, ts, value) by calendar unit; how is mean, sum, max or min."""
    if how not in ("mean", "sum", "max", "min"):
        raise ValidationError(f"Unknown aggregate: {how}")
    return df.groupBy("id", F.date_trunc(unit, "ts").alias("t")).agg(getattr(F, how)("value").alias("value"))
