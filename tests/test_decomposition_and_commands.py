import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwork.cli import main
from meshwork.errors import ValidationError
from meshwork.model import Graph
from meshwork.operators import degree, timeseries, triangles
from meshwork.streaming.degree import windowed_degree


@pytest.mark.parametrize("period", [5, 6])
def test_level_trend_and_season_are_recovered(spark, period):
    t = np.arange(9 * period)
    season = np.arange(period) % 3 - np.mean(np.arange(period) % 3)
    series = {1: 3 + 0.25 * t + season[t % period], 2: np.full(4, 7.0)}
    df = spark.createDataFrame([(i, int(k), float(x)) for i, s in series.items() for k, x in enumerate(s)], "id long, t long, value double").repartition(3)
    found = timeseries.decompose(df, period).orderBy("t").toPandas()
    one = found[found.id == 1].reset_index(drop=True)
    inside = one.trend.notna()
    assert inside.sum() == len(t) - 2 * (period // 2)
    assert np.allclose(one.trend[inside], (3 + 0.25 * t)[inside]) and np.allclose(one.seasonal, season[t % period])
    assert np.allclose(one.residual[inside], 0, atol=1e-9)
    assert found[found.id == 2].trend.isna().all() and len(found) == len(t) + 4
    with pytest.raises(ValidationError):
        timeseries.decompose(df, 1)


def test_decomposition_over_blocks(spark):
    """A block's ends take their values from the blocks beside it."""
    r = np.random.default_rng(2)
    x = r.normal(size=9000)
    df = spark.createDataFrame(pd.DataFrame({"id": 1, "t": np.arange(9000), "value": x}))
    found = timeseries.decompose(df, 12).orderBy("t").toPandas()
    want = np.convolve(x, np.r_[0.5, np.ones(11), 0.5] / 12, mode="valid")
    assert np.allclose(found.trend[6:-6], want) and found.trend.isna().sum() == 12


@pytest.fixture
def edges(tmp_path):
    pd.DataFrame({"u": [0, 1, 2, 2], "v": [1, 2, 0, 3], "w": [1.0, 2.0, 3.0, 4.0]}).to_parquet(tmp_path / "e.parquet")
    return tmp_path


@pytest.mark.parametrize("command,column", [("compute-degree", "degree"), ("compute-pagerank", "pagerank"), ("compute-communities", "community")])
def test_commands(spark, edges, command, column):
    extra = ["--method", "semi_synchronous"] if column == "community" else []
    assert main([command, "--input", str(edges / "e.parquet"), "--out", str(edges / "o"), *extra]) == 0
    found = spark.read.parquet(str(edges / "o"))
    assert sorted(found.columns) == sorted(["node", column]) and found.count() == 4


def test_forms_and_attributes(spark):
    g = Graph.from_tuples(spark, [(0, 1), (1, 2), (2, 3)], 4)
    with pytest.raises(ValidationError):
        degree.adjacency(g, "other")
    own = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 1.0), (3, 2.0)], "node long, value double")
    assert np.isclose(triangles.assortativity(g, own).first()[0], -1.0)


def test_degrees_in_windows(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 0, 1), ("2024-01-01 00:02:00", 1, 1), ("2024-01-01 00:07:00", 0, 2), ("2024-01-01 02:00:00", 5, 6)], "ts string, src long, dst long")
    rows.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, src long, dst long").parquet(str(tmp_path / "in"))
    query = windowed_degree(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination()
    found = spark.table("windows").select(F.date_format("window.start", "HH:mm").alias("s"), "node", "degree").collect()
    assert sorted(map(tuple, found)) == [("00:00", 0, 1), ("00:00", 1, 2), ("00:05", 0, 1), ("00:05", 2, 1)]
