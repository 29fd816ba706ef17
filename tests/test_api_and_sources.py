from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meshwork import api
from meshwork.errors import ValidationError
from meshwork.model import Graph
from meshwork.operators import nulls
from meshwork.sources.edges import read_series

EDGES = [(0, 1, 0.5), (1, 2, 1.5), (2, 0, 2.0), (2, 3, 1.0)]


def vector(df):
    return [r[1] for r in sorted(map(tuple, df.collect()))]


def test_operators_take_any_source(spark, tmp_path):
    frame = pd.DataFrame(EDGES, columns=["u", "v", "w"])
    table = spark.createDataFrame(frame)
    table.write.parquet(str(tmp_path / "e.parquet"))
    table.write.option("header", True).csv(str(tmp_path / "e.csv"))
    named = {"src_col": "u", "dst_col": "v"}
    for source, columns in ((str(tmp_path / "e.parquet"), named), (str(tmp_path / "e.csv"), named), (table, named), (frame, named), (np.array([e[:2] for e in EDGES]), {}), (Graph.from_tuples(spark, [e[:2] for e in EDGES]), {})):
        assert vector(api.compute("degree", source, **columns)) == [2, 2, 3, 1]
    assert vector(api.compute("strength", frame, weight_col="w", **named)) == [2.5, 2.0, 4.5, 1.0]
    assert vector(api.compute("shortest_paths", frame, 3, directed=False, **named)) == [2, 2, 1, 0]
    assert vector(api.compute("shortest_paths", frame, 3, weight_col="w", weighted=True, validated=True, **named)) == [3.0, 2.5, 1.0, 0.0]
    assert vector(api.compute("centrality", frame, "betweenness", n_nodes=5, **named)) == [0, 0, 2, 0, 0]
    assert len(set(vector(api.compute("communities", frame, "label_propagation", **named)))) <= 2


def test_sources_that_are_refused(spark):
    with pytest.raises(ValidationError, match="Unknown operator"):
        api.compute("none", EDGES)
    with pytest.raises(ValidationError):
        api.compute("degree", Graph.from_tuples(spark, [(0, 1)]), directed=True)
    with pytest.raises(ValidationError):
        api.compute("degree", pd.DataFrame(EDGES))
    with pytest.raises(ValidationError):
        api.compute("degree", pd.DataFrame([(0, -1)], columns=["u", "v"]), src_col="u", dst_col="v", n_nodes=2, validated=True)
    with pytest.raises(ValidationError):
        api.compute("degree", object())


def test_polars_like_frames(spark):
    class Frame:
        def to_arrow(self):
            import pyarrow as pa

            return pa.table({"u": [0, 1], "v": [1, 2]})

    assert vector(api.compute("degree", Frame(), src_col="u", dst_col="v")) == [1, 2, 1]


def series(spark):
    at = datetime(2024, 3, 30, 21, tzinfo=timezone.utc)
    rows = [(k % 2, at + timedelta(hours=k), float(k)) for k in range(12)] + [(None, at, 1.0), (0, None, 2.0), (1, at, None)]
    return spark.createDataFrame(rows, "id long, ts timestamp, value double")


def test_series_of_a_range_are_pushed_down(spark, tmp_path):
    series(spark).write.parquet(str(tmp_path / "s"))
    found = read_series(str(tmp_path / "s"), spark, start="2024-03-31T00:00", end="2024-03-31T04:00", ids=[0, 7])
    assert [tuple(r)[:2] + (r.value,) for r in found.orderBy("t").collect()] == [(0, 0, 4.0), (0, 1, 6.0)]
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan and "In(id" in plan
    # the same bounds as local times of a zone two hours ahead
    other = read_series(str(tmp_path / "s"), spark, start="2024-03-31T02:00", end=datetime(2024, 3, 31, 4, tzinfo=timezone.utc), tz="Africa/Cairo", ids=[0])
    assert [r.value for r in other.orderBy("t").collect()] == [4.0, 6.0]


def test_series_by_local_days(spark):
    days = read_series(series(spark), unit="day", how="sum", tz="Asia/Tokyo")
    assert sorted((r.id, r.t, r.ts.isoformat(), r.value) for r in days.collect()) == [(0, 0, "2024-03-31T00:00:00", 30.0), (1, 0, "2024-03-31T00:00:00", 36.0)]
    assert read_series(series(spark)).count() == 12


def test_series_arguments(spark):
    for wrong in ({"tz": "No/Where"}, {"start": "yesterday"}, {"start": "2024-02-01", "end": "2024-01-01"}):
        with pytest.raises(ValidationError):
            read_series(series(spark), **wrong)
    with pytest.raises(ValidationError):
        read_series("path")


def test_bootstrap_of_a_python_function(spark):
    data = spark.createDataFrame([(float(k),) for k in range(1, 12)] + [(None,)], "x double")
    own = nulls.bootstrap(data, "x", nulls.of_each_resample(np.mean), 60, seed=3).first()
    plain = nulls.bootstrap(data, "x", F.avg, 60, seed=3).first()
    assert np.allclose(own, plain) and own.statistic == 6.0 and own.n_bootstrap == 60
    trimmed = nulls.bootstrap(data, "x", nulls.of_each_resample(lambda v: np.sort(v)[2:-2].mean()), 60).first()
    assert trimmed.statistic == 6.0 and trimmed.low <= trimmed.mean <= trimmed.high
