import numpy as np
import pytest

from meshwork.operators import timeseries


def series_of(seed):
    r = np.random.default_rng(seed)
    return {
        1: r.normal(size=130), 2: r.integers(0, 4, 90).astype(float), 3: np.arange(70.0), 4: -np.arange(70.0), 5: np.full(30, 2.0), 6: np.array([1.0]),
        7: -((np.arange(60.0) - 20) ** 2), 8: (np.arange(40.0) - 13) ** 2, 9: np.r_[5.0, r.random(100), 5.0, r.random(60), 7.0], 10: np.cumsum(r.normal(size=120)),
    }


def frame(spark, series):
    return spark.createDataFrame([(i, t, float(x)) for i, s in series.items() for t, x in enumerate(s)], "id long, t long, value double").repartition(3)


def got(df):
    rows = [(r.id, r.i, r.j) for r in df.collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def horizontal(series):
    return {(k, i, j) for k, s in series.items() for i in range(len(s)) for j in range(i + 1, len(s)) if max(s[i + 1 : j], default=-np.inf) < min(s[i], s[j])}


def natural(series):
    out = set()
    for k, s in series.items():
        for i in range(len(s)):
            steepest = -np.inf
            for j in range(i + 1, len(s)):
                if (slope := (s[j] - s[i]) / (j - i)) >= steepest:
                    out.add((k, i, j))
                    steepest = slope
    return out


@pytest.mark.parametrize("fan", [64, 4])
def test_horizontal_over_blocks(spark, monkeypatch, fan):
    monkeypatch.setattr(timeseries, "FAN", fan)
    series = series_of(1)
    assert got(timeseries.hvg_edges(frame(spark, series))) == horizontal(series)
    assert timeseries.hvg_edges(frame(spark, series).filter("false")).collect() == []


@pytest.mark.parametrize("stretch", [4096, 16])
def test_natural_without_a_limit(spark, monkeypatch, stretch):
    monkeypatch.setattr(timeseries, "STRETCH", stretch)
    series = {k: np.round(s, 3) for k, s in series_of(2).items() if stretch > 100 or k not in (3, 4, 8)}
    assert got(timeseries.nvg_edges(frame(spark, series))) == natural(series)


def test_series_that_hardly_fall_apart(spark, monkeypatch):
    """What is left after the last round goes the limited way, pair by pair."""
    monkeypatch.setattr(timeseries, "STRETCH", 8)
    series = {1: np.arange(40.0), 2: (np.arange(40.0) - 13) ** 2, 3: np.random.default_rng(3).normal(size=50)}
    assert got(timeseries._divided(frame(spark, series), most_rounds=3)) == natural(series)
    df = frame(spark, series)
    assert got(timeseries.nvg_edges(df, 50)) == natural(series)


def test_points_on_a_line_see_each_other_from_either_end(spark):
    """Decimal values of a line: slopes from its high end are rounded otherwise than those from its low one."""
    line = [round(0.1 + 0.37 * k, 2) for k in range(40)]
    for values in (line, line[::-1]):
        series = spark.createDataFrame([(1, t, v) for t, v in enumerate(values)], "id long, t long, value double")
        assert timeseries.nvg_edges(series).count() == 40 * 39 // 2
