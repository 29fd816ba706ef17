import numpy as np
import pytest

from meshwork.errors import ValidationError
from meshwork.operators import timeseries

METRICS = {"euclidean": lambda v: float(np.sqrt((v * v).sum())), "manhattan": lambda v: float(np.abs(v).sum()), "maximum": lambda v: float(np.abs(v).max())}


def rows_of(seed):
    r = np.random.default_rng(seed)
    series = {1: r.normal(size=90), 2: r.integers(0, 3, 60).astype(float), 3: np.full(40, 2.5), 4: np.cumsum(r.normal(size=70)) * 50, 5: np.array([1.0]), 6: np.array([1.0, 4.0, 2.0]), 7: np.r_[r.normal(size=50) * 1e-3, 1e6]}
    rows = [(i, t, float(x)) for i, s in series.items() for t, x in enumerate(s)]
    return rows + [(8, 0, 1.0), (8, 1, None), (8, 2, float("nan")), (8, 3, 2.0), (8, 4, 2.5), (8, 5, 2.25)]


def vectors(rows, m, tau):
    by = {}
    for i, t, x in rows:
        by.setdefault(i, {})[t] = np.nan if x is None else x
    out = {}
    for i, s in by.items():
        own = {t: np.array([s[t - tau * d] for d in range(m)]) for t in s if t - tau * (m - 1) >= 0}
        out[i] = {t: v for t, v in own.items() if np.isfinite(v).all()}
    return out


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("m,tau", [(1, 1), (2, 1), (4, 2)])
def test_radius_equals_all_pairs(spark, metric, m, tau):
    rows = rows_of(3)
    df = spark.createDataFrame(rows, "id long, t long, value double")
    for radius in (0.4, 1.0):
        want = {(i, s, t): METRICS[metric](v - w) for i, own in vectors(rows, m, tau).items() for s, v in own.items() for t, w in own.items() if s < t and METRICS[metric](v - w) < radius}
        got = timeseries.recurrence_radius(df, radius, m, tau, metric).collect()
        assert {(r.id, r.i, r.j): pytest.approx(r.distance) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("short", [128, 4])
@pytest.mark.parametrize("metric,m,k", [("euclidean", 2, 3), ("maximum", 1, 2), ("manhattan", 4, 5)])
def test_nearest_equal_all_pairs(spark, monkeypatch, short, metric, m, k):
    """With a small SHORT most series are searched by the grid."""
    monkeypatch.setattr(timeseries, "SHORT", short)
    rows = rows_of(4)
    df = spark.createDataFrame(rows, "id long, t long, value double")
    want = {}
    for i, own in vectors(rows, m, 1).items():
        for s, v in own.items():
            for rank, (d, t) in enumerate(sorted((METRICS[metric](v - w), t) for t, w in own.items() if t != s)[:k]):
                want[i, s, rank + 1] = (t, pytest.approx(d))
    got = timeseries.recurrence_knn(df, m, 1, k, metric).collect()
    assert {(r.id, r.i, r["rank"]): (r.j, r.distance) for r in got} == want and len(got) == len(want)


def test_unknown_metrics_and_radii(spark):
    df = spark.createDataFrame(rows_of(5), "id long, t long, value double")
    with pytest.raises(ValidationError):
        timeseries.recurrence_radius(df, 1.0, metric="other")
    with pytest.raises(ValidationError):
        timeseries.recurrence_radius(df, 0.0)
    assert timeseries.recurrence_radius(df.filter("false"), 1.0).collect() == []
    assert timeseries.recurrence_knn(df.filter("false")).collect() == []
