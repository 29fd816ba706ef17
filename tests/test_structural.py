import numpy as np
import pandas as pd
import pytest

from meshwork.errors import ValidationError
from meshwork.operators import structural as st


def frame(spark, series):
    rows = [(i, t, None if v is None else float(v)) for i, s in series.items() for t, v in enumerate(s)]
    return spark.createDataFrame(rows, "id long, t long, value double").repartition(3)


def joint(values, shape, ratios):
    """The states' means and variances given the observed values, from the one Gaussian of all states."""
    step, shocks, seen = shape.matrices(ratios)
    n, d = len(values), shape.size
    cov = np.zeros((n * d, n * d))
    own = st.VAGUE * np.eye(d)
    for k in range(n):
        own = step @ own @ step.T + shocks
        across = own
        for j in range(k, n):
            cov[k * d : k * d + d, j * d : j * d + d] = across
            cov[j * d : j * d + d, k * d : k * d + d] = across.T
            across = across @ step.T
    y = np.array([np.nan if v is None else v for v in values])
    has = np.isfinite(y)
    h = np.kron(np.eye(n), seen)[has]
    gain = np.linalg.solve(h @ cov @ h.T + np.eye(has.sum()), h @ cov).T
    mean = (gain @ y[has]).reshape(n, d)
    spread = (cov - gain @ h @ cov).diagonal().reshape(n, d)
    return mean, spread


@pytest.fixture
def small(monkeypatch):
    """Many blocks, and a tree of three levels."""
    monkeypatch.setattr(st, "BLOCK", 4)
    monkeypatch.setattr(st, "FAN", 3)


@pytest.mark.parametrize("period,slope,season", [(None, None, 0.0), (None, 0.02, 0.0), (4, 0.02, 0.1), (3, None, 0.0)])
def test_states_equal_the_joint_gaussian(spark, small, period, slope, season):
    r = np.random.default_rng(3)
    long = np.cumsum(r.normal(size=45)) + 20
    series = {1: [*long[:20], None, None, *long[22:30], float("nan"), *long[31:]], 2: [5.0], 3: list(r.normal(size=9)), 4: [None, None, 3.0]}
    shape = st.Shape(slope is not None, period)
    found = st.structural(frame(spark, series), period, 0.3, slope, season).orderBy("id", "t").toPandas()
    assert len(found) == sum(map(len, series.values()))
    for i, values in series.items():
        own = found[found.id == i].reset_index(drop=True)
        mean, spread = joint(values, shape, [0.3, slope or 0.0, season])
        assert np.allclose(own.level, mean[:, 0], rtol=1e-4, atol=1e-3)
        assert np.allclose(own.level_spread, spread[:, 0], rtol=1e-3, atol=1e-3)
        assert own.slope.isna().all() if slope is None else np.allclose(own.slope, mean[:, 1], atol=1e-3)
        assert np.allclose(own.seasonal, mean[:, 1 + shape.slope] if period else 0, atol=1e-3)
        y = np.array([np.nan if v is None else v for v in values])
        assert np.allclose((own.level + own.seasonal + own.residual)[np.isfinite(y)], y[np.isfinite(y)]) and own.residual.isna().tolist() == (~np.isfinite(y)).tolist()


def test_blocks_do_not_matter(spark, monkeypatch):
    r = np.random.default_rng(4)
    t = np.arange(700)
    df = spark.createDataFrame(pd.DataFrame({"id": "a", "t": t, "value": 0.05 * t + np.sin(t) + r.normal(size=700)}))
    whole = st.structural(df, 6, 0.1, 0.001, 0.01).orderBy("t").toPandas()
    sums = st.likelihoods(df, 6, 0.1, 0.001, 0.01).first()
    monkeypatch.setattr(st, "BLOCK", 16)
    monkeypatch.setattr(st, "FAN", 4)
    parts = st.structural(df, 6, 0.1, 0.001, 0.01).orderBy("t").toPandas()
    for c in ("level", "slope", "seasonal", "level_spread", "residual"):
        assert np.allclose(whole[c], parts[c], atol=1e-5), c
    assert np.allclose(st.likelihoods(df, 6, 0.1, 0.001, 0.01).first()[1:], sums[1:], rtol=1e-6)


def test_level_trend_and_season_are_recovered(spark):
    t = np.arange(240)
    season = np.array([3.0, -1.0, -4.0, 2.0])
    clean = 10 + 0.5 * t
    noise = np.random.default_rng(5).normal(scale=0.3, size=len(t))
    df = frame(spark, {1: clean + season[t % 4] + noise})
    found = st.structural(df, 4, 0.001, 0.0001, 0.0).orderBy("t").toPandas()
    assert np.abs(found.level - clean).max() < 0.5 and np.abs(found.seasonal - season[t % 4]).max() < 0.15
    assert np.abs(found.slope - 0.5).max() < 0.1 and found.residual.std() < 0.4


def test_ratios_of_greatest_likelihood(spark):
    """A series of pure noise keeps its level, a random walk moves it; the residuals' states come from each series' own ratios."""
    r = np.random.default_rng(6)
    series = {1: r.normal(scale=2.0, size=400), 2: np.cumsum(r.normal(size=400)) + r.normal(scale=0.3, size=400), 3: [1.0], 4: [None, None]}
    df = frame(spark, series)
    candidates = [(q, None, 0.0) for q in (0.0001, 0.1, 10.0)]
    fitted = {x.id: x for x in st.fit_structural(df, candidates).collect()}
    assert fitted[1].level_ratio == 0.0001 and fitted[2].level_ratio == 10.0 and fitted[3].level_ratio == fitted[4].level_ratio == 0.0001
    assert 3 < fitted[1].noise < 5 and fitted[3].log_likelihood is None
    own = st.structural(df, ratios=st.fit_structural(df, candidates)).filter("id = 2").orderBy("t").toPandas()
    same = st.structural(df, level=10.0).filter("id = 2").orderBy("t").toPandas()
    assert np.allclose(own.level, same.level)


def test_edges(spark):
    empty = spark.createDataFrame([], "id long, t long, value double")
    assert st.structural(empty, 4).collect() == [] and st.fit_structural(empty, [(1.0, None, 0.0)]).collect() == []
    for bad in (lambda: st.structural(empty, 1), lambda: st.structural(empty, level=-1.0), lambda: st.fit_structural(empty, []), lambda: st.fit_structural(empty, [(1.0, None, 0.0), (1.0, 1.0, 0.0)])):
        with pytest.raises(ValidationError):
            bad()
