"""Structural time series: level, slope and season by a state-space filter and smoother over blocks of a series.

The model of a series y at t = 0, 1, ... is y = level + season + noise; the level moves by the slope and a shock, the slope by a shock, and
a season's effects sum to a shock over each period. A block of ``BLOCK`` points becomes one element: how the state
at its end, and the likelihood of its values, depend on the state before it. Elements of neighbours join into one, so
states are carried over a tree of elements with ``FAN`` below each node, forwards for the filter and backwards for the smoother. A series of any
length is many rows in many tasks, and no row holds more than ``BLOCK`` points or ``FAN`` elements.

Variances are ratios to that of the noise, which the likelihood gives in closed form. Values that are null or not finite are
not observed: they get a state, and no residual. Points are rows t = 0, 1, ... without gaps; rows of equal id and t are an error of the caller.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.errors import ValidationError
from meshwork.plans.fixpoint import discard, materialised

BLOCK = 1024
FAN = 64
#: Points that a file of blocks, and so a task, has about: a point costs far more work than bytes.
TASK_POINTS = 20_000
#: Variance of the state before the first point, as a ratio: nothing is known of it.
VAGUE = 1e6
ARROW = {"long": pa.int64(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


class Shape(NamedTuple):
    """Which parts the state has: the level, the slope if any, and the effects of a period's latest places."""

    slope: bool
    period: int | None

    @property
    def size(self) -> int:
        return 1 + self.slope + ((self.period - 1) if self.period else 0)

    def matrices(self, ratios: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The step of a state, the variances of its shocks, and what of it is observed."""
        n, first = self.size, 1 + self.slope
        step, shocks, seen = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
        step[0, :first] = 1.0
        shocks[0, 0], seen[0] = ratios[0], 1.0
        if self.slope:
            step[1, 1], shocks[1, 1] = 1.0, ratios[1]
        if self.period:
            step[first, first:] = -1.0
            step[range(first + 1, n), range(first, n - 1)] = 1.0
            shocks[first, first], seen[first] = ratios[2], 1.0
        return step, shocks, seen


def _filtered(shape: Shape, ratios: list[float], values: np.ndarray, mean: np.ndarray, spread: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float, float, np.ndarray]]:
    """For each point: the state's mean and variance once it is seen, how far the value was off and with what variance, and the gain (nan, nan and zeros where it is not observed).

    ``mean`` may have columns: it is carried along for all of them, values are for the first.
    """
    step, shocks, seen = shape.matrices(ratios)
    for y in values:
        mean, spread = step @ mean, step @ spread @ step.T + shocks
        if np.isfinite(y):
            towards = spread @ seen
            s = seen @ towards + 1.0
            off = y - seen @ mean
            keep = np.eye(len(seen)) - np.outer(towards / s, seen)
            # the form that stays symmetric and positive
            mean, spread = mean + towards / s * off, keep @ spread @ keep.T + np.outer(towards, towards) / s**2
            yield mean, spread, float(off), float(s), keep
        else:
            yield mean, spread, np.nan, np.nan, np.eye(len(seen))


def _forward(shape: Shape, ratios: list[float], values: np.ndarray) -> list[np.ndarray]:
    """A block's element: after = a @ before + b with variance c, and the values' information (e, j) on the state before."""
    n = shape.size
    step, _, seen = shape.matrices(ratios)
    a, b, e, j = np.eye(n), np.zeros(n), np.zeros(n), np.zeros((n, n))
    c = np.zeros((n, n))
    for b, c, off, s, keep in _filtered(shape, ratios, values, b, c):
        a = step @ a
        if np.isfinite(off):
            told = seen @ a
            e, j = e + told * off / s, j + np.outer(told, told) / s
            a = keep @ a
    return [a, b, c, e, j]


def _joined(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """The element of a stretch and the one behind it."""
    (a, b, c, e, j), (a2, b2, c2, e2, j2) = one, two
    between = np.linalg.inv(np.eye(len(b)) + c @ j2)
    back = a.T @ between.T
    return [a2 @ between @ a, a2 @ between @ (b + c @ e2) + b2, a2 @ between @ c @ a2.T + c2, back @ (e2 - j2 @ b) + e, back @ j2 @ a + j]


def _behind(state: list[np.ndarray], part: list[np.ndarray]) -> list[np.ndarray]:
    """The state (mean, variance) behind a stretch of that element."""
    (mean, spread), (a, b, c, e, j) = state, part
    between = np.linalg.inv(np.eye(len(mean)) + spread @ j)
    return [a @ between @ (mean + spread @ e) + b, a @ between @ spread @ a.T + c]


def _smoothers(shape: Shape, ratios: list[float], states: list[tuple[np.ndarray, np.ndarray]], last: bool) -> Iterator[list[np.ndarray]]:
    """For each point from the last back: smoothed = e @ (smoothed one after) + g, with variance l besides."""
    step, shocks, _ = shape.matrices(ratios)
    for k in range(len(states) - 1, -1, -1):
        mean, spread = states[k]
        if last and k == len(states) - 1:
            yield [np.zeros_like(spread), mean, spread]
            continue
        e = np.linalg.solve(step @ spread @ step.T + shocks, step @ spread).T
        yield [e, mean - e @ step @ mean, spread - e @ step @ spread]


def _joined_back(one: list[np.ndarray], two: list[np.ndarray]) -> list[np.ndarray]:
    """The smoother of a stretch and the one before it."""
    (e, g, v), (e2, g2, v2) = one, two
    return [e2 @ e, e2 @ g + g2, e2 @ v @ e2.T + v2]


def _before(state: list[np.ndarray], part: list[np.ndarray]) -> list[np.ndarray]:
    (mean, spread), (e, g, v) = state, part
    return [e @ mean + g, e @ spread @ e.T + v]


def _packed(parts: list[np.ndarray]) -> list[float]:
    return np.concatenate([p.ravel() for p in parts]).tolist()


def _unpacked(numbers: list[float], n: int, kinds: str) -> list[np.ndarray]:
    """Matrices (m) and vectors (v) of size ``n`` that :func:`_packed` put in one list."""
    out, at = [], 0
    for kind in kinds:
        size = n * n if kind == "m" else n
        out.append(np.array(numbers[at : at + size]).reshape((n, n) if kind == "m" else n))
        at += size
    return out


def _mapped(df: DataFrame, work: Callable[..., dict], **made: str) -> DataFrame:
    """``work`` on every row (its columns but id and node as arguments); the columns ``made`` follow id and node."""
    named = [c for c in df.columns if c not in ("id", "node")]
    schema = ", ".join(f"{c} {kind}" for c, kind in made.items())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [work(**dict(zip(named, row))) for row in zip(*[batch.column(c).to_pylist() for c in named])]
            if found:
                yield pa.record_batch({"id": batch.column("id"), "node": batch.column("node")} | {c: pa.array([f[c] for f in found], ARROW[kind]) for c, kind in made.items()})

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, node long, {schema}")


def _entering(parts: DataFrame, n: int, start: list[float], back: bool) -> DataFrame:
    """(id, node, state) before each part of (id, node, part), or behind it where states go ``back``: up the tree of elements, and down again."""
    kinds = "mvm" if back else "mvmvm"
    join, move = (_joined_back, _before) if back else (_joined, _behind)

    def in_order(items: list[dict]) -> list[dict]:
        return sorted(items, key=lambda i: i["node"], reverse=back)

    def fold(items: list[dict]) -> dict:
        return {"part": _packed(reduce(join, [_unpacked(i["part"], n, kinds) for i in in_order(items)]))}

    def carry(items: list[dict], state: list[float]) -> dict:
        now, out = _unpacked(state, n, "vm"), []
        for i in in_order(items):
            out.append(_packed(now))
            now = move(now, _unpacked(i["part"], n, kinds))
        return {"at": [i["node"] for i in in_order(items)], "states": out}

    top = parts.agg(F.max("node")).first()[0]
    if not top:
        return parts.select("id", "node", F.array(*[F.lit(x) for x in start]).alias("state"))
    groups = materialised(parts.groupBy("id", F.floor(F.col("node") / FAN).alias("node")).agg(F.collect_list(F.struct("node", "part")).alias("items")))
    above = _entering(materialised(_mapped(groups, fold, part="array<double>")), n, start, back)
    below = _mapped(groups.join(above, ["id", "node"]), carry, at="array<long>", states="array<array<double>>")
    return below.select("id", F.explode(F.arrays_zip("at", "states")).alias("s")).select("id", F.col("s.at").alias("node"), F.col("s.states").alias("state"))


def _blocks(series: DataFrame, ratios: DataFrame | list[float], shape: Shape) -> tuple[DataFrame, int]:
    """(id, node, values, ratios, last), a row for each block of a series, stored; and in how many tasks they are worked on."""
    own = series.select("id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    rows = own.groupBy("id", F.floor(F.col("t") / BLOCK).alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "value"))), lambda p: p["value"]).alias("values"))
    ends = own.groupBy("id").agg(F.floor(F.max("t") / BLOCK).alias("end"))
    rows = rows.join(ends, "id").select("id", "node", "values", (F.col("node") == F.col("end")).alias("last"))
    if isinstance(ratios, DataFrame):
        rows = rows.join(ratios.select("id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("level_ratio", "slope_ratio", "season_ratio")]).alias("ratios")), "id")
    else:
        rows = rows.withColumn("ratios", F.array(*[F.lit(float(x)) for x in ratios]))
    n_tasks = max(1, -(-own.count() // TASK_POINTS))
    return materialised(rows.repartition(n_tasks, "id", "node")), n_tasks


def _observed(values: list) -> np.ndarray:
    return np.array([np.nan if v is None else v for v in values], dtype=np.float64)


def _checked(period: int | None, *ratios: float) -> None:
    if period is not None and period < 2:
        raise ValidationError("a period has two points or more")
    if any(not 0 <= r < float("inf") for r in ratios):
        raise ValidationError("ratios of variances are finite and not below zero")


def _with_states(series: DataFrame, ratios: DataFrame | list[float], shape: Shape) -> tuple[DataFrame, int]:
    """The blocks with the filter's state before each, stored; and in how many tasks they are worked on."""
    n = shape.size
    blocks, n_tasks = _blocks(series, ratios, shape)

    def element(values: list, ratios: list[float]) -> dict:
        return {"part": _packed(_forward(shape, ratios, _observed(values)))}

    parts = materialised(_mapped(blocks.select("id", "node", "values", "ratios"), element, part="array<double>"))
    start = _packed([np.zeros(n), VAGUE * np.eye(n)])
    found = materialised(blocks.join(_entering(parts, n, start, False), ["id", "node"]).repartition(n_tasks, "id", "node"))
    discard(parts)
    discard(blocks)
    return found, n_tasks


def structural(series: DataFrame, period: int | None = None, level: float = 0.1, slope: float | None = None, season: float = 0.0, ratios: DataFrame | None = None) -> DataFrame:
    """(id, t, value, level, slope, seasonal, level_spread, residual) for every point, given the whole series: value = level + seasonal + residual.

    ``level``, ``slope`` (None: the level has none, and the column is null) and ``season`` are the shocks' variances as ratios to that of the noise; ``ratios`` of
    :func:`fit_structural` has them for each series instead, and series without a row there have no result. ``level_spread`` is the level's variance as such
    a ratio. The residual is null where the value is not observed; the seasonal part is zero without a period. An empty series gives an empty result.
    """
    _checked(period, level, slope or 0.0, season)
    shape = Shape(slope is not None, period)
    n = shape.size
    known, n_tasks = _with_states(series, [level, slope or 0.0, season] if ratios is None else ratios, shape)

    def states(values: list, ratios: list[float], state: list[float]) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(m, p) for m, p, *_ in _filtered(shape, ratios, _observed(values), *_unpacked(state, n, "vm"))]

    def element(values: list, ratios: list[float], last: bool, state: list[float]) -> dict:
        return {"part": _packed(reduce(_joined_back, _smoothers(shape, ratios, states(values, ratios, state), last)))}

    fields = ["value", "level", "slope", "seasonal", "level_spread"]

    def smooth(values: list, ratios: list[float], last: bool, state: list[float], later: list[float]) -> dict:
        now, out = _unpacked(later, n, "vm"), []
        for part in _smoothers(shape, ratios, states(values, ratios, state), last):
            now = _before(now, part)
            mean = now[0]
            out.append((mean[0], mean[1] if shape.slope else None, mean[1 + shape.slope] if shape.period else 0.0, now[1][0, 0]))
        return {"value": values} | {c: list(x) for c, x in zip(fields[1:], zip(*reversed(out)))}

    parts = materialised(_mapped(known, element, part="array<double>"))
    later = _entering(parts, n, _packed([np.zeros(n), np.zeros((n, n))]), True).withColumnRenamed("state", "later")
    found = _mapped(known.join(later, ["id", "node"]).repartition(n_tasks, "id", "node"), smooth, **{c: "array<double>" for c in fields})
    rows = found.select("id", "node", F.posexplode(F.arrays_zip(*fields)).alias("k", "p")).select("id", (F.col("node") * BLOCK + F.col("k")).alias("t"), "p.*")
    observed = F.col("value").isNotNull() & (F.abs("value") < float("inf"))
    return rows.withColumn("residual", F.when(observed, F.col("value") - F.col("level") - F.col("seasonal")))


def likelihoods(series: DataFrame, period: int | None = None, level: float = 0.1, slope: float | None = None, season: float = 0.0, ratios: DataFrame | None = None) -> DataFrame:
    """(id, n, noise, log_likelihood): the noise's variance of greatest likelihood under the ratios, and that likelihood; the first values, as many as a state has parts, count for nothing."""
    _checked(period, level, slope or 0.0, season)
    shape = Shape(slope is not None, period)
    known, _ = _with_states(series, [level, slope or 0.0, season] if ratios is None else ratios, shape)

    def work(values: list, ratios: list[float], last: bool, state: list[float]) -> dict:
        # the first block alone has a state that is vague
        begin = np.isclose(state[shape.size], VAGUE)
        at, total, squares, logs = 0, 0, 0.0, 0.0
        for _, _, off, s, _ in _filtered(shape, ratios, _observed(values), *_unpacked(state, shape.size, "vm")):
            if np.isfinite(off):
                at += 1
                if not begin or at > shape.size:
                    total, squares, logs = total + 1, squares + off**2 / s, logs + float(np.log(s))
        return {"n": total, "squares": squares, "logs": logs}

    sums = _mapped(known, work, n="long", squares="double", logs="double").groupBy("id").agg(F.sum("n").alias("n"), F.sum("squares").alias("squares"), F.sum("logs").alias("logs"))
    noise = F.col("squares") / F.nullif("n", F.lit(0).cast("long"))
    full = -0.5 * (F.col("n") * (F.log(2 * F.pi() * noise) + 1) + F.col("logs"))
    return sums.select("id", "n", noise.alias("noise"), F.when(noise > 0, full).alias("log_likelihood"))


def fit_structural(series: DataFrame, candidates: list[tuple[float, float | None, float]], period: int | None = None) -> DataFrame:
    """(id, level_ratio, slope_ratio, season_ratio, noise, log_likelihood): of the candidates (level, slope, season), those of each series' greatest likelihood.

    All candidates are filtered in one pass over copies of the series. All have a slope or none has one. Ties, and series of too few values or without noise, go to the first candidate.
    """
    if not candidates or len({c[1] is None for c in candidates}) > 1:
        raise ValidationError("candidates all have a slope, or none has one")
    for c in candidates:
        _checked(period, c[0], c[1] or 0.0, c[2])
    listed = F.array(*[F.struct(F.lit(k).alias("k"), *[F.lit(None if x is None else float(x)).cast("double").alias(f"{name}_ratio") for name, x in zip(("level", "slope", "season"), c)]) for k, c in enumerate(candidates)])
    copies = series.select("id", "t", "value", F.explode(listed).alias("c"))
    tried = copies.select(F.struct("id", "c.k").alias("id"), "t", "value")
    each = series.select("id").distinct().select("id", F.explode(listed).alias("c")).select(F.struct("id", "c.k").alias("id"), "c.level_ratio", "c.slope_ratio", "c.season_ratio")
    slope = None if candidates[0][1] is None else 0.0
    found = likelihoods(tried, period, slope=slope, ratios=each).join(each, "id")
    order = F.struct(F.coalesce("log_likelihood", F.lit(float("-inf"))), -F.col("id.k"))
    best = found.groupBy(F.col("id.id").alias("id")).agg(F.max_by(F.struct("level_ratio", "slope_ratio", "season_ratio", "noise", "log_likelihood"), order).alias("best"))
    return best.select("id", "best.*")
