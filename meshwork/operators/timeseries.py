"""Graphs of time series: visibility, transition and recurrence networks over (id, t, value), t = 0, 1, ..."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshwork.errors import ValidationError
from meshwork.plans.fixpoint import discard, materialised

#: Points of a block of horizontal visibility, and blocks below a node of its tree.
FAN = 64
#: Points of a stretch whose natural visibility one task works out.
STRETCH = 4096
#: Share of two values' size by which the slope between them may be off, times their distance: both are rounded, and so is their difference.
ROUNDING = 2.0**-51
#: A series of so many vectors at most is searched as a whole: its pairs are bounded.
SHORT = 128


def hvg_edges(series: DataFrame) -> DataFrame:
    """(id, i, j), i < j: every value between is below both ends. Values are finite.

    An edge joins a point with the next that is as high at least, or with the last before that is higher. Blocks of ``FAN`` points answer for
    themselves; the rest climb a tree of the blocks' maxima until a block beside their way is high enough, and go down in it, a join with
    a level each. A series of any length is many rows in many tasks, and no row meets more than ``FAN`` values of a level.
    """
    own = series.select("id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value")).filter("value IS NOT NULL")
    gathered = lambda df, at: df.groupBy("id", F.floor(F.col(at) / FAN).alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("t"), "value"))).alias("items"))
    levels = [materialised(gathered(own, "t"))]
    last = (own.agg(F.max("t")).first()[0] or 0) // FAN
    while last:
        last //= FAN
        up = levels[-1].select("id", F.col("node").alias("at"), F.array_max(F.transform("items", lambda e: e["value"])).alias("value"))
        levels.append(materialised(gathered(up, "at")))
    inside = F.transform("items", lambda e: F.struct(e["t"].alias("t"), e["value"].alias("x"), _after("items", e["t"], e["value"]).alias("next"), _before("items", e["t"], e["value"]).alias("before")))
    points = materialised(levels[0].select("id", "node", F.explode(inside).alias("p")).select("id", "node", "p.*"))
    found = points.filter("next IS NOT NULL").select("id", F.col("t").alias("i"), F.col("next").alias("j"))
    found = found.union(points.filter("before >= 0").select("id", "before", "t"))
    for column, seek in (("next", _after), ("before", _before)):
        far = _climbed(points.filter(F.col(column).isNull()).select("id", "node", "t", "x"), levels, seek)
        found = found.union(far.select("id", F.least("t", "to").alias("i"), F.greatest("t", "to").alias("j")))
    return found


def _after(items, t: Column, x: Column) -> Column:
    """The t of the first item after ``t`` that is as high as ``x``."""
    return F.get(F.filter(items, lambda v: (v["t"] > t) & (v["value"] >= x)), F.lit(0))["t"]


def _before(items, t: Column, x: Column) -> Column:
    """The t of the last item before ``t`` that is higher than ``x``, if none between is as high: else that is the edge of another."""
    last = F.try_element_at(F.filter(items, lambda v: (v["t"] < t) & (v["value"] >= x)), F.lit(-1))
    return F.when(last["value"] > x, last["t"]).when(last["value"] == x, F.lit(-1))


def _climbed(rows: DataFrame, levels: list[DataFrame], seek) -> DataFrame:
    """(id, t, x, to) of the points (id, node, t, x) that have a partner outside their block; ``seek`` is :func:`_after` or :func:`_before`."""
    first = seek is _after
    start, end = F.lit(-1).cast("long"), F.lit((1 << 62)).cast("long")
    hits: list[DataFrame] = []
    for level in levels[1:]:
        up = rows.withColumn("parent", F.floor(F.col("node") / FAN)).join(level.withColumnRenamed("node", "parent"), ["id", "parent"])
        wide = F.filter("items", lambda v: ((v["t"] > F.col("node")) if first else (v["t"] < F.col("node"))) & (v["value"] >= F.col("x")))
        one = F.get(wide, F.lit(0))["t"] if first else F.try_element_at(wide, F.lit(-1))["t"]
        tried = materialised(up.select("id", "t", "x", "parent", one.alias("hit")))
        hits.append(tried.filter("hit IS NOT NULL").select("id", "t", "x", F.col("hit").alias("node")))
        rows = tried.filter("hit IS NULL").select("id", F.col("parent").alias("node"), "t", "x")
    down: DataFrame | None = None
    for level, own in zip(reversed(levels[:-1]), reversed(hits)):
        down = own if down is None else down.union(own)
        down = down.join(level, ["id", "node"]).select("id", "t", "x", seek("items", start if first else end, F.col("x")).alias("node"))
    if down is None:
        return rows.limit(0).select("id", "t", "x", F.col("node").alias("to"))
    return down.filter("node >= 0").select("id", "t", "x", F.col("node").alias("to"))


def nvg_edges(series: DataFrame, limit: int | None = None) -> DataFrame:
    """(id, i, j): no value between lies above the chord, and j <= i + limit where one is given.

    With a limit, a bounded range join: an equi-join on blocks of ``limit`` points; a running maximum of the slopes as computed decides. Without
    one, series are divided at their maxima, see :func:`_divided`.
    """
    return _divided(series) if limit is None else _limited(series, limit, 0.0)


def _limited(series: DataFrame, limit: int, rounding: float) -> DataFrame:
    own = series.select("id", "t", "value").withColumn("block", F.floor(F.col("t") / limit))
    left = own.select("id", F.col("t").alias("i"), F.col("value").alias("x"), F.explode(F.array("block", F.col("block") + 1)).alias("block"))
    right = own.select("id", F.col("t").alias("j"), F.col("value").alias("y"), "block")
    pairs = left.join(right, ["id", "block"]).filter(f"j > i AND j <= i + {limit}")
    pairs = pairs.withColumn("slope", (F.col("y") - F.col("x")) / (F.col("j") - F.col("i")))
    before = Window.partitionBy("id", "i").orderBy("j").rowsBetween(Window.unboundedPreceding, -1)
    pairs = pairs.withColumn("off", rounding * (F.abs("x") + F.abs("y")) / (F.col("j") - F.col("i")))
    return pairs.withColumn("steepest", F.max(F.col("slope") - F.col("off")).over(before)).filter("steepest IS NULL OR slope + off >= steepest").select("id", "i", "j")


def _divided(series: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(id, i, j) of all natural visibility: nobody sees across the first maximum of a stretch, so its own view is taken and the stretch falls in two.

    A round takes the views of all long stretches' maxima: slopes away from the maximum and their running maximum, which goes over
    blocks of ``STRETCH`` points and then over the blocks, so that one long series is shared by tasks. Stretches of at most
    ``STRETCH`` points are finished where they lie. A series that rises or falls all along hardly falls apart; what is left of such after
    ``most_rounds`` is compared pair by pair in the limited form's blocks. A point lies above a chord if it does by more than the rounding
    of the values explains (``ROUNDING``), so that points on a line see each other from whichever end slopes are taken.
    """
    long = materialised(series.select("id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"), F.lit(0).cast("long").alias("stretch")))
    found: DataFrame | None = None
    whole = Window.partitionBy("id", "stretch")
    for _ in range(most_rounds):
        tops = long.groupBy("id", "stretch").agg(F.count("*").alias("n"), F.max(F.struct("value", (-F.col("t")).alias("back"))).alias("top"))
        tops = materialised(tops.select("id", "stretch", "n", F.col("top.value").alias("high"), (-F.col("top.back")).alias("at")))
        small = materialised(long.join(tops.filter(F.col("n") <= STRETCH).select("id", "stretch"), ["id", "stretch"], "left_semi"))
        done = _viewed(small)
        rows = long.join(tops.filter(F.col("n") > STRETCH), ["id", "stretch"])
        away = F.abs(F.col("t") - F.col("at"))
        rows = materialised(rows.select("id", "stretch", "t", "value", "at", (F.col("t") > F.col("at")).alias("right"), away.alias("away"), F.floor(away / STRETCH).alias("block"), ((F.col("value") - F.col("high")) / F.nullif(away, F.lit(0).cast("long"))).alias("slope"), (ROUNDING * (F.abs("value") + F.abs("high")) / F.nullif(away, F.lit(0).cast("long"))).alias("off")))
        keys = ["id", "stretch", "right", "block"]
        seen = rows.filter("away > 0")
        steps = seen.groupBy(*keys).agg(F.max(F.col("slope") - F.col("off")).alias("m")).withColumn("nearer", F.max("m").over(Window.partitionBy(*keys[:3]).orderBy("block").rowsBetween(Window.unboundedPreceding, -1))).drop("m")
        near = F.max(F.col("slope") - F.col("off")).over(Window.partitionBy(*keys).orderBy("away").rowsBetween(Window.unboundedPreceding, -1))
        clear = F.coalesce(F.col("slope") + F.col("off") >= F.greatest("near", "nearer"), F.lit(True))
        view = seen.withColumn("near", near).join(steps, keys).filter(clear).select("id", F.least("t", "at").alias("i"), F.greatest("t", "at").alias("j"))
        part = materialised(done.union(view))
        found = part if found is None else found.union(part)
        after = materialised(seen.select("id", "t", "value", F.when(F.col("right"), F.col("at") + 1).otherwise(F.col("stretch")).alias("stretch")))
        for table in (long, tops, small, rows):
            discard(table)
        long = after
        if long.isEmpty():
            return found
    # stretches keep apart: their numbers become ids
    span = long.withColumn("n", F.max("t").over(whole) - F.min("t").over(whole) + 1).agg(F.max("n")).first()[0]
    rest = _limited(long.select(F.struct("id", "stretch").alias("id"), "t", "value"), int(span), ROUNDING)
    return found.union(rest.select("id.id", "i", "j"))


def _viewed(stretches: DataFrame) -> DataFrame:
    """(id, i, j) inside stretches (id, stretch, t, value) of at most ``STRETCH`` points."""

    def views(t: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        parts = [(0, len(t))]
        while parts:
            low, high = parts.pop()
            if high - low < 2:
                continue
            at = low + int(y[low:high].argmax())
            for own in (np.arange(at + 1, high), np.arange(at - 1, low - 1, -1)):
                away = np.abs(t[own] - t[at])
                slope, off = (y[own] - y[at]) / away, ROUNDING * (np.abs(y[own]) + np.abs(y[at])) / away
                clear = own[slope + off >= np.concatenate([[-np.inf], np.maximum.accumulate(slope - off)[:-1]])[: len(own)]]
                yield np.minimum(t[clear], t[at]), np.maximum(t[clear], t[at])
            parts += [(low, at), (at + 1, high)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def of(rows: pa.Table, bounds: list[int]) -> Iterator[pa.RecordBatch]:
            t, y = rows.column("t").to_numpy(), rows.column("value").to_numpy()
            for low, high in zip(bounds, bounds[1:]):
                ends = list(views(t[low:high], y[low:high]))
                if ends:
                    i, j = (np.concatenate(x) for x in zip(*ends))
                    yield pa.record_batch({"id": rows.column("id").slice(low, 1).combine_chunks().take(pa.array(np.zeros(len(i), dtype=np.int64))), "i": pa.array(i), "j": pa.array(j)})

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if kept is None else pa.concat_tables([kept, rows])
            key = rows.column("key").to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist()]
            # the last stretch may go on in the next batch
            yield from of(rows, cuts)
            kept = rows.slice(cuts[-1])
        if kept is not None:
            yield from of(kept, [0, kept.num_rows])

    kind = stretches.schema["id"].dataType.simpleString()
    dealt = stretches.repartition("id", "stretch").sortWithinPartitions("id", "stretch", "t")
    return dealt.withColumn("key", F.xxhash64("id", "stretch")).select("id", "key", "t", "value").mapInArrow(run, f"id {kind}, i long, j long")


def visibility_degree(series: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, t, degree) for every point."""
    counted = edges.select("id", F.explode(F.array("i", "j")).alias("t")).groupBy("id", "t").agg(F.count("*").alias("degree"))
    return series.select("id", "t").join(counted, ["id", "t"], "left").select("id", "t", F.coalesce("degree", F.lit(0)).alias("degree"))


def transition_network(rows: DataFrame, key: str, order: list[str], symbol: str) -> DataFrame:
    """(src, dst, n): how often one symbol follows another within a key."""
    following = F.lead(symbol).over(Window.partitionBy(key).orderBy(*order))
    return rows.select(F.col(symbol).alias("src"), following.alias("dst")).filter("dst IS NOT NULL").groupBy("src", "dst").agg(F.count("*").alias("n"))


def ordinal_patterns(series: DataFrame, m: int) -> DataFrame:
    """(id, t, symbol): the order of m consecutive values, as the ranks of their places."""
    ahead = Window.partitionBy("id").orderBy("t").rowsBetween(0, m - 1)
    own = series.withColumn("w", F.collect_list("value").over(ahead)).filter(F.size("w") == m)
    places = F.array_sort(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return own.select("id", "t", F.array_join(F.transform(places, lambda s: s["i"].cast("string")), "").alias("symbol"))


def delay_vectors(series: DataFrame, m: int = 2, tau: int = 1) -> DataFrame:
    """(id, t, x0, ... of m values tau apart, x0 the value at t); points that lack one, or have one that isn't finite, have no vector."""
    order = Window.partitionBy("id").orderBy("t")
    own = series.select("id", "t", *[F.lag("value", tau * d).over(order).cast("double").alias(f"x{d}") for d in range(m)])
    return own.filter(" AND ".join(f"abs(x{d}) < double('Infinity')" for d in range(m)))


def _distance(metric: str, m: int) -> Column:
    """Between the vectors x0, x1, ... and y0, y1, ..."""
    apart = [F.abs(F.col(f"x{d}") - F.col(f"y{d}")) for d in range(m)]
    if metric == "euclidean":
        return F.sqrt(sum((a * a for a in apart), F.lit(0.0)))
    if metric == "manhattan":
        return sum(apart, F.lit(0.0))
    if metric == "maximum":
        return F.greatest(*apart) if m > 1 else apart[0]
    raise ValidationError(f"{metric} is no metric: euclidean, manhattan and maximum are")


def _cells(width: Column, m: int, name: str) -> list[Column]:
    """Grid cells of at most three of the vectors' values, a little wider than ``width`` so that rounding can't part two that are nearer."""
    return [F.floor(F.col(f"{name}{d}") / (width * (1 + 2.0**-20))).alias(f"c{d}") for d in range(min(m, 3))]


def _beside(m: int, half: bool) -> Column:
    """The steps to a cell's neighbours and itself, one row each; of two opposite steps only one where ``half``."""
    steps = [c for c in product((-1, 0, 1), repeat=min(m, 3)) if not half or c >= (0,) * len(c)]
    return F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"s{d}") for d, x in enumerate(c)]) for c in steps])).alias("step")


def recurrence_radius(series: DataFrame, radius: float, m: int = 2, tau: int = 1, metric: str = "euclidean") -> DataFrame:
    """(id, i, j, distance), i < j: the delay vectors of a series that are less than ``radius`` apart; metrics are euclidean, manhattan, maximum.

    A grid of cells as wide as the radius turns the search into an equi-join of a cell with half of its neighbours, so vectors
    meet only those of the cells beside them.
    """
    if not radius > 0:
        raise ValidationError("a radius is above zero")
    grid = range(min(m, 3))
    own = materialised(delay_vectors(series, m, tau).select("*", *_cells(F.lit(float(radius)), m, "x")))
    left = own.select("*", _beside(m, True))
    left = left.select("id", F.col("t").alias("i"), *[f"x{d}" for d in range(m)], *[(F.col(f"c{d}") + F.col(f"step.s{d}")).alias(f"c{d}") for d in grid], F.expr(" AND ".join(f"step.s{d} = 0" for d in grid)).alias("inside"))
    right = own.select("id", F.col("t").alias("j"), *[F.col(f"x{d}").alias(f"y{d}") for d in range(m)], *[f"c{d}" for d in grid])
    pairs = left.join(right, ["id", *[f"c{d}" for d in grid]]).filter("NOT inside OR i < j").withColumn("distance", _distance(metric, m)).filter(F.col("distance") < radius)
    return pairs.select("id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "distance")


def recurrence_knn(series: DataFrame, m: int = 2, tau: int = 1, k: int = 3, metric: str = "euclidean") -> DataFrame:
    """(id, i, j, rank, distance): each delay vector's k nearest in its series, ties to the smaller time.

    Vectors look for neighbours in the cells beside their own, of a grid that is as fine as their series is dense; those whose k-th is
    not nearer than a cell's width look again in one twice as coarse. Of equal vectors only the k + 1 earliest can be found, so a
    value that a series repeats does not make all pairs. A series of at most ``SHORT`` vectors is one cell at once.
    """
    grid = range(min(m, 3))
    own = materialised(delay_vectors(series, m, tau))
    equal = Window.partitionBy("id", *[f"x{d}" for d in range(m)]).orderBy("t")
    first = own.withColumn("r", F.row_number().over(equal)).filter(F.col("r") <= k + 1).drop("r")
    spread = F.greatest(*[F.max(f"x{d}") - F.min(f"x{d}") for d in range(m)], F.lit(0.0))
    sizes = own.groupBy("id").agg(F.count("*").alias("n"), spread.alias("spread"))
    dense = F.col("spread") * F.pow(2.0 * (k + 1) / F.col("n"), F.lit(1.0 / m))
    sizes = materialised(sizes.select("id", F.when((F.col("n") <= SHORT) | (F.col("spread") == 0), 2 * F.col("spread") + 1).otherwise(dense).alias("width"), "spread"))
    first = materialised(first.join(sizes, "id").select("id", F.col("t").alias("j"), *[F.col(f"x{d}").alias(f"y{d}") for d in range(m)], "width", "spread"))
    left = materialised(own.join(sizes, "id"))
    discard(own)
    nearest = Window.partitionBy("id", "i").orderBy("distance", "j")
    each = Window.partitionBy("id", "i")
    found: DataFrame | None = None
    scale = 1.0
    while True:
        at = left.select("id", F.col("t").alias("i"), *[f"x{d}" for d in range(m)], *_cells(F.col("width") * scale, m, "x"), _beside(m, False))
        at = at.select("id", "i", *[f"x{d}" for d in range(m)], *[(F.col(f"c{d}") + F.col(f"step.s{d}")).alias(f"c{d}") for d in grid])
        near = first.select("*", *_cells(F.col("width") * scale, m, "y"))
        pairs = at.join(near, ["id", *[f"c{d}" for d in grid]]).filter("i <> j").withColumn("distance", _distance(metric, m))
        best = pairs.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)
        whole = F.col("width") * scale > F.col("spread")
        settled = whole | ((F.count("*").over(each) == k) & (F.max("distance").over(each) < F.col("width") * scale))
        part = materialised(best.select("id", "i", "j", "rank", "distance", settled.alias("settled")))
        rows = part.filter("settled").drop("settled")
        found = rows if found is None else found.union(rows)
        # a vector that found none is alone in its series once the grid is one cell
        after = materialised(left.filter(~whole).join(rows.select("id", F.col("i").alias("t")).distinct(), ["id", "t"], "left_anti"))
        discard(left)
        left, scale = after, 2 * scale
        if left.isEmpty():
            return found


def decompose(series: DataFrame, period: int) -> DataFrame:
    """(id, t, value, trend, seasonal, residual): the classical additive decomposition, whose residual goes on to the networks.

    The trend is the moving average over one period around a point (of an even period, with half weight at both ends), null where that
    leaves the series; the season is the mean of what lies off the trend at the same place of the period, less the mean of
    these; value = trend + seasonal + residual. Points are t = 0, 1, ... without gaps; the season is null at places
    that no trend covers. Windows reach over one period, so the moving average is a join of blocks of points, not a task for a series.
    """
    if period < 2:
        raise ValidationError("a period has two points or more")
    half = period // 2
    own = series.select("id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    block = max(period, 1 << 12)
    # a block's rows and the half period of rows beside it, which only lend their values
    at = F.floor(F.col("t") / block)
    near = F.array_distinct(F.array(at, F.floor((F.col("t") - half) / block), F.floor((F.col("t") + half) / block)))
    dealt = own.select("*", at.alias("home"), F.explode(near).alias("block"))
    order = Window.partitionBy("id", "block").orderBy("t")
    around = order.rowsBetween(-half, half)
    ends = 0.5 * (F.lag("value", half).over(order) + F.lead("value", half).over(order)) if period % 2 == 0 else F.lit(0.0)
    inner = F.sum("value").over(order.rowsBetween(-half + 1, half - 1)) if period % 2 == 0 else F.sum("value").over(around)
    full = F.count("value").over(around) == 2 * half + 1
    trended = dealt.withColumn("trend", F.when(full, (inner + ends) / period)).filter("home = block").select("id", "t", "value", "trend")
    trended = materialised(trended)
    phase = F.pmod("t", F.lit(period))
    off = trended.filter("trend IS NOT NULL").groupBy("id", phase.alias("phase")).agg(F.avg(F.col("value") - F.col("trend")).alias("off"))
    off = off.withColumn("seasonal", F.col("off") - F.avg("off").over(Window.partitionBy("id"))).drop("off")
    found = trended.withColumn("phase", phase).join(off, ["id", "phase"], "left")
    return found.select("id", "t", "value", "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))


def sliding_windows(series: DataFrame, size: int, step: int) -> DataFrame:
    """(id, start, t, value): windows of ``size`` points, without those whose values are all equal."""
    own = series.select("id", F.col("t").cast("long").alias("t"), "value")
    # rows stay with their series: its last point comes by a merge, and windows are whole where their points lie
    last = own.groupBy("id").agg(F.max("t").alias("last")).hint("merge")
    low = F.greatest(F.ceil((F.col("t") - size + 1) / step) * step, F.lit(0)).cast("long")
    high = (F.floor(F.least(F.col("t"), F.col("last") - size + 1) / step) * step).cast("long")
    rows = own.join(last, "id").filter((F.col("last") >= size - 1) & (low <= high))
    rows = rows.select("id", F.explode(F.sequence(low, high, F.lit(step).cast("long"))).alias("start"), "t", "value")
    each = Window.partitionBy("id", "start")
    varied = rows.withColumn("varied", F.max("value").over(each) > F.min("value").over(each)).filter("varied")
    return varied.select("id", "start", "t", "value")
