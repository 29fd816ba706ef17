"""Connected components of a link table: spanning forests inside tasks, then large-star and small-star steps.

:func:`spanning_forest` replaces the links that a task has by a star for each of their components, so a group of m
nodes leaves a task as m - 1 links however many pairs it had. The two star steps then join a table of group minima
(combined on the map side) to the links. Both are stored tables, so either side of that join is a plain shuffle: a node
with a third of all links is a skewed partition, which adaptive execution splits. Every table lies in the shared folder and
goes when the next one is written. No links or labels reach the driver, only whether all links are stars
already. Rounds grow with the logarithm of the component size.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, stored

#: Links that a task holds at once.
HELD = 1 << 20
LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for all nodes but those least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        # the labels' own labels fall too, so that trees hook onto each other whole
        for end in (x, y):
            np.minimum.at(after, end, least)
            np.minimum.at(after, label[end], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def spanning_forest(links: DataFrame) -> DataFrame:
    """(a, b): fewer links with the same components, a star for each component of a task's links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def joined() -> tuple[np.ndarray, np.ndarray]:
            return stars(*map(np.concatenate, zip(*held)))

        for batch in batches:
            if batch.num_rows:
                held.append(stars(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            if sum(len(x) for x, _ in held) > HELD:
                held[:] = [joined()]
                if len(held[0][0]) > HELD // 2:
                    yield pa.record_batch(list(map(pa.array, held.pop())), schema=LINKS)
        if held:
            yield pa.record_batch(list(map(pa.array, joined())), schema=LINKS)

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def _starred(now: Stored, least: DataFrame, rows: DataFrame) -> Stored:
    """The links of ``rows`` (a, b), each b moved to the least node m of its a, and those of ``least`` (a, m)."""
    minima = stored(least)
    moved = rows.hint("merge").join(minima.df.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    after = stored(moved.union(minima.df.select("a", "m")).filter("a <> b").distinct())
    minima.drop()
    now.drop()
    return after


def large_star(now: Stored) -> Stored:
    both = now.df.union(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _starred(now, both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), both.filter("b > a"))


def small_star(now: Stored) -> Stored:
    down = now.df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    return _starred(now, down.groupBy("a").agg(F.min("b").alias("m")), down)


def settled(links: DataFrame) -> bool:
    """Whether every link leads from a node that has no other link to one that has none upwards."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(links: DataFrame) -> Stored:
    """(a, b): for every linked node that is not the least of its component, that least node.

    ``links`` has two long columns a and b, in any order and with any repetition; nodes without
    links do not appear in the result.
    """
    now = stored(spanning_forest(links.select("a", "b").filter("a <> b")).distinct())
    while not settled(now.df):
        now = small_star(large_star(now))
    # stars' centres are their least nodes: tasks and steps only ever link a node to a lesser one
    return now
