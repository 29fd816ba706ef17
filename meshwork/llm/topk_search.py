"""Exact top-k inner-product search: ball-tree branch and bound over shards of the vectors.

Method. Components become integers floor(scale * x), so scores are exact. The rows that a task reads are cut into
shards; each shard becomes a ball tree (a node has a centre, a radius and its smallest vec_id). For a query q
no row below a node scores more than q.centre + |q| radius. Nodes are opened in order of that bound; a
search ends when the best open bound cannot enter the current k best. The k-th score so far is shared: every
task starts from the one that some rows of the table reach already, carries its own from shard to shard, and prunes whole
shards at their root. A bound that equals the k-th score is opened only while a smaller vec_id may lie below,
so a common vector in a third of all rows ends a search, not lengthens it.

Scale. Vectors are never shuffled: tasks emit at most k rows for each query and the final ranking is a
window over those. Queries go out in blocks of ``QUERY_BLOCK`` at most, one after the other: each is a broadcast that goes when
its pass over the vectors has been stored; that is a stated query set against all rows, in blocks.

Edge cases. Vectors that are null or hold null or non-finite components take no part, nor do rows without vec_id.
Vectors only meet others of the same length. A query's own vec_id is never its candidate, repeated rows
included; other repeated rows each count. A query id with several vectors uses the least of them (as
arrays are ordered). Rows and queries whose products might leave 2**53 are scanned instead, those near the k-th score in whole
numbers, and scores beyond 64 bits end at the ends of that range. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush, heapreplace
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
QUERY_BLOCK = 4096
#: Rows of the table, any, whose scores give every query's search its first lower bound.
SEEN_ROWS = 4096
SHARD_ROWS = 8192
LEAF_ROWS = 64
#: Scores up to here are exact in double precision.
EXACT = 1 << 53
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


class Tree(NamedTuple):
    rows: np.ndarray  # integers as doubles, in leaf order
    ids: np.ndarray
    low: np.ndarray  # first and last row of each node
    high: np.ndarray
    left: np.ndarray  # children, -1 for a leaf
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    least_id: np.ndarray


def ball_tree(ids: np.ndarray, rows: np.ndarray, leaf: int = LEAF_ROWS) -> Tree:
    order = np.arange(len(ids))
    nodes: list[list] = []

    def add(low: int, high: int) -> int:
        own = rows[order[low:high]]
        centre = own.mean(axis=0)
        away = ((own - centre) ** 2).sum(axis=1)
        me = len(nodes)
        nodes.append([low, high, -1, -1, centre, float(np.sqrt(away.max())), int(ids[order[low:high]].min())])
        if high - low > leaf and away.max() > 0:
            a = own[away.argmax()]
            b = own[((own - a) ** 2).sum(axis=1).argmax()]
            along = own @ (b - a)
            middle = (high - low) // 2
            order[low:high] = order[low:high][np.argpartition(along, middle)]
            nodes[me][2] = add(low, low + middle)
            nodes[me][3] = add(low + middle, high)
        return me

    add(0, len(ids))
    low, high, left, right, centre, radius, least = zip(*nodes)
    return Tree(rows[order], ids[order], *map(np.array, (low, high, left, right)), np.array(centre), np.array(radius), np.array(least))


def search(tree: Tree, query: np.ndarray, own_id: int, k: int, floor: float, best: list[tuple[int, int]], bounds: np.ndarray) -> None:
    """Put the tree's rows among ``best``, a heap of (score, -vec_id) with the worst first.

    ``floor`` is a score that at least k other rows are known to reach; ``bounds`` has an upper
    bound of the score below each node.
    """
    queue = [(-bounds[0], 0)]
    while queue:
        bound, node = heappop(queue)
        bound = -bound
        if bound < floor or len(best) == k and bound < best[0][0]:
            return
        if len(best) == k and bound < best[0][0] + 1 and -int(tree.least_id[node]) < best[0][1]:
            continue  # at most a tie, and no smaller vec_id below
        if tree.left[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                heappush(queue, (-bounds[child], int(child)))
            continue
        low, high = tree.low[node], tree.high[node]
        scores = tree.rows[low:high] @ query
        ids = tree.ids[low:high]
        least = max(floor, best[0][0]) if len(best) == k else floor
        for at in np.flatnonzero((scores >= least) & (ids != own_id)):
            entry = (int(scores[at]), -int(ids[at]))
            if len(best) < k:
                heappush(best, entry)
            elif entry > best[0]:
                heapreplace(best, entry)


def upper_bounds(tree: Tree, queries: np.ndarray) -> np.ndarray:
    """Queries by nodes; widened by more than the rounding of the products."""
    product = queries @ tree.centre.T
    reach = np.sqrt((queries**2).sum(axis=1))[:, None] * tree.radius
    return np.floor(product + reach + 1e-9 * (np.abs(product) + reach) + 0.5)


def small(vectors: np.ndarray, scale: int) -> np.ndarray:
    """Which vectors' products with each other are exact in double precision."""
    return np.abs(vectors).max(axis=1, initial=0.0) < (EXACT / max(1, vectors.shape[1])) ** 0.5 / scale - 1


def whole(vector: np.ndarray, scale: int) -> list[int]:
    """floor(scale * x); doubles from 2**53 on are whole themselves."""
    return [int(x) * scale if abs(x) >= EXACT else int(np.floor(x * scale)) for x in vector.tolist()]


def scaled(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, int]:
    """floor(scale * x) over two to a power, none above one, and that power."""
    power = max(0, int(np.frexp(np.abs(vectors).max(initial=0.0))[1]) + scale.bit_length())
    with np.errstate(over="ignore"):
        all_whole = np.floor(vectors * scale)
    return np.where(np.abs(vectors) < EXACT, np.ldexp(all_whole, -power), np.ldexp(vectors, scale.bit_length() - 1 - power) * (scale / (1 << scale.bit_length() - 1))), power


def scan(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own_id: int, k: int, scale: int, best: list[tuple[int, int]]) -> None:
    """Put rows among ``best`` by whole-number scores; rows that are too far below the k-th by doubles are passed over."""
    at = np.flatnonzero(ids != own_id)
    rows, up = scaled(vectors[at], scale)
    asked, more = scaled(query[None], scale)
    about = rows @ asked[0]
    slack = float((np.abs(rows) @ np.abs(asked[0])).max(initial=0.0)) * max(1, len(query)) * 2.0**-50 + 2.0**-900
    exact = whole(query, scale)
    for n in np.argsort(-about, kind="stable").tolist():
        if len(best) == k and about[n] + 2 * slack < best[0][0] / (1 << up + more):
            return
        entry = (sum(a * b for a, b in zip(exact, whole(vectors[at[n]], scale))), -int(ids[at[n]]))
        if len(best) < k:
            heappush(best, entry)
        elif entry > best[0]:
            heapreplace(best, entry)


class Queries(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray
    small: np.ndarray
    rows: np.ndarray  # whole numbers, where small
    floors: np.ndarray


def prepared(found: list[tuple[int, list[float]]], seen: list[tuple[int, list[float]]], scale: int, k: int) -> dict[int, Queries]:
    """Queries by vector length, each with a score that k of the rows ``seen`` already reach."""
    out = {}
    for size in sorted({len(v) for _, v in found}):
        ids, vectors = _arrays(found, size)
        ok = small(vectors, scale)
        rows = np.where(ok[:, None], np.floor(np.where(ok[:, None], vectors, 0.0) * scale), 0.0)
        floors = np.full(len(ids), -np.inf)
        seen_ids, others = _arrays(seen, size)
        near = small(others, scale)
        seen_ids, others = seen_ids[near], np.floor(others[near] * scale)
        if len(seen_ids) >= k:
            for at in range(0, len(ids), 512):
                scores = rows[at : at + 512] @ others.T
                scores[ids[at : at + 512, None] == seen_ids] = -np.inf
                floors[at : at + 512] = np.partition(scores, -k, axis=1)[:, -k]
        out[size] = Queries(ids, vectors, ok, rows, np.where(ok, floors, -np.inf))
    return out


def _arrays(found: list[tuple[int, list[float]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    own = [(i, v) for i, v in found if len(v) == size]
    return np.array([i for i, _ in own], dtype=np.int64), np.array([v for _, v in own], dtype=np.float64).reshape(len(own), size)


def _take(best: dict, asked: Queries, size: int, ids: np.ndarray, vectors: np.ndarray, k: int, scale: int) -> None:
    ok = small(vectors, scale)
    heaps = [best.setdefault((size, q), []) for q in asked.ids.tolist()]
    if ok.any() and asked.small.any():
        tree = ball_tree(ids[ok], np.floor(vectors[ok] * scale))
        bounds = upper_bounds(tree, asked.rows)
        for n in np.flatnonzero(asked.small).tolist():
            search(tree, asked.rows[n], int(asked.ids[n]), k, asked.floors[n], heaps[n], bounds[n])
    for n, own_id in enumerate(asked.ids.tolist()):
        rest = ~ok if asked.small[n] else np.ones(len(ok), dtype=bool)
        if rest.any():
            scan(vectors[rest], ids[rest], asked.vectors[n], own_id, k, scale, heaps[n])


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part."""
    return vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(
        "vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))"
    )


def _partial(vectors: DataFrame, asked, k: int, scale: int, shard: int) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, Queries] = asked.value
        best: dict[tuple[int, int], list[tuple[int, int]]] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def flush(size: int) -> None:
            own = held.pop(size)
            _take(best, queries[size], size, np.concatenate([i for i, _ in own]), np.concatenate([v for _, v in own]), k, scale)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            for size in np.unique(lengths).tolist():
                if size in queries:
                    rows = np.flatnonzero(lengths == size)
                    for at in range(0, len(rows), shard):
                        part = rows[at : at + shard]
                        held.setdefault(size, []).append((ids[part], values[starts[part][:, None] + np.arange(size)]))
                        if sum(len(i) for i, _ in held[size]) >= shard:
                            flush(size)
        for size in list(held):
            flush(size)
        rows = [(q, -i, min(max(s, _LEAST), _MOST)) for (_, q), heap in best.items() for s, i in heap]
        yield pa.record_batch([pa.array([r[c] for r in rows], pa.int64()) for c in range(3)], schema=schema)

    return vectors.mapInArrow(run, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, shard: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest scores among the rows of ``vectors``, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    seen = [(r["vec_id"], r["embedding"]) for r in rows.limit(SEEN_ROWS).collect()]
    n_blocks = max(1, -(-asked.count() // max(1, query_block // 2)))
    found = None
    for b in range(n_blocks):
        block = [(r["vec_id"], r["embedding"]) for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(prepared(block, seen, scale, k))
        part = stored(_partial(rows, sent, k, scale, shard)).df
        sent.destroy()
        found = part if found is None else found.union(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(f"vec_id % {QUERY_EVERY} = 0"))


#: The same search by brute force. Components are floats, exact as doubles; the products stay whole numbers.
ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
