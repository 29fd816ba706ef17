"""Approximate nearest neighbours by cosine: randomly rotated one-bit codes with error bounds.

Method. Vectors are brought to length one and the centre of a sample is taken off. A random rotation (three rounds of random
signs and a fast Walsh-Hadamard transform, on the next power of two) makes every direction alike; the code keeps one bit a
coordinate, its sign, beside three scalars: the residual's length, its cosine with its own code, and its product with the
centre. The product of a query with the signs, divided by that cosine, estimates the query's product with the residual; the
error is at most ``ERROR`` standard deviations of what a random direction would add. Vectors whose bound reaches the
k-th exact score so far are scored on the original vectors, best estimates first, and raise it.

Scale. The index (codes, scalars and vectors) is a table; the rotation is drawn again from its seed wherever it is used. Vectors are
never shuffled: queries go out in blocks of ``QUERY_BLOCK`` at most, one after the other, each a broadcast that goes when its
pass has been stored; a task emits k rows for each query at most, which a window ranks. A stated query set meets
all rows, in blocks; that is N rows times N/50 queries, of which a row takes one bit a coordinate. Of equal vectors in a shard of
``SHARD_ROWS`` rows only those of smallest id can be among the nearest; the others are left out before any query meets them, so a
vector that fills a third of the table costs no more than others.

Edge cases. Vectors that are null, zero or hold null or non-finite components take no part, nor do rows without vec_id. Vectors
only meet others of the same length. A query's own vec_id is never its candidate, repeated rows included; other repeated rows
each count. A query id with several vectors uses the least of them (as arrays are ordered). Equal scores go to the smaller
vec_id. Scores are dot product over lengths in double precision, of vectors divided by a power of two so that squares stay
finite. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stored, stored, table
from .topk_search import usable

K = 5
QUERY_EVERY = 50
QUERY_BLOCK = 2048
#: Vectors whose mean is the centre, and whose exact scores give every query its first bound; chosen by a hash of their id.
SAMPLE_ROWS = 2048
SHARD_ROWS = 4096
#: Standard deviations that an estimate may be off.
ERROR = 4.0
SEED = 12
#: Vectors scored exactly at a time.
STEP = 64
INDEX = "vec_id long, size int, code binary, length double, toward double, along double, embedding array<double>"


def rotate(rows: np.ndarray, seed: int = SEED) -> np.ndarray:
    """The rows, padded to a power of two, under a random rotation that the seed and their length decide."""
    width = max(2, 1 << (rows.shape[1] - 1).bit_length())
    out = np.zeros((len(rows), width))
    out[:, : rows.shape[1]] = rows
    draw = np.random.default_rng([seed, rows.shape[1]])
    for _ in range(3):
        out *= draw.choice([-1.0, 1.0], width)
        step = 1
        while step < width:
            pairs = out.reshape(len(rows), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(rows), width)
            step *= 2
        out /= np.sqrt(width)
    return out


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows over a power of two each, so that the greatest component is near one."""
    _, power = np.frexp(np.abs(rows).max(axis=1, initial=0.0))
    return np.ldexp(rows, -power[:, None])


def units(rows: np.ndarray) -> np.ndarray:
    own = scaled(rows)
    return own / np.sqrt((own * own).sum(axis=1))[:, None]


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of scaled rows with a scaled query; each row's sum is of its own, so equal rows have equal scores."""
    return (rows * query).sum(axis=1) / (np.sqrt((rows * rows).sum(axis=1)) * np.sqrt((query * query).sum()))


class Coded(NamedTuple):
    code: np.ndarray  # packed bits
    length: np.ndarray
    toward: np.ndarray
    along: np.ndarray


def encoded(rows: np.ndarray, centre: np.ndarray, seed: int = SEED) -> Coded:
    own = units(rows)
    rest = rotate(own - centre, seed)
    length = np.sqrt((rest * rest).sum(axis=1))
    toward = np.abs(rest).sum(axis=1) / np.sqrt(rest.shape[1]) / np.where(length > 0, length, 1.0)
    return Coded(np.packbits(rest > 0, axis=1), length, np.where(length > 0, toward, 1.0), own @ centre)


class Queries(NamedTuple):
    ids: np.ndarray
    vectors: np.ndarray  # scaled
    rotated: np.ndarray  # unit queries less the centre, rotated
    lengths: np.ndarray
    base: np.ndarray  # what a product has apart from the residuals'
    floors: np.ndarray  # scores that k of the sample reach


def bounds(coded: Coded, asked: Queries, error: float) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines, rows by queries, and how far above them the true ones may be."""
    width = asked.rotated.shape[1]
    signs = np.unpackbits(coded.code, axis=1, count=width).astype(np.float32) * np.float32(2) - np.float32(1)
    seen = signs @ asked.rotated.T.astype(np.float32)
    estimate = seen * (coded.length / coded.toward / np.sqrt(width)).astype(np.float32)[:, None]
    estimate += coded.along.astype(np.float32)[:, None]
    estimate += asked.base.astype(np.float32)
    spread = coded.length * np.sqrt(np.maximum(0.0, 1 - coded.toward**2)) / coded.toward * error / np.sqrt(width - 1)
    return estimate, spread.astype(np.float32)[:, None] * asked.lengths.astype(np.float32) + np.float32(1e-5)


def first_of_equal(ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k nearest of some query: of equal vectors, 2k of smallest id, k of one id at most."""
    flat = np.ascontiguousarray(rows + 0.0)
    _, group = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((ids, group))
    for limit, keys in ((k, (group, ids)), (2 * k, (group,))):
        new = np.ones(len(order), dtype=bool)
        new[1:] = np.any([key[order][1:] != key[order][:-1] for key in keys], axis=0)
        place = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
        order = order[place < limit]
    return np.sort(order)


class Best:
    """A query's k best so far: scores falling, ids rising among equals."""

    def __init__(self) -> None:
        self.scores, self.ids = np.zeros(0), np.zeros(0, dtype=np.int64)

    def take(self, scores: np.ndarray, ids: np.ndarray, k: int) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        order = np.lexsort((ids, -scores))[:k]
        self.scores, self.ids = scores[order], ids[order]


def scan(ids: np.ndarray, rows: np.ndarray, coded: Coded, asked: Queries, best: list[Best], k: int, error: float) -> int:
    """Put a shard's rows among the queries' best; how many were scored exactly."""
    at = first_of_equal(ids, rows, k)
    ids, rows, coded = ids[at], scaled(rows[at]), Coded(*(x[at] for x in coded))
    scored = 0
    for low in range(0, len(asked.ids), 512):
        part = Queries(*(x[low : low + 512] for x in asked))
        estimate, slack = bounds(coded, part, error)
        upper = estimate + slack
        for n in range(len(part.ids)):
            mine = best[low + n]
            floor = max(part.floors[n], mine.scores[-1] if len(mine.scores) == k else -np.inf)
            left = np.flatnonzero((upper[:, n] >= floor) & (ids != part.ids[n]))
            left = left[np.argsort(-estimate[left, n], kind="stable")]
            while len(left):
                now, left = left[:STEP], left[STEP:]
                mine.take(cosines(rows[now], part.vectors[n]), ids[now], k)
                scored += len(now)
                if len(mine.scores) == k:
                    left = left[upper[left, n] >= mine.scores[-1]]
    return scored


def _matrix(batch: pa.RecordBatch, name: str, size: int, rows: np.ndarray) -> np.ndarray:
    lists = batch.column(batch.schema.get_field_index(name)).take(pa.array(rows))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)


def sample_rows(rows: DataFrame, bound: int = SAMPLE_ROWS) -> list[tuple[int, np.ndarray]]:
    """About ``bound`` ids at most with a vector each; a hash of the id picks them before anything moves."""
    every = max(1, -(-2 * rows.count() // bound))
    chosen = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return [(r["vec_id"], np.array(r["embedding"])) for r in chosen.orderBy(F.xxhash64("vec_id"), "vec_id").limit(bound).collect()]


def centres(sample: list[tuple[int, np.ndarray]]) -> dict[int, np.ndarray]:
    """The mean of the sample's unit vectors, for each length that it has."""
    return {size: units(np.array([v for _, v in sample if len(v) == size])).mean(axis=0) for size in sorted({len(v) for _, v in sample})}


def index(rows: DataFrame, middle: dict[int, np.ndarray], seed: int = SEED) -> DataFrame:
    """Every row's code, scalars and vector."""
    sent = rows.sparkSession.sparkContext.broadcast(middle)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                every = np.flatnonzero(sizes == size)
                for low in range(0, len(every), SHARD_ROWS):
                    at = every[low : low + SHARD_ROWS]
                    coded = encoded(_matrix(batch, "embedding", size, at), sent.value.get(size, np.zeros(size)), seed)
                    columns = [batch.column(0).take(pa.array(at)), pa.array(np.full(len(at), size, dtype=np.int32)), pa.array([c.tobytes() for c in coded.code], pa.binary()), *map(pa.array, coded[1:]), lists.take(pa.array(at))]
                    yield pa.record_batch(columns, names=["vec_id", "size", "code", "length", "toward", "along", "embedding"])

    return rows.mapInArrow(run, INDEX)


def prepared(found: list[tuple[int, np.ndarray]], sample: list[tuple[int, np.ndarray]], middle: dict[int, np.ndarray], k: int, seed: int) -> dict[int, Queries]:
    out = {}
    for size in sorted({len(v) for _, v in found}):
        ids = np.array([i for i, v in found if len(v) == size], dtype=np.int64)
        vectors = np.array([v for _, v in found if len(v) == size], dtype=np.float64)
        centre = middle.get(size, np.zeros(size))
        own = units(vectors)
        rotated = rotate(own - centre, seed)
        vectors = scaled(vectors)
        seen_ids = np.array([i for i, v in sample if len(v) == size], dtype=np.int64)
        seen = scaled(np.array([v for _, v in sample if len(v) == size], dtype=np.float64).reshape(len(seen_ids), size))
        floors = np.full(len(ids), -np.inf)
        for n in range(len(ids)) if len(seen_ids) > k else ():
            scores = np.sort(cosines(seen, vectors[n])[seen_ids != ids[n]])
            floors[n] = scores[-k]
        out[size] = Queries(ids, vectors, rotated, np.sqrt((rotated * rotated).sum(axis=1)), own @ centre - centre @ centre, floors)
    return out


def _pass(codes: DataFrame, asked, k: int, error: float) -> DataFrame:
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: dict[int, Queries] = asked.value
        best = {size: [Best() for _ in q.ids] for size, q in queries.items()}
        held: dict[int, list] = {}

        def flush(size: int) -> None:
            ids, rows, *coded = (np.concatenate(x) for x in zip(*held.pop(size)))
            for low in range(0, len(ids), SHARD_ROWS):
                part = slice(low, low + SHARD_ROWS)
                scan(ids[part], rows[part], Coded(*(x[part] for x in coded)), queries[size], best[size], k, error)

        for batch in batches:
            column = lambda name, b=batch: b.column(b.schema.get_field_index(name))
            sizes = column("size").to_numpy(zero_copy_only=False)
            for size in np.unique(sizes).tolist():
                if size not in queries:
                    continue
                at = np.flatnonzero(sizes == size)
                code = np.frombuffer(b"".join(column("code").take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), -1)
                scalars = [column(name).to_numpy(zero_copy_only=False)[at] for name in ("length", "toward", "along")]
                held.setdefault(size, []).append((column("vec_id").to_numpy(zero_copy_only=False)[at], _matrix(batch, "embedding", size, at), code, *scalars))
                if sum(len(x[0]) for x in held[size]) >= SHARD_ROWS:
                    flush(size)
        for size in list(held):
            flush(size)
        for size, q in queries.items():
            rows = [(np.full(len(b.ids), i), b.ids, b.scores) for i, b in zip(q.ids, best[size]) if len(b.ids)]
            if rows:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*rows)], schema=schema)

    return codes.mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, error: float = ERROR, query_block: int = QUERY_BLOCK, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query among the rows of ``vectors``."""
    spark = vectors.sparkSession
    nonzero = "exists(embedding, x -> x <> 0)"
    rows = usable(vectors).filter(nonzero)
    asked = usable(queries).filter(nonzero).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sample = sample_rows(rows)
    middle = centres(sample)
    codes: Stored = stored(index(rows, middle, seed))
    n_blocks = max(1, -(-asked.count() // max(1, query_block // 2)))
    found = None
    for b in range(n_blocks):
        block = [(r["vec_id"], np.array(r["embedding"])) for r in asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast(prepared(block, sample, middle, k, seed))
        part = stored(_pass(codes.df, sent, k, error)).df
        sent.destroy()
        found = part if found is None else found.union(part)
    codes.drop()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op12_one_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter(f"vec_id % {QUERY_EVERY} = 0"))
