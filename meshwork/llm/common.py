"""Shared plumbing: shared-folder tables, bounded text blocks and vectorised word hashing.

Texts reach Python as Arrow batches. :func:`text_blocks` cuts every batch into blocks of a few
megabytes (one very long text makes a block of its own), so what an operator builds from a block is bounded
by the block size and the longest text, not by the batch. A block's texts lie end to end in one byte
array, on which words are found and hashed without a Python loop.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64
#: ASCII white space: the word separators of every operator here.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Odd multiplier of the Rabin-Karp polynomials over word hashes, modulo 2**64, and its inverse.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set and all runs on one machine (tests)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meshwork-"))
    return sc.getCheckpointDir()


class Stored(NamedTuple):
    """A table written to the shared folder: it survives lost executors and has no lineage."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Spark deletes the shuffle files of a write made in here as soon as it has ended."""
    before = spark.conf.get(FREE_SHUFFLES, None)
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(FREE_SHUFFLES) if before is None else spark.conf.set(FREE_SHUFFLES, before)


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Python workers get Arrow batches of so many rows in the jobs that run in here: whole batches lie in memory beside the heap."""
    before = spark.conf.get(BATCH_ROWS)
    spark.conf.set(BATCH_ROWS, rows)
    try:
        yield
    finally:
        spark.conf.set(BATCH_ROWS, before)


def stored(df: DataFrame) -> Stored:
    """Write ``df`` as Parquet to the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    with shuffles_freed(spark):
        df.select("*").write.parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


class Block(NamedTuple):
    """Some rows of a batch; text i is ``data[offsets[i]:offsets[i + 1]]``, a null text is empty."""

    rows: pa.RecordBatch
    offsets: np.ndarray
    data: np.ndarray

    def column(self, name: str) -> np.ndarray:
        return self.rows.column(self.rows.schema.get_field_index(name)).to_numpy(zero_copy_only=False)

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()


def text_blocks(batches: Iterable[pa.RecordBatch], column: str = "text", max_bytes: int = 2 << 20) -> Iterator[Block]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        at = batch.schema.get_field_index(column)
        array = batch.column(at)
        if array.null_count:
            array = pc.fill_null(array, "")
        _, offsets, data = array.buffers()
        offsets = np.frombuffer(offsets, dtype=np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
        data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        low = 0
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + max_bytes, "right")) - 1)
            high = min(high, n)
            yield Block(batch.slice(low, high - low), offsets[low : high + 1] - offsets[low], data[offsets[low] : offsets[high]])
            low = high


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each text the index of its first word (n + 1 values)."""
    return run_spans(~SPACE[data], offsets)


def run_spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As :func:`word_spans`, of the maximal runs of marked bytes."""
    if not len(word):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    before = np.empty_like(word)
    before[0], before[1:] = False, word[:-1]
    before[offsets[:-1][offsets[:-1] < len(word)]] = False
    after = np.empty_like(word)
    after[-1], after[:-1] = False, word[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    return starts, np.flatnonzero(word & ~after) + 1, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word's bytes, alike in every process.

    Words are taken eight bytes at a time, all words of a block together, and every step goes through the
    finaliser, so no arithmetic structure of the bytes survives.
    """
    sizes = ends - starts
    out = mixed(sizes.astype(U64) * U64(BASE))
    if not len(starts):
        return out
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    at = np.flatnonzero(sizes <= LONG_WORD)
    done = 0
    while len(at):
        left = sizes[at] - done
        chunk = eight[starts[at] + done]
        short = left < 8
        chunk[short] &= (U64(1) << (left[short] * 8).astype(U64)) - U64(1)
        out[at] = mixed(out[at] ^ chunk)
        done += 8
        at = at[left > 8]
    for k in np.flatnonzero(sizes > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(data[starts[k] : ends[k]].tobytes(), 42)
    return out


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of BASE and of its inverse; those of an ordinary block are kept."""
    if _POWERS and len(_POWERS[0]) >= n:
        return _POWERS[0][:n], _POWERS[1][:n]
    made = []
    for base in (BASE, BASE_INVERSE):
        x = np.full(max(n, 1 << 19), base, dtype=U64)
        x[0] = 1
        made.append(np.cumprod(x, dtype=U64))
    if len(made[0]) == 1 << 19:
        _POWERS[:] = made
    return made[0][:n], made[1][:n]


def window_hashes(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``width`` words inside one text, and each one's first word.

    The polynomial over the word hashes is taken from prefix sums, so a window costs a
    subtraction and a product whatever its width.
    """
    n = len(words)
    counts = np.maximum(bounds[1:] - bounds[:-1] - width + 1, 0)
    if not counts.sum():
        return np.zeros(0, dtype=U64), np.zeros(0, dtype=np.int64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, dtype=U64)
    np.cumsum(words * up[:n], out=total[1:])
    first = np.repeat(bounds[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
    return mixed((total[first + width] - total[first]) * down[first]), first


def named(df: DataFrame, *columns: str) -> DataFrame:
    """Only ``columns`` of ``df``, without rows whose id (the first of them) is null."""
    return df.select(*columns).filter(f"`{columns[0]}` IS NOT NULL")
