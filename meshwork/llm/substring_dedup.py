"""Substring dedup: remove words that lie in a window of words seen earlier in the corpus.

Method. Every window of ``width`` consecutive words of a text gets a 64-bit Rabin-Karp hash. The
windows of one chunk of rows are combined on the map side: of several equal windows only the first is
sent on, the others are repeats already. What is sent is dealt by hash, each reducer counts its
windows, and every occurrence behind a window's first one is reported back to its document.
Reported windows merge into maximal intervals, whose words are removed.

Scale. A window sends about twelve bytes (its hash and its place), packed by chunk and hash bucket. A hot
passage, in a third of all rows, sends one entry for each chunk, as a partial aggregate would.
Reports are packed by document bucket and written to the shared folder, after which the
window shuffle is released before the texts move. The number of buckets follows the input,
so that one bucket stays near ``WINDOWS_PER_BUCKET`` whatever the corpus size.

Edge cases. A null text has no words. Texts of fewer than ``width`` words lose nothing. Rows without
doc_id take no part. Rows with the same doc_id count as one document as far as order goes (windows
at the same doc_id and start never remove each other); each keeps its own result row. An empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, U64, named, stored, table, text_blocks, window_hashes, word_hashes, word_spans

WIDTH = 20
WINDOWS_PER_CHUNK = 1_500_000
WINDOWS_PER_BUCKET = 2_500_000
TEXT_BYTES_PER_BUCKET = 8 << 20
#: A document's windows are addressed by page and 16-bit offset.
PAGE_BITS = 16
#: text: the text's hash, which tells rows that share a doc_id apart; more: windows of the entry less one.
ENTRY = np.dtype([("doc", "<i8"), ("text", "<i8"), ("page", "<u2"), ("more", "<u2")])
#: Repeated rows of one doc_id can have more windows on a page: they take several entries.
WINDOWS_PER_ENTRY = 1 << 16
PACKED = pa.schema([("bucket", pa.int64()), ("payload", pa.binary())])


def _pack(docs: np.ndarray, texts: np.ndarray, starts: np.ndarray, hashes: np.ndarray | None) -> bytes:
    """Windows in order of document and start, as a table of pages, 16-bit offsets and hashes."""
    page = (starts >> PAGE_BITS).astype(np.uint16)
    change = np.flatnonzero((docs[1:] != docs[:-1]) | (texts[1:] != texts[:-1]) | (page[1:] != page[:-1])) + 1
    first = np.concatenate([[0], change])
    sizes = np.diff(np.append(first, len(docs)))
    if sizes.max() > WINDOWS_PER_ENTRY:
        first = np.concatenate([np.arange(a, a + n, WINDOWS_PER_ENTRY) for a, n in zip(first, sizes)])
    entries = np.empty(len(first), dtype=ENTRY)
    entries["doc"], entries["text"], entries["page"] = docs[first], texts[first], page[first]
    entries["more"] = np.diff(np.concatenate([first, [len(docs)]])) - 1
    parts = [np.array([len(entries), len(docs)], dtype="<i8").tobytes(), entries.tobytes(), (starts & 0xFFFF).astype("<u2").tobytes()]
    if hashes is not None:
        parts.append(hashes.astype("<u8").tobytes())
    return b"".join(parts)


def _unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Documents, text keys, starts and (if there are any) hashes."""
    n_entries, n = (int(x) for x in np.frombuffer(payload, "<i8", 2))
    entries = np.frombuffer(payload, ENTRY, n_entries, 16)
    at = 16 + n_entries * ENTRY.itemsize
    counts = entries["more"].astype(np.int64) + 1
    starts = np.repeat(entries["page"].astype(np.int64) << PAGE_BITS, counts) + np.frombuffer(payload, "<u2", n, at)
    at += 2 * n
    hashes = np.frombuffer(payload, "<u8", n, at) if len(payload) > at else np.zeros(0, dtype=U64)
    return np.repeat(entries["doc"], counts), np.repeat(entries["text"], counts), starts, hashes


def _later(docs: np.ndarray, starts: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For rows sorted by group, document and start: whether the row is behind its group's first place."""
    new = np.concatenate([[True], groups[1:] != groups[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(groups)), 0))
    return (docs != docs[first]) | (starts != starts[first])


def _by_bucket(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for rows in np.split(order, cuts):
        if len(rows):
            yield int(keys[rows[0]]), rows


def _send(width: int, n_hash: int):
    """Map side: windows to hash buckets 0.., repeats within the chunk to document buckets -1.."""

    def chunk(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        docs, texts, starts, hashes, to = (np.concatenate(x) for x in zip(*held))
        ascending = ((docs[1:] > docs[:-1]) | ((docs[1:] == docs[:-1]) & (starts[1:] > starts[:-1]))).all()
        in_order = np.arange(len(docs)) if ascending else np.lexsort((starts, texts, docs))
        order = in_order if ascending else np.lexsort((texts, starts, docs))
        order = order[np.argsort(hashes[order], kind="stable")]
        later = np.zeros(len(docs), dtype=bool)
        later[order] = _later(docs[order], starts[order], hashes[order])
        firsts, repeats = in_order[~later[in_order]], in_order[later[in_order]]
        buckets, payloads = [], []
        for b, at in _by_bucket((hashes[firsts] % U64(n_hash)).astype(np.int64)):
            rows = firsts[at]
            buckets.append(b)
            payloads.append(_pack(docs[rows], texts[rows], starts[rows], hashes[rows]))
        for b, at in _by_bucket(to[repeats]):
            rows = repeats[at]
            buckets.append(-1 - b)
            payloads.append(_pack(docs[rows], texts[rows], starts[rows], None))
        return pa.record_batch([pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], schema=PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for block in text_blocks(batches):
            starts, ends, bounds = word_spans(block.data, block.offsets)
            hashes, first = window_hashes(word_hashes(block.data, starts, ends), bounds, width)
            if len(hashes):
                row = np.searchsorted(bounds, first, "right") - 1
                held.append((block.column("doc_id")[row], block.column("text_key")[row], first - bounds[row], hashes, block.column("doc_bucket")[row]))
                n += len(hashes)
            if n >= WINDOWS_PER_CHUNK:
                yield chunk(held)
                held, n = [], 0
        if held:
            yield chunk(held)

    return run


def _count(n_doc: int):
    """Reduce side: of all places of a window, report those behind the first."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket < 0:
            return pa.table([pa.array([-1 - bucket] * len(group), pa.int64()), group.column("payload")], schema=PACKED)
        docs, texts, starts, hashes = (np.concatenate(x) for x in zip(*map(_unpack, group.column("payload").to_pylist())))
        order = np.argsort(hashes)
        ordered = hashes[order]
        same = ordered[1:] == ordered[:-1]
        many = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        many = many[np.lexsort((texts[many], starts[many], docs[many], hashes[many]))]
        if len(many):
            many = many[_later(docs[many], starts[many], hashes[many])]
        many = many[np.lexsort((starts[many], texts[many], docs[many]))]
        buckets, payloads = [], []
        for b, at in _by_bucket(bucket_of(docs[many], texts[many], n_doc)):
            rows = many[at]
            buckets.append(b)
            payloads.append(_pack(docs[rows], texts[rows], starts[rows], None))
        return pa.table([pa.array(buckets, pa.int64()), pa.array(payloads, pa.binary())], schema=PACKED)

    return run


def bucket_of(docs: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """The bucket of ids and text keys, so that neither one id nor one text fills it; :func:`bucket_column` is the same in SQL."""
    return ((docs.astype(np.int64) % 1_000_000_007) * 40503 + (texts.astype(np.int64) % 1_000_000_007) * 30011 >> 3) % n


def bucket_column(n: int) -> F.Column:
    return F.expr(f"pmod(shiftright(pmod(doc_id, 1000000007L) * 40503L + pmod(text_key, 1000000007L) * 30011L, 3), {n}L)")


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("intervals", pa.list_(pa.int64())), ("kept", pa.string())])


def _remove(width: int):
    """Words of each text without the intervals covered by reported windows."""

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        places: dict[tuple[int, int], np.ndarray] = {}
        if len(reports):
            docs, keys, starts, _ = (np.concatenate(x) for x in zip(*map(_unpack, reports.column("payload").to_pylist())))
            order = np.lexsort((starts, keys, docs))
            docs, keys, starts = docs[order], keys[order], starts[order]
            cuts = np.flatnonzero((np.diff(docs) != 0) | (np.diff(keys) != 0)) + 1
            heads = np.concatenate([[0], cuts])
            places = {(int(docs[h]), int(keys[h])): s for h, s in zip(heads, np.split(starts, cuts))}
        out: list[list] = [[], [], [], [], []]
        for doc, key, text in zip(texts.column("doc_id").to_pylist(), texts.column("text_key").to_pylist(), texts.column("text")):
            words = (text.as_py() or "").encode().split()
            at = places.get((doc, key))
            spans: list[int] = []
            kept = words
            if at is not None:
                step = np.zeros(len(words) + 1, dtype=np.int32)
                np.add.at(step, at, 1)
                np.add.at(step, at + width, -1)
                covered = np.cumsum(step[:-1]) > 0
                edge = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8)))
                spans = edge.tolist()
                kept = list(compress(words, (~covered).tolist()))
            for column, value in zip(out, (doc, len(words), len(words) - len(kept), spans, b" ".join(kept).decode())):
                column.append(value)
        return pa.table([pa.array(x, f.type) for x, f in zip(out, OUT)], schema=OUT)

    return run


def _digest(width: int):
    inner = _remove(width)

    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        found = inner(texts, reports)
        sha = [hashlib.sha256(x.as_py().encode()).hexdigest() for x in found.column("kept")]
        return found.drop_columns(["kept", "intervals"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return run


def repeated_windows(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, Stored]:
    """The prepared texts and the stored reports, both by document bucket."""
    docs = named(docs, "doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()["bytes"]
    n_hash = max(1, -(-size // (6 * WINDOWS_PER_BUCKET)))
    n_doc = max(1, -(-size // TEXT_BYTES_PER_BUCKET))
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).withColumn("doc_bucket", bucket_column(n_doc))
    schema = "bucket long, payload binary"
    # written with its shuffle freed at once: the windows' shuffle is gone before the texts move
    reports = stored(texts.mapInArrow(_send(width, n_hash), schema).groupBy("bucket").applyInArrow(_count(n_doc), schema))
    return texts, reports


def _joined(docs: DataFrame, width: int, function, schema: str) -> DataFrame:
    texts, reports = repeated_windows(docs, width)
    dealt = texts.withColumnRenamed("doc_bucket", "bucket")
    return dealt.groupBy("bucket").cogroup(reports.df.groupBy("bucket")).applyInArrow(function, schema)


def substring_dedup(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_words, n_removed, intervals, kept): removal intervals as word indices (from, to, from, to ...)."""
    return _joined(docs, width, _remove(width), "doc_id long, n_words long, n_removed long, intervals array<long>, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(table(spark, sf_dir, "documents"), WIDTH, _digest(WIDTH), "doc_id long, n_words long, n_removed long, kept_sha256 string")


#: The same by strings of whole windows; for tables whose doc_ids differ.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
p AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS s FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, s, array_to_string(w[s:s + 19], ' ') AS k FROM p),
o AS (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM k),
g AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM o WHERE n > 1),
c AS (SELECT doc_id, list(i) AS gone FROM g GROUP BY doc_id),
x AS (SELECT d.doc_id, d.w, coalesce(c.gone, []) AS gone FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
r AS (SELECT x.doc_id, len(w) AS n_words, len(gone) AS n_removed, CASE WHEN len(gone) = 0 THEN w ELSE (SELECT list(w[j] ORDER BY j) FROM (SELECT unnest(range(1, len(w) + 1)) AS j) q WHERE NOT list_contains(gone, j)) END AS kept FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(n_removed AS BIGINT) AS n_removed, sha256(array_to_string(coalesce(kept, []), ' ')) AS kept_sha256 FROM r
"""
