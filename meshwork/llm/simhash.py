"""SimHash near-duplicates by multi-index hashing.

Method. A text's fingerprint has a bit for each of 64 majorities over the XXH64 hashes of its word
shingles. Fingerprints link at ``RADIUS`` or fewer differing bits. The 64 bits are cut into segments:
if two fingerprints differ in at most r bits, then with m segments, a = r div m and b = r mod m,
either one of the first b + 1 segments differs in at most a bits or one of the others in at most
a - 1. Each fingerprint is put into a table under its segment values; it is looked up
under every value within that small Hamming ball of its own segments; what meets is verified on all 64
bits inside the join. Components are then found over the links.

Scale. Documents collapse to distinct fingerprints (a partial aggregate) before anything is looked up,
so thousands of copies cost one fingerprint. A fingerprint has a fixed number of lookups, whatever the corpus: 45 with three
segments; two segments (``segments=2``, 562 lookups) give the same links and pay where billions of fingerprints crowd
the tables. Verification is a condition of the join, and what it finds leaves a task as a spanning forest: m near
fingerprints send m - 1 links, not all their pairs. A hot segment value, component or fingerprint is a skewed sort-merge
join of two plain shuffles, which adaptive execution splits. Fingerprints, links and labels stay in tables in the shared folder.

Edge cases. A null, empty or blank text has fingerprint zero and links like any other; a text of
fewer words than a shingle is one shingle. Rows without doc_id take no part. Repeated rows and
rows that share a doc_id each give a row; a component's id is its smallest doc_id. An empty table
gives an empty result. Other columns are ignored. :func:`keep_one` tells rows of one doc_id apart by their texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, named, stored, table, text_blocks
from .components import components, spanning_forest

SHINGLE = 4
RADIUS = 4
SEED = 42
SEGMENTS = 3


def shingles(text: bytes, size: int) -> list[bytes]:
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[k:] for k in range(size)))))


def fingerprint_table(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, text_key, fingerprint as a signed long); text_key is a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh64_intdigest
        for block in text_blocks(batches, max_bytes=1 << 20):
            n = len(block.offsets) - 1
            each = [[hashed(s, SEED) for s in shingles(block.text(i), size)] for i in range(n)]
            counts = np.fromiter(map(len, each), dtype=np.int64, count=n)
            prints = np.zeros(n, dtype=U64)
            full = np.flatnonzero(counts)
            if len(full):
                hashes = np.concatenate([np.array(x, dtype=U64) for x in each if x])
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                heads = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
                ones = np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
                prints[full] = np.packbits(2 * ones > counts[full][:, None], axis=1, bitorder="little").view(U64).ravel()
            yield pa.record_batch([block.column("doc_id"), block.column("text_key"), pa.array(prints.view(np.int64), pa.int64())], names=["doc_id", "text_key", "fingerprint"])

    keyed = named(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, fingerprint long")


def segment_balls(segments: int, radius: int, bits: int = 64) -> list[tuple[int, int, list[int]]]:
    """(shift, width, flips) of each segment: the bit patterns within its share of the radius."""
    a, b = divmod(radius, segments)
    widths = [bits // segments + (k >= segments - bits % segments) for k in range(segments)]
    out, shift = [], 0
    for k, width in enumerate(widths):
        reach = a if k <= b else a - 1
        flips = [sum(1 << i for i in on) for d in range(reach + 1) for on in combinations(range(width), d)]
        out.append((shift, width, flips))
        shift += width
    return out


def fingerprint_links(prints: DataFrame, radius: int, segments: int) -> DataFrame:
    """(a, b): pairs of distinct fingerprints, a < b, at most ``radius`` bits apart. ``prints`` has one column f."""
    balls = segment_balls(segments, radius)

    def slot(k: int, shift: int, width: int) -> str:
        # the segment's number above its bits
        return f"shiftleft({k}L, 56) | (shiftrightunsigned(f, {shift}) & {(1 << width) - 1}L)" if width < 56 else f"f ^ {k}L"

    held = prints.selectExpr("f AS b", f"explode(array({', '.join(slot(k, s, w) for k, (s, w, _) in enumerate(balls))})) AS slot")
    asked = None
    for k, (shift, width, flips) in enumerate(balls):
        own = prints.selectExpr("f AS a", f"{slot(k, shift, width)} AS own")
        part = own.select("a", F.explode(F.transform(F.array(*[F.lit(x).cast("long") for x in flips]), lambda x: x.bitwiseXOR(F.col("own")))).alias("slot")) if len(flips) > 1 else own.withColumnRenamed("own", "slot")
        asked = part if asked is None else asked.union(part)
    return asked.hint("merge").join(held.hint("merge"), "slot").filter(f"a < b AND bit_count(a ^ b) <= {radius}").select("a", "b")


def labelled(docs: DataFrame, radius: int, size: int, segments: int) -> DataFrame:
    """(doc_id, text_key, fingerprint, root, component_id): root is the least fingerprint of the component."""
    prints = stored(fingerprint_table(docs, size))
    classes = stored(prints.df.groupBy(F.col("fingerprint").alias("f")).agg(F.min("doc_id").alias("first")))
    links = stored(spanning_forest(fingerprint_links(classes.df.select("f"), radius, segments)))
    roots = components(links.df)
    links.drop()
    # every table below is stored before it is joined, so that no join sits on an aggregate of its own key
    rooted = stored(classes.df.join(roots.df.withColumnsRenamed({"a": "f", "b": "root"}), "f", "left").withColumn("root", F.coalesce("root", "f")))
    least = stored(rooted.df.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = stored(rooted.df.join(least.df, "root").select(F.col("f").alias("fingerprint"), "root", "component_id"))
    for table_ in (classes, roots, rooted, least):
        table_.drop()
    return prints.df.join(labels.df, "fingerprint").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row for each document."""
    return labelled(docs, radius, size, segments).select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE, segments: int = SEGMENTS) -> DataFrame:
    """``docs`` with one row of each component, that of smallest doc_id (of several, of least text_key); rows without doc_id stay."""
    found = stored(labelled(docs, radius, size, segments))
    first = stored(found.df.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("kept")))
    dropped = found.df.join(first.df, "root").filter("struct(doc_id, text_key) <> kept").select("doc_id", "text_key").distinct()
    return one_row_each(docs.join(dropped, _same(docs, dropped), "left_anti"), found.df)


def _same(docs: DataFrame, keys: DataFrame) -> Column:
    return (docs["doc_id"] == keys["doc_id"]) & (F.xxhash64(docs["text"]) == keys["text_key"])


def one_row_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with one of several rows of equal doc_id and text; texts are only grouped where ``found`` has such rows."""
    twice = found.groupBy("doc_id", "text_key").count().filter("count > 1").select("doc_id", "text_key")
    if twice.isEmpty():
        return docs
    several = docs.join(twice, _same(docs, twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return docs.join(twice, _same(docs, twice), "left_anti").unionByName(several)


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
