"""Token counts: an exact histogram of encoded lengths that answers every context limit.

Method. Each text is encoded with a public byte-level BPE vocabulary and only its length is
kept. Lengths are counted per distinct value, so totals, quantiles and truncated totals come from
suffix sums over the histogram instead of from the documents.

Scale. Encoding is one narrow map; the shuffle carries one row for each distinct length and task.
Suffix sums run in two levels (blocks of lengths, then lengths of a block), so no task sees the
whole histogram. The vocabulary file is read on the driver and sent with the plan (its size
is checked against ``MAX_VOCABULARY_BYTES``).

Edge cases. A null text counts as an empty one, of length zero. Repeated rows and rows without doc_id
count like any other. Special-token strings in a text are ordinary text. An empty table gives an
empty histogram. Other columns are ignored. Very long texts are encoded in pieces cut between a
word and the space before the next one, where no pre-token spans the cut.
"""

from __future__ import annotations

import base64
import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table, text_blocks

VOCABULARY = os.environ.get("MESHWORK_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
MAX_VOCABULARY_BYTES = 16 << 20
#: Fixed value: the pre-token pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PIECE = 1 << 16
BLOCK = 256
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")
_ENCODERS: dict[int, object] = {}


def read_vocabulary(path: str) -> bytes:
    if os.path.getsize(path) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    with open(path, "rb") as f:
        return f.read()


def encoder(vocabulary: bytes):
    """The encoder of a vocabulary, made once in each Python worker."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _ENCODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _ENCODERS[key] = tiktoken.Encoding("length", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[key]


def encoded_length(encode, text: str, piece: int = PIECE) -> int:
    total = at = 0
    while len(text) - at > piece and (m := _SAFE_CUT.search(text, at + piece)):
        total += len(encode(text[at : m.start()]))
        at = m.start()
    return total + len(encode(text[at:] if at else text))


def token_lengths(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        for block in text_blocks(batches):
            n = [encoded_length(encode, x) if x else 0 for x in block.rows.column(1).to_pylist()]
            yield pa.record_batch([block.rows.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long")


def length_histogram(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """(length, n_docs) of all rows; each task counts its own rows first."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary.value).encode_ordinary
        counts: Counter[int] = Counter()
        for block in text_blocks(batches):
            counts.update(encoded_length(encode, x) if x else 0 for x in block.rows.column(0).to_pylist())
        yield pa.record_batch([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["length", "n"])

    return docs.select("text").mapInArrow(run, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """For every length as a context limit: how many documents reach it and the tokens left after truncation.

    docs_at_least and tokens_at_least cover documents of this length or more; truncated_total is the
    sum of min(length, this limit) over all documents; total_tokens that of all lengths.
    """
    block = histogram.withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = block.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    # one row for each BLOCK lengths that occur: the second level's table of totals
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("d").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("t").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("all_docs"),
        F.sum("t").over(everything).alias("total_tokens"),
    )
    own = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    rows = block.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.sum("n_docs").over(own) + F.col("docs_above")).alias("docs_at_least"),
        (F.sum(F.col("n_docs") * F.col("length")).over(own) + F.col("tokens_above")).alias("tokens_at_least"),
        "all_docs",
        "total_tokens",
    )
    longer = F.col("docs_at_least") - F.col("n_docs")
    return rows.select(
        "length",
        "n_docs",
        "docs_at_least",
        "tokens_at_least",
        (F.col("total_tokens") - F.col("tokens_at_least") + F.col("docs_at_least") * F.col("length")).alias("truncated_total"),
        (F.col("all_docs") - longer).alias("docs_at_most"),
        "all_docs",
        "total_tokens",
    )


def length_quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of all documents does not exceed."""
    wanted = sums.sparkSession.createDataFrame([(float(s),) for s in shares], "share double")
    reached = F.col("docs_at_most") >= F.col("share") * F.col("all_docs")
    return sums.join(F.broadcast(wanted), reached).groupBy("share").agg(F.min("length").alias("length"))


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens): tokens left when every document is cut to the limit."""
    each = [F.sum(F.least("length", F.lit(k)) * F.col("n_docs")).alias(str(k)) for k in limits]
    one = histogram.agg(*each)
    pairs = ", ".join(f"{k}L, coalesce(`{k}`, 0L)" for k in limits)
    return one.selectExpr(f"stack({len(limits)}, {pairs}) AS (`limit`, tokens)")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The length histogram of all documents with its suffix sums.

    The sums use the histogram twice, so it is stored: texts are encoded once.
    """
    return suffix_sums(stored(length_histogram(table(spark, sf_dir, "documents"))).df)
