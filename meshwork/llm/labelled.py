"""The bounded sample of labelled rows that the two text classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows with this remainder are held out: their labels are never read.
HELD_OUT = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0"


def unlabelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(text, label) of about ``bound`` ids at most that have no row in ``labels`` and are not held out; label is null.

    A hash of the id picks them from all documents before anything is joined.
    """
    ids = docs.select("doc_id").filter(f"doc_id IS NOT NULL AND NOT ({HELD_OUT})")
    every = max(1, -(-ids.count() // bound))
    chosen = F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0
    own = ids.filter(chosen).distinct().join(labels.select("doc_id").filter(chosen), "doc_id", "left_anti").orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    found = docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    return found.select("text", F.lit(None).cast("int").alias("label"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """(text, label) of at most ``bound`` labelled ids that are not held out, chosen by a hash of the id; one row for each.

    The ids are bounded, so they are broadcast to the texts. Before they are put in order, all but about one and a half times the
    bound go by their hashes, wherever they lie, so that the task that orders them gets few. An id with several labels counts as 1 if any is; of several
    texts of an id the least is taken, so repeated rows do not add to the sample.
    """
    own = labels.select("doc_id", F.col(label).cast("int").alias("label")).filter(f"doc_id IS NOT NULL AND label IS NOT NULL AND NOT ({HELD_OUT})")
    n = own.agg(F.approx_count_distinct("doc_id")).first()[0]
    # hashes are spread evenly from -2**63 on
    if n > 1.5 * bound:
        own = own.filter(F.xxhash64("doc_id") <= F.lit(int((1.5 * bound / n - 0.5) * 2**64)))
    own = own.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    return docs.select("doc_id", "text").join(F.broadcast(own), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label")
