"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next stage's input. The stages are narrow maps over the rows, except near-duplicate
removal. All but the last return the columns of ``documents``. Rows with null values
pass through; rows without doc_id are judged by their texts alone. The stages set their session's Arrow batches to
``BATCH_ROWS`` rows: texts may be long, and whole batches lie in an executor's memory beside its heap.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from meshwork.llm import decontamination, pii, sentencepiece_nbest, simhash, toxicity
from meshwork.llm.common import stored, table


BATCH_ROWS = 1_000


def bounded(stage):
    """The stage, with small Arrow batches."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@bounded
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier scores below one half."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


@bounded
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component, that of smallest doc_id."""
    return simhash.keep_one(docs)


@bounded
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.keep_uncontaminated(docs, table(spark, sf_dir, "benchmark"))


@bounded
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts masked by its kind."""
    return pii.redact(docs)


@bounded
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, score, ids) of each document's best segmentation, the same of the next one (second_), and round_trip."""
    return sentencepiece_nbest.best_ids(docs, remembered=120_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("sentencepiece", encode_pieces),
]

#: No stage but personal data could be put in SQL; the run is tested against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        after = stored(stage(spark, docs, sf_dir))
        if before:
            before.drop()
        docs, before = after.df, after
    return STAGES[-1][1](spark, docs, sf_dir)
