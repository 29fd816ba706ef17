"""Driving iterative plans: each state is a table in the shared folder, so lineage stays one step long.

A state that is written survives lost executors, and reading it back gives Catalyst a scan instead of a
plan that grows by every round.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from itertools import count
from math import ceil
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

from meshwork.errors import ConfigurationError

#: Rows of a stored table that one task of a round gets, about.
ROWS_A_TASK = 1 << 19

_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where none is configured and all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="meshwork-"))
    return sc.getCheckpointDir()


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    _PATHS[read] = path
    return read


def dealt(stored: DataFrame, key: str, n_state: int) -> Callable[[DataFrame], DataFrame]:
    """What deals tables by ``key`` to so many tasks that one gets a bounded share of ``stored`` (one count, from the files' footers).

    As long as Spark's own number of partitions will do, or a state of ``n_state`` rows is small enough to be sent, it leaves them as they are.
    """
    tasks = ceil(stored.count() / ROWS_A_TASK)
    few = n_state <= ROWS_A_TASK or tasks <= int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return lambda df: df if few else df.repartition(tasks, key)


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`materialised` that no plan reads any more."""
    if name := _PATHS.pop(df, None):
        discard_path(df.sparkSession, name)


def discard_path(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def iterate(state: DataFrame, step: Callable[[DataFrame], DataFrame], done: Callable[[DataFrame, DataFrame], bool], max_iter: int | None = None) -> tuple[DataFrame, DataFrame, bool]:
    """Apply ``step`` until ``done(before, after)``, ``max_iter`` times at most where it is given; returns the last two states and whether it was done."""
    before = after = materialised(state)
    for _ in count() if max_iter is None else range(max_iter):
        if before is not after:
            discard(before)
        before, after = after, materialised(step(after))
        if done(before, after):
            return before, after, True
    return before, after, False
