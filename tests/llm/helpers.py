"""Inputs that every text operator has to bear: nulls, empty and long texts, ties, repeats, extra columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("bucket", T.StringType()),
    T.StructField("text_key", T.StringType()),
    T.StructField("kept", T.StringType()),
])


def frame(spark, rows, partitions=3):
    """documents of (doc_id, text), with further columns whose names the operators use themselves."""
    full = [(i, t, None, "s", None if t is None else len(t), 0.5, "b", "k", None) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(partitions)


def corpus(seed, n=60, vocabulary=40, shared=3):
    """Random texts with common passages, copies, near copies, a null, an empty and a very long text."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß漢") for _ in range(r.randint(1, 7))) for _ in range(vocabulary * 20)]
    passages = [" ".join(r.choice(words) for _ in range(r.randint(25, 60))) for _ in range(shared)]
    rows = []
    for i in range(n):
        parts = [" ".join(r.choice(words) for _ in range(r.randint(0, 50)))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(passages))
        text = r.choice(["\n", " ", "\t", "  "]).join(parts)
        if rows and r.random() < 0.2:
            text = r.choice(rows)[1] or ""
            if r.random() < 0.5 and text:
                w = text.split(" ")
                w[r.randrange(len(w))] = r.choice(words)
                text = " ".join(w)
        rows.append((i * 3, text))
    rows += [(1000, None), (1001, ""), (1002, " \n\t "), (None, passages[0]), (1003, " ".join(r.choice(words) for _ in range(30000)) + " " + passages[0]), (1004, "one")]
    rows += [(1005, passages[0] + " " + passages[0]), (1005, passages[0] + " " + passages[0])]
    return rows
