import math
import random

from pyspark.sql import types as T

from meshwork.llm import topk_search as op

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])


def brute(rows, k, every=100):
    rows = [(i, [math.floor(1024 * x) for x in v]) for i, v, *_ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in {q: a for q, a in rows if q % every == 0}.items():
        found = sorted((-sum(x * y for x, y in zip(a, v)), i) for i, v in rows if i != q and len(v) == len(a))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


def rounded(v):
    return [struct_float(x) for x in v]


def struct_float(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


def vectors(seed, n=700, size=6):
    r = random.Random(seed)
    rows = [(k, rounded(r.gauss(0, 1) for _ in range(size)), k % 3, "x") for k in range(n)]
    common = rounded(r.gauss(0, 1) for _ in range(size))
    rows = [(k, common if k % 3 == 1 or k == 300 else v, c, s) for k, v, c, s in rows]
    rows += [(5000, None, 1, "x"), (5001, [None] * size, 1, "x"), (5100, [float("nan")] * size, 1, "x"), (5200, [float("inf")] * size, 1, "x"), (None, common, 1, "x"), (5300, [1.0, 2.0], 1, "x"), (5301, [0.5, 2.0], 1, "x"), (9, common, 1, "x"), (100, rows[100][1], 1, "x")]
    return rows


def test_equals_brute_force(spark):
    rows = vectors(1)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for shard, block in ((64, 3), (8192, 4096)):
        got = sorted(tuple(r) for r in op.top_k(df, df.filter("vec_id % 100 = 0"), query_block=block, shard=shard).collect())
        assert got == brute(rows, 10)


def test_large_components_stay_exact(spark):
    r = random.Random(2)
    rows = [(k, rounded(r.uniform(-2e5, 2e5) for _ in range(4)), 0, "x") for k in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(x) for x in op.top_k(df, df.filter("vec_id % 10 = 0"), k=3).collect()) == brute(rows, 3, 10)


def test_huge_components_stay_exact(spark):
    """Doubles up to the greatest: products far beyond any double, one row or query among ordinary ones."""
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType()), T.StructField("score", T.StringType())])
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 1) for _ in range(3)], 0, "x") for k in range(80)]
    rows += [(100, [1e306, -1.5, 0.25], 0, "x"), (101, [1.7e308, 1.0, 1.0], 0, "x"), (102, [-1e200, 3.0, 1e-300], 0, "x"), (103, [9e15, 0.5, 0.5], 0, "x"), (110, [2.0**53 + 2, 1.0, 7.0], 0, "x")]
    df = spark.createDataFrame(rows, schema)
    ends = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    whole = {i: [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v] for i, v, *_ in rows}
    want = []
    for q in (i for i in whole if i % 10 == 0):
        found = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:5]
        want += [(q, ends(-s)) for s, _ in found]
    got = [(x.query_id, x.score) for x in op.top_k(df, df.filter("vec_id % 10 = 0"), k=5, shard=32).collect()]
    assert sorted(got) == sorted(want)


def test_queries_from_outside_the_table(spark):
    """Queries that are no rows reach only rows: what they score among themselves says nothing."""
    r = random.Random(4)
    rows = [(k, rounded(r.gauss(0, 1) for _ in range(5)), 0, "x") for k in range(300)]
    asked = [(10_000 + k, rounded(r.gauss(3, 30) for _ in range(5)), 0, "x") for k in range(20)] + [(5, rounded(r.gauss(0, 1) for _ in range(5)), 0, "x")]
    got = sorted(tuple(x) for x in op.top_k(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(asked, SCHEMA), shard=64, query_block=8).collect())
    want = []
    for q, v, *_ in asked:
        a = [math.floor(1024 * x) for x in v]
        found = sorted((-sum(x * math.floor(1024 * y) for x, y in zip(a, w)), i) for i, w, *_ in rows if i != q)
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:10])]
    assert got == sorted(want)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.0], 0, "x"), (1, [2.0], 0, "x")], SCHEMA)
    assert [tuple(r) for r in op.top_k(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 2048 * 1024)]
    assert op.top_k(df.filter("false"), df.filter("false")).collect() == []
