import random

import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meshwork.llm import simhash as op
from meshwork.llm.common import stored
from meshwork.llm.components import components, spanning_forest
from tests.llm.helpers import corpus, frame


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def union(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows, radius=4):
    prints = [(i, fingerprint(t)) for i, t in rows if i is not None]
    distinct = sorted({f for _, f in prints})
    classes = union(distinct, [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if (a ^ b).bit_count() <= radius])
    least = {}
    for i, f in prints:
        least[classes[f]] = min(least.get(classes[f], i), i)
    return sorted((i, f"{f:016x}", least[classes[f]]) for i, f in prints)


@pytest.mark.parametrize("segments", [3, 2, 4])
def test_equals_brute_force(spark, segments):
    rows = corpus(11, n=120)
    long_one = " ".join(f"q{i}" for i in range(400))
    rows += [(2000 + k, long_one + " " + " ".join(f"z{j}" for j in range(k))) for k in range(12)]
    got = sorted(tuple(r) for r in op.near_duplicates(frame(spark, rows), segments=segments).collect())
    want = brute(rows)
    assert got == want
    assert len({c for *_, c in want}) < len({f for _, f, _ in want}), "no near copies in the fixture"


def test_links_equal_all_pairs(spark):
    r = random.Random(1)
    seeds = [r.getrandbits(64) for _ in range(60)]
    values = {s ^ sum(1 << b for b in r.sample(range(64), d)) for s in seeds for d in range(7)} | {0, 1, (1 << 64) - 1}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    df = spark.createDataFrame([(x,) for x in signed.values()], T.StructType([T.StructField("f", T.LongType())]))
    want = {tuple(sorted((signed[a], signed[b]))) for a in values for b in values if a < b and (a ^ b).bit_count() <= 4}
    for segments in (2, 3, 4, 5):
        got = [tuple(x) for x in op.fingerprint_links(df, 4, segments).collect()]
        assert set(got) == want


def test_keep_one(spark):
    rows = corpus(12, n=50)
    df = frame(spark, rows)
    kept = op.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for *_, c in brute(rows)})
    assert None in ids


def test_empty_table(spark):
    assert op.near_duplicates(frame(spark, [])).collect() == []


def test_components(spark):
    r = random.Random(4)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)] + [(5000, k) for k in range(5001, 5200)] + [(3, 3)]
    df = spark.createDataFrame(links, "a long, b long")
    roots = union({x for p in links for x in p}, links)
    assert dict(map(tuple, components(df).df.collect())) == {x: y for x, y in roots.items() if x != y}


def test_texts_of_one_doc_id_are_kept_apart(spark):
    """A doc_id that many texts share: only those that are copies go."""
    r = random.Random(9)
    text = [" ".join(f"{k}w{r.randrange(10**6)}" for _ in range(60)) for k in range(4)]
    rows = [(1, text[0]), (5, text[0]), (5, text[1]), (5, text[1]), (5, text[2]), (7, text[2]), (8, text[3])]
    kept = op.keep_one(frame(spark, rows)).collect()
    assert sorted((x.doc_id, x.text) for x in kept) == sorted([(1, text[0]), (5, text[1]), (5, text[2]), (8, text[3])])


def test_a_forest_is_linear_and_keeps_components(spark, monkeypatch):
    r = random.Random(3)
    pairs = [(a, b) for a in range(200) for b in range(a)] + [(1000 + k, 1001 + k) for k in range(300)] + [(r.randrange(5000, 9000), r.randrange(5000, 9000)) for _ in range(3000)]
    r.shuffle(pairs)
    df = spark.createDataFrame(pairs, "a long, b long").repartition(1)
    nodes = {x for p in pairs for x in p}
    for held in (1 << 20, 300):
        monkeypatch.setattr("meshwork.llm.components.HELD", held)
        got = [tuple(x) for x in spanning_forest(df).collect()]
        assert union(nodes, got) == union(nodes, pairs)
        assert held < 1000 or len(got) < len(nodes)


def test_hot_nodes_are_skewed_joins(spark):
    """Both sides of every join of the star steps are plain shuffles: a hub's links are split."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        links = stored(spark.range(1, 20_000).selectExpr("id AS a", "0L AS b").repartition(8))
        both = links.df.union(links.df.selectExpr("b", "a"))
        minima = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        joined = both.filter("b > a").hint("merge").join(minima.df.hint("merge"), "a")
        joined.write.format("noop").mode("overwrite").save()
        joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().toString()
        assert dict(map(tuple, components(links.df).df.collect())) == {k: 0 for k in range(1, 20_000)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
