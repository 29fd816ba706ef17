import hashlib

import pytest

from meshwork.llm import substring_dedup as op
from tests.llm.helpers import corpus, frame


def brute(rows, width):
    docs = sorted({(i, (t or "").encode()) for i, t in rows if i is not None})
    first = {}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - width + 1):
            g = tuple(w[k : k + width])
            first[g] = min(first.get(g, (i, k)), (i, k))
    out = {}
    for i, t in docs:
        w = t.split()
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < (i, k):
                gone.update(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.setdefault(i, set()).add((len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("width,chunk,bucket", [(20, 1_500_000, 1_500_000), (20, 300, 200), (5, 1000, 50)])
def test_equals_brute_force(spark, monkeypatch, width, chunk, bucket):
    monkeypatch.setattr(op, "WINDOWS_PER_CHUNK", chunk)
    monkeypatch.setattr(op, "WINDOWS_PER_BUCKET", bucket)
    monkeypatch.setattr(op, "TEXT_BYTES_PER_BUCKET", 20_000)
    rows = corpus(width)
    got = {}
    n = 0
    for r in op.substring_dedup(frame(spark, rows), width).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()))
        assert r.n_removed == sum(b - a for a, b in zip(r.intervals[::2], r.intervals[1::2]))
        n += 1
    assert got == brute(rows, width)
    assert n == sum(i is not None for i, _ in rows)
    assert sum(x[1] for v in got.values() for x in v) > 0


def test_one_id_with_two_texts(spark):
    a = " ".join(f"w{i}" for i in range(30))
    rows = [(7, "x " + a), (7, a + " y"), (7, a + " y"), (9, a)]
    got = {}
    for r in op.substring_dedup(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()))
    assert got == brute(rows, 20)


def test_empty_table(spark):
    assert op.substring_dedup(frame(spark, [])).collect() == []


def test_words_past_a_page(spark):
    tail = " ".join(f"t{i}" for i in range(40))
    rows = [(2, " ".join(f"a{i}" for i in range(70_000)) + " " + tail), (1, tail)]
    got = {r.doc_id: r.n_removed for r in op.substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 40}


def test_many_repeated_rows_of_one_doc_id(spark):
    """More windows in one document, text and page than an entry can count."""
    text = " ".join(f"w{k}" for k in range(1000))
    got = op.substring_dedup(frame(spark, [(1, text)] * 70 + [(2, text)], partitions=1)).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed) for r in got) == [(1, 1000, 0)] * 70 + [(2, 1000, 1000)]


def test_texts_of_one_doc_id_are_told_apart(spark):
    """Two texts whose hashes share their lower 31 bits: one repeats itself, the other does not."""
    passage = " ".join(f"p{k}" for k in range(25))
    plain = " ".join(f"q{k}" for k in range(50))
    key = "xxhash64(text) & 2147483647 AS key"
    a = spark.range(100_000).selectExpr(f"concat('{passage} {passage} x', id) AS text").selectExpr("text AS a", key)
    b = spark.range(100_000).selectExpr(f"concat('{plain} y', id) AS text").selectExpr("text AS b", key)
    pair = a.join(b, "key").orderBy("a", "b").first()
    got = op.substring_dedup(frame(spark, [(1, pair.a), (1, pair.b)])).collect()
    assert sorted((r.n_words, r.n_removed) for r in got) == [(51, 0), (51, 25)]
