import math
import zlib
from collections import Counter

import numpy as np
import pytest

from meshwork.llm import brown_lm as op
from tests.llm.helpers import corpus, frame


def tokens(text):
    return (text or "").encode().lower().split()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def base(rows):
    counts, n_texts = Counter(), 0
    for i, t in rows:
        if i is not None and not held_out(i):
            counts.update(tokens(t))
            n_texts += 1
    n, v = sum(counts.values()) + n_texts, len(counts) + (n_texts > 0)
    out = []
    for i, t in rows:
        if i is not None:
            cs = [counts[w] for w in tokens(t)] + [n_texts]
            out.append((i, held_out(i), len(cs), sum(c > 0 for c in cs), n, sum(math.log10((c + 1) / (n + v + 1)) for c in cs)))
    return sorted(out)


def class_scores(rows, of, open_class, classes):
    """Every row's score from the words' classes alone, by the written formula."""
    training = [tokens(t) for i, t in rows if i is not None and not held_out(i)]
    counts = Counter(w for t in training for w in t)
    end = classes - 1
    pairs = np.zeros((classes, classes))
    for t in training:
        for a, b in zip([end, *(of[w] for w in t)], [*(of[w] for w in t), end]):
            pairs[a, b] += 1
    mass, types = np.zeros(classes), np.zeros(classes)
    for w, n in counts.items():
        mass[of[w]] += n
        types[of[w]] += 1
    mass[end], types[end] = len(training), 1
    types[open_class] += 1
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + classes)

    def step(a, b):
        return op.LAMBDA * pairs[a, b] / pairs[a].sum() + (1 - op.LAMBDA) * single[b] if pairs[a].sum() else single[b]

    def emission(n, c):
        return (n + op.DELTA) / (mass[c] + op.DELTA * types[c])

    out = []
    for i, t in rows:
        if i is not None:
            own = [(of.get(w, open_class), counts[w]) for w in tokens(t)] + [(end, len(training))]
            out.append((i, sum(math.log10(step(a, b)) + math.log10(emission(n, b)) for a, (b, n) in zip([end, *(c for c, _ in own)], own))))
    return sorted(out)


@pytest.mark.parametrize("dictionary,units,seeds", [(1 << 17, 1 << 14, 700), (50, 20, 8), (0, 5, 5)])
def test_equals_brute_force(spark, tmp_path, monkeypatch, dictionary, units, seeds):
    """The base whatever the tables hold; the score from the classes that the model gave its words."""
    for name, value in (("DICTIONARY", dictionary), ("UNITS", units), ("SEEDS", seeds), ("TOKENS", 500)):
        monkeypatch.setattr(op, name, value)
    models, kept = [], op.train

    def train(*args):
        models.append((kept(*args)))
        m = models[-1]
        of.update({w: int(c) for w, c in zip(m.words, m.of)} | {r["word"].encode(): r["class"] for r in m.others.df.collect()})
        return m

    of = {}
    monkeypatch.setattr(op, "train", train)
    rows = corpus(31, n=40)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in op.op10_brown_lm(spark, str(tmp_path)).collect())
    want = base(rows)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * abs(w[5]) for g, w in zip(got, want))
    assert set(of) == {w for i, t in rows if i is not None and not held_out(i) for w in tokens(t)}, "a training word has no class"
    assert len(models[0].words) <= dictionary
    scores = class_scores(rows, of, models[0].open, op.CLASSES)
    assert all(g[0] == i and abs(g[6] - s) < 1e-6 * abs(s) for g, (i, s) in zip(got, scores))
    assert all(abs(math.log10(g[7]) + g[6] / g[2]) < 1e-9 for g in got)


def two_sides(r, size=20):
    bigrams = np.zeros((size + 1, size + 1))
    for a in range(size):
        for b in range(size):
            bigrams[a, b] = r.integers(5, 30) if (a % 2) == (b % 2) else 0
    bigrams[size, :size] = bigrams[:size, size] = 1
    return bigrams


def test_exchange_finds_two_languages_and_no_move_is_left():
    bigrams = two_sides(np.random.default_rng(0))
    size = len(bigrams) - 1
    of = op.exchange(bigrams, 3)
    assert of[size] == 2 and len(set(of[0:size:2])) == 1 and len(set(of[1:size:2])) == 1 and of[0] != of[1]

    def table(of, classes):
        one = np.eye(classes)[of]
        return one.T @ bigrams @ one

    r = np.random.default_rng(1)
    bigrams = r.integers(0, 6, (31, 31)).astype(float)
    of = op.exchange(bigrams, 5)
    reached = op.likelihood(table(of, 5))
    for u in range(30):
        for c in range(4):
            other = of.copy()
            other[u] = c
            assert op.likelihood(table(other, 5)) <= reached + 1e-5


def test_gains_equal_the_likelihoods_difference():
    r = np.random.default_rng(2)
    bigrams = r.integers(0, 5, (25, 25)).astype(float)
    of = r.integers(0, 4, 25)
    of[3] = of[7] = -1
    one = np.where((of >= 0)[:, None], np.eye(4)[of], 0)
    pairs = one.T @ bigrams @ one
    for u in (0, 3, 7, 11):
        right, left, loop = bigrams[u] @ one, bigrams[:, u] @ one, bigrams[u, u]
        if of[u] >= 0:
            right[of[u]] -= loop
            left[of[u]] -= loop
        got = op.gains(pairs, of[u : u + 1], left[None], right[None], np.array([loop]))[0]
        want = []
        for c in range(4):
            other = of.copy()
            other[u] = c
            o = np.where((other >= 0)[:, None], np.eye(4)[other], 0)
            want.append(op.likelihood(o.T @ bigrams @ o))
        assert np.allclose(np.array(got) - got[0], np.array(want) - want[0])
        if of[u] < 0:
            alone = op.joining_gains(pairs, left[None], right[None])[0]
            assert np.allclose(alone, op.gains(pairs, of[u : u + 1], left[None], right[None], np.zeros(1))[0])


def test_class_model_beats_base_on_two_languages(spark, monkeypatch):
    rows = []
    r = np.random.default_rng(1)
    for k in range(200):
        own = [f"{'ab'[k % 2]}{x}" for x in r.integers(0, 30, 40)]
        rows.append((k, " ".join(own)))
    docs = frame(spark, rows)
    for units, seeds in ((1 << 14, 700), (40, 20), (60, 10)):
        monkeypatch.setattr(op, "UNITS", units)
        monkeypatch.setattr(op, "SEEDS", seeds)
        found = op.scored(docs, f"NOT ({op.HELD_OUT})").toPandas()
        assert found["score"].sum() > found["base_score"].sum() + 0.2 * found["n_tokens"].sum()


def test_empty_table_and_no_training_rows(spark):
    assert op.scored(frame(spark, []), f"NOT ({op.HELD_OUT})").collect() == []
    rows = [i for i in range(200) if held_out(i)][:3]
    got = op.scored(frame(spark, [(rows[0], "a b a"), (rows[1], None), (rows[2], "")]), f"NOT ({op.HELD_OUT})").collect()
    assert sorted((r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got) == [(1, 0, 0, 0.0), (1, 0, 0, 0.0), (4, 0, 0, 0.0)]
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
