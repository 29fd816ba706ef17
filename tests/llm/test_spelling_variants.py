import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from meshwork.llm import spelling_variants as op
from tests.llm.helpers import frame


def one_edit(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def brute(rows, least=6, count=5, ratio=5, every=199):
    """Every pair of words compared."""
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if every and h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            n[w] += 1
    n = {w: k for w, k in n.items() if len(w) >= least and k >= count}
    by_length = {}
    for w in n:
        by_length.setdefault(len(w), []).append(w)
    near = {w: [v for k in (-1, 0, 1) for v in by_length.get(len(w) + k, ()) if one_edit(w, v)] for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v)) for w in n if near[w]}
    form = {w: v for w, v in best.items() if n[v] >= ratio * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {w: (form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


def got(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def misspelt(r, word):
    at = int(r.integers(len(word)))
    letters = "abcdeé÷ÿ"
    return [word[:at] + word[at + 1 :], word[:at] + letters[r.integers(8)] + word[at:], word[:at] + letters[r.integers(8)] + word[at + 1 :]][r.integers(3)]


def rows_of(seed, n=150):
    r = np.random.default_rng(seed)
    words = ["".join("abcdéÀx"[i] for i in r.integers(0, 7, r.integers(4, 10))) for _ in range(12)] + ["aaaaaaa", "aaaaaa", "aaaaaaaa", "aaaabaa", "b" * 300]
    rows = []
    for k in range(n):
        text = []
        for _ in range(r.integers(0, 120)):
            w = words[r.integers(len(words))]
            for _ in range(int(r.integers(0, 6) == 0) + int(r.integers(0, 40) == 0)):
                w = misspelt(r, w)
            text.append(w.upper() if r.integers(9) == 0 else w)
        rows.append((k, r.choice([" ", "\n", "1", "漢", "…", "_"]).join(text)))
    return rows + [(None, " ".join(words)), (7, None), (8, ""), (9, "one"), (3, rows[3][1]), (3, rows[3][1]), (900, " ".join([words[0]] * 20_000))]


@pytest.mark.parametrize("every", [None, 199, 3])
def test_equals_brute_force(spark, every):
    rows = rows_of(5)
    want = brute(rows, every=every)
    assert got(op.variants(frame(spark, rows), typo_every=every)) == want
    assert sum(v[0] is not None for v in want.values()) > 10


def test_chains_of_forms_end_at_their_root(spark):
    rows = [(k, " ".join(["abcdefg"] * 700 + ["abcdefx"] * 100 + ["abcdyfx"] * 14 + ["abcdyfxz"] * 2)) for k in range(5)]
    found = got(op.variants(frame(spark, rows)))
    assert found == brute(rows, every=None)
    assert found["abcdyfxz"][:2] == ("abcdyfx", "abcdefg")


def test_ties_take_the_smallest_word(spark):
    rows = [(1, " ".join(["abcdef"] * 5 + ["abcdeg"] * 50 + ["abcdeé"] * 50 + ["zbcdef"] * 50))]
    assert got(op.variants(frame(spark, rows)))["abcdef"][0] == "abcdeg"


def test_colliding_keys_change_nothing(spark, monkeypatch):
    rows = rows_of(6, 30)
    plain = op.deletion_keys

    def collide(batch):
        made = plain(batch)
        return made.set_column(0, "key", pa.array(made.column(0).to_numpy() % 7))

    monkeypatch.setattr(op, "deletion_keys", collide)
    assert got(op.variants(frame(spark, rows), typo_every=199)) == brute(rows)


def test_nothing_to_find(spark):
    for rows in ([], [(1, None), (2, "")], [(1, "abcdef " * 4)]):
        assert op.variants(frame(spark, rows)).collect() == []
    assert got(op.variants(frame(spark, [(1, "abcdef " * 5)]))) == {"abcdef": (None, "abcdef", 5, 0, None)}


def test_checksums_of_long_runs():
    data = np.frombuffer(b"abc" + b"x" * 200, dtype=np.uint8)
    before = np.array([zlib.crc32(b"12:"), zlib.crc32(b":")], dtype=np.uint32)
    assert op.checksums(data, np.array([0, 3]), np.array([3, 203]), before).tolist() == [zlib.crc32(b"12:abc"), zlib.crc32(b":" + b"x" * 200)]
