import hashlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from meshwork.llm import token_alignment as op
from tests.llm.helpers import corpus, frame


@pytest.fixture(scope="module")
def own():
    return op.tokenizers(op.read_files())


@pytest.fixture(scope="module")
def public():
    t = Tokenizer.from_file(op.VOCABULARY)
    t.encode_special_tokens = True
    return t


def brute(rows, own, public):
    """Whole texts through the public libraries; ends compared as sets."""
    texts, counts = [], Counter()
    for i, text in rows:
        links, groups, a, b = [], [], [], []
        if text:
            a = public.encode(" " + text, add_special_tokens=False).ids
            b = own.b.encode(text)
            if any(b"".join(x[k] for k in ids) != (" " + text).encode() for x, ids in ((own.a_bytes, a), (own.b_bytes, b))):
                a, b = [], []
            ends = [np.cumsum([len(x[k]) for k in ids]).tolist() for x, ids in ((own.a_bytes, a), (own.b_bytes, b))]
            place = [{end: k for k, end in enumerate(x)} for x in ends]
            i_from = k_from = 0
            for end in sorted(set(ends[0]) & set(ends[1])):
                x, y = place[0][end], place[1][end]
                links.append((a[x], b[y]))
                groups.append(f"{','.join(map(str, a[i_from : x + 1]))}|{','.join(map(str, b[k_from : y + 1]))}")
                i_from, k_from = x + 1, y + 1
        counts.update(links)
        texts.append((i, a, b, groups, links))
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    out = []
    for i, a, b, groups, links in texts:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((i, len(a), len(b), len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


ODD = ["a<|endoftext|>b </s> <s> <unk>", "  two  spaces \n\n  x\t y ", "'s it's   'll", "x   y z 　w", "low▁bar", "nul\x00 \x1c a \x1fb", "漢字 かな 漢字漢字", "🙂 🙂🙂 é é", " ", "\n", "x", " x", "ﬁ ½ Å", "\u0085 next", "1234 5678 90", "a " * 3000 + "b" * 5000]


def test_query_equals_public_libraries(spark, own, public):
    rows = corpus(21, n=50) + [(5000 + k, t) for k, t in enumerate(ODD)]
    found = [tuple(r) for r in op.alignment_scores(frame(spark, rows)).collect()]
    assert sorted(found, key=repr) == brute(rows, own, public)
    assert sum(r[4] for r in found) > 1000 and any(r[2] != r[1] for r in found)


def test_empty_tables_and_texts_without_tokens(spark):
    assert op.alignment_scores(frame(spark, [])).collect() == []
    found = op.alignment_scores(frame(spark, [(1, None), (2, ""), (None, None)])).collect()
    assert [tuple(r)[1:] for r in found] == [(0, 0, 0, 0, 0, 0, "")] * 3


def test_every_link_is_listed(own):
    pairs = op.linkable(own)
    assert len(pairs) == len(np.unique(pairs)) < own.a_size.sum() + own.b_size.sum()
    found = op.aligned(own, [p.encode() for p in (" word", " naïve", " 漢字", " it's")])
    assert np.isin(found.links, pairs).all() and len(found.links) == found.n_groups.sum()


def test_overlaps_groups_and_products():
    #  A: aab|b|ccc   B: a|abb|cc|c
    one = op.Alignment.of(np.array([10, 11, 12]), np.array([20, 21, 22, 23]), np.array([3, 4, 7]), np.array([1, 4, 6, 7]))
    assert one.overlaps().tolist() == [[0, 0, 1], [0, 1, 3], [1, 1, 4], [2, 2, 6], [2, 3, 7]]
    assert one.ends().tolist() == [[1, 1], [2, 3]]
    assert [x.tolist() for x in one.groups()] == [[0, 0, 1], [0, 0, 1, 1]]
    assert list(one.products()) == [(0, 0), (0, 1), (1, 0), (1, 1), (2, 2), (2, 3)]


def test_spans_of_texts(spark, own):
    df = frame(spark, [(1, "naïve tokenization"), (2, None), (3, "low▁bar")])
    for kind in ("overlaps", "ends", "products"):
        want = op.align_text(own, "naïve tokenization".encode())
        pairs = want.overlaps()[:, :2].tolist() if kind == "overlaps" else want.ends().tolist() if kind == "ends" else list(want.products())
        found = op.token_spans(df, kind).collect()
        assert sorted(map(tuple, found)) == sorted((1, want.a[a], want.b[b], want.a_ends[a], want.b_ends[b]) for a, b in pairs)
    with pytest.raises(ValueError):
        op.token_spans(df, "none")


def test_best_pairs_with_ties():
    pairs = np.array([(1 << 32) + 5, (2 << 32) + 5, (3 << 32) + 5, (4 << 32) + 6])
    assert op.best_pairs(pairs, np.array([3, 3, 1, 0])).tolist() == [True, True, False, True]
