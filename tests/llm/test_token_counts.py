from collections import Counter

import tiktoken

from meshwork.llm import token_counts as op
from tests.llm.helpers import corpus, frame


def lengths(rows):
    vocabulary = op.read_vocabulary(op.VOCABULARY)
    encoding = op.encoder(vocabulary)
    assert isinstance(encoding, tiktoken.Encoding)
    return [len(encoding.encode_ordinary(t or "")) for _, t in rows]


def test_histogram_and_sums_equal_brute_force(spark):
    rows = corpus(5)
    n = lengths(rows)
    table = op.length_histogram(frame(spark, rows))
    assert {r.length: r.n_docs for r in table.collect()} == Counter(n)
    for r in op.suffix_sums(table).collect():
        assert r.docs_at_least == sum(x >= r.length for x in n)
        assert r.tokens_at_least == sum(x for x in n if x >= r.length)
        assert r.truncated_total == sum(min(x, r.length) for x in n)
        assert r.docs_at_most == sum(x <= r.length for x in n)
        assert r.total_tokens == sum(n) and r.all_docs == len(n)
    sums = op.suffix_sums(table)
    quantiles = {r.share: r.length for r in op.length_quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect()}
    ordered = sorted(n)
    assert quantiles[1.0] == ordered[-1] and quantiles[0.5] == ordered[-(-len(n) // 2) - 1]
    totals = {r.limit: r.tokens for r in op.truncated_totals(table, [0, 5, 128, 10**6]).collect()}
    assert totals == {k: sum(min(x, k) for x in n) for k in totals}


def test_lengths_by_document_keep_every_row(spark):
    rows = corpus(6, n=20)
    got = Counter((r.doc_id, r.n_tokens) for r in op.token_lengths(frame(spark, rows)).collect())
    assert got == Counter((i, n) for (i, _), n in zip(rows, lengths(rows)))


def test_pieces_of_a_long_text_add_up():
    encode = op.encoder(op.read_vocabulary(op.VOCABULARY)).encode_ordinary
    text = "It's  a test,\n\n of 123 cuts — çà et là 漢字   <|endoftext|> don't " * 40
    for piece in (1, 7, 50, 333):
        assert op.encoded_length(encode, text, piece) == len(encode(text))


def test_empty_table(spark):
    assert op.suffix_sums(op.length_histogram(frame(spark, []))).collect() == []
