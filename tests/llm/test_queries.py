"""The registered queries themselves, on small tables with nulls, repeats, clashing columns, and on empty ones."""

import hashlib

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from meshwork.llm import pii, sentencepiece_nbest, token_alignment, token_counts
from meshwork.llm.registry import QUERIES
from tests.llm.helpers import corpus, frame
from tests.llm.test_simhash import brute as simhash_brute
from tests.llm.test_spelling_variants import brute as spelling_brute, got as spelling_found
from tests.llm.test_substring_dedup import brute as substring_brute
from tests.llm.test_token_alignment import brute as alignment_brute

ITEM = "an item of the benchmark with quite a few words that nobody else would ever put in this order at all"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    rows = corpus(41, n=40) + [(4000, f"before it {ITEM} and after it"), (4001, "write to a.b@c.de or 10.0.0.1, password=abc123xyz")]
    for name, own in (("full", rows), ("empty", [])):
        frame(spark, own).write.parquet(f"{top}/{name}/documents.parquet")
        items = [(1, ITEM), (2, None)] if own else []
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/{name}/benchmark.parquet")
        labels = [(i, k % 2, k % 3 == 0, 1) for k, (i, _) in enumerate(own)]
        spark.createDataFrame([(i, q, int(t), s) for i, q, t, s in labels], "doc_id long, quality int, toxic int, score int").write.parquet(f"{top}/{name}/labels.parquet")
        vectors = [(100 * k, [float(k), 1.0]) for k in range(3)] if own else []
        spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(f"{top}/{name}/embeddings.parquet")
    return top, rows


def test_rows_equal_brute_force(spark, tables):
    top, rows = tables
    run = lambda name: QUERIES[name](spark, f"{top}/full").collect()
    assert [(r.doc_id, r.item_id) for r in run("op1_decontamination")] == [(4000, 1)]
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run("op2_simhash_near_dedup")) == simhash_brute(rows)
    pieces = sentencepiece_nbest.pieces_of(sentencepiece_nbest.read_model(sentencepiece_nbest.MODEL))
    want = sorted((repr(i), hashlib.sha256(pieces.best_two(t or "")[2]).hexdigest()) for i, t in rows)
    assert sorted((repr(r.doc_id), r.ids_sha256) for r in run("op5_sentencepiece")) == want
    digests: dict = {}
    for r in run("op7_substring_dedup"):
        digests.setdefault(r.doc_id, set()).add((r.n_words, r.n_removed, r.kept_sha256))
    assert digests == substring_brute(rows, 20)
    assert spelling_found(QUERIES["op11_spelling_variants"](spark, f"{top}/full")) == spelling_brute(rows)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in run("op12_one_bit_search")) == [(0, 1, 100), (0, 2, 200), (100, 1, 200), (100, 2, 0), (200, 1, 100), (200, 2, 0)]
    own = token_alignment.tokenizers(token_alignment.read_files())
    public = Tokenizer.from_file(token_alignment.VOCABULARY)
    public.encode_special_tokens = True
    assert sorted(map(tuple, run("op13_token_alignment")), key=repr) == alignment_brute(rows, own, public)
    encode = token_counts.encoder(token_counts.read_vocabulary(token_counts.VOCABULARY)).encode_ordinary
    sizes = [len(encode(t or "")) for _, t in rows]
    assert sorted((r.length, r.n_docs) for r in run("op9_token_counts")) == sorted((n, sizes.count(n)) for n in set(sizes))


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, tables, name):
    top, _ = tables
    assert (corpus_pipeline.run if name == "pipeline" else QUERIES[name])(spark, f"{top}/empty").collect() == []


def test_personal_data_of_all_rows(spark, tables):
    top, rows = tables
    got = {repr(r.doc_id): r for r in QUERIES["op6_pii"](spark, f"{top}/full").collect()}
    assert set(got) == {repr(i) for i, _ in rows}
    one = got["4001"]
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 0, 0) and "account:" in one.spans
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for i, r in got.items() if i != "4001" and not r.spans)
    assert pii.masked(rows[-1][1]) == "write to [email] or [ip], password=[account]"
