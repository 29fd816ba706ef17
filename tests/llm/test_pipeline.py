from array import array

import corpus_pipeline
from meshwork.llm import decontamination, pii, sentencepiece_nbest, toxicity
from tests.llm.helpers import frame
from tests.llm.test_classifiers import labels, toxic_corpus
from tests.llm.test_simhash import brute as simhash_brute


def test_equals_brute_force(spark, tmp_path):
    rows, truth = toxic_corpus(150)
    item = "an item of the benchmark with quite a few words that nobody else would ever put in this order at all"
    rows += [(500 + k, rows[k][1]) for k in range(0, 40, 2)]
    rows += [(700, "before it " + item + " and after it"), (701, "write to a.b@c.de or 10.0.0.1 please"), (702, None), (703, ""), (None, "no id here"), (704, "twice the same row"), (704, "twice the same row")]
    rows += [(705, "".join(f"q{k} " for k in range(5000)))]
    source = frame(spark, rows)
    documents = source.select("doc_id", "text", "lang", "source", "n_chars")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    marked = labels(spark, [(i, t) for (i, _), t in zip(rows, truth)], "toxic")
    marked.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    # stage by stage, each on all that its predecessor kept
    want = sorted(rows, key=repr)
    model = toxicity.fit(documents, marked)
    want = [r for r in want if model.score(r[1] or "") < 0.5]
    first = {i for i, _, c in simhash_brute(want) if i == c}
    seen, kept = set(), []
    for i, t in want:
        if i is None or i in first and i not in seen:
            kept.append((i, t))
            seen.add(i)
    own = decontamination.item_words(item).tolist()
    holds = lambda t: any(decontamination.item_words(t).tolist()[k : k + len(own)] == own for k in range(len((t or "").split())))
    kept = [r for r in kept if not holds(r[1])]
    masked = [(i, None if t is None else pii.masked(t)) for i, t in kept]
    pieces = sentencepiece_nbest.pieces_of(sentencepiece_nbest.read_model(sentencepiece_nbest.MODEL))
    final = sorted((repr(i), array("i", pieces.best_two(t or "")[2]).tolist()) for i, t in masked)

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert docs.columns == documents.columns, name
        docs.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k == 3:
            assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=repr) == sorted(masked, key=repr)
    assert sorted((repr(r.doc_id), list(r.ids)) for r in docs.collect()) == final
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((repr(r.doc_id), list(r.ids)) for r in whole) == final
    assert all(r.round_trip for r in whole)
    assert 0 < len(final) < len(rows) and not any(i == 700 for i, _ in masked)
