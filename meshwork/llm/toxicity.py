"""Toxicity by weak supervision: a generative label model over voters trains a linear classifier.

Method. Voters are lexicon entries (words and word beginnings that are over-represented in toxic documents of a
bounded labelled sample), fixed patterns (shouting, exclamation marks, symbol runs), and voters that say
"clean" when a whole lexicon is silent. Each votes or abstains on a document. The label model has a class
prior and for each voter the probability of a vote under either class (its accuracy). Where a document has a label, that
is one more voter, whose accuracy is estimated like the others' (from a weak prior that says which class is which); documents
without labels take part by their votes alone. Expectation-maximisation estimates them; the correlation of two voters
given the class is estimated from the same posteriors, and a voter's evidence is divided by the evidence
that correlated voters repeat. A logistic regression on lexicon and pattern features is fitted to the
posteriors of all these documents, not to the labels, and scores every document.

Scale. The fit reads at most ``MAX_LABELLED`` labelled documents and ``MAX_UNLABELLED`` others, which together count at most
``UNLABELLED_MASS`` of the labelled ones; the lexicon has at most ``MAX_ENTRIES`` entries: the model
that is sent has a fixed size. Mining is a map with counts combined in each task and one small shuffle. Scoring
is one narrow map over whole texts.

Edge cases. A null or empty text has no votes but those of silence and gets a score like any other. Rows without
doc_id are scored (held_out null) and never fitted on; repeated rows each give a row. Without labels of both classes the
score is the smoothed share of toxic labels. An empty table gives an empty result. Other columns, labels, lang and
source among them, are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table, text_blocks
from .labelled import HELD_OUT, labelled_sample, unlabelled_sample

MAX_LABELLED = 20_000
MAX_UNLABELLED = 20_000
MAX_ENTRIES = 400
LEAST_TOXIC = 3
PREFIXES = (3, 4, 5)
#: Documents without labels together count at most this share of those with labels.
UNLABELLED_MASS = 0.1
#: The label voter starts at this accuracy, and keeps it as a prior that weighs as much as so many documents.
LABEL_ACCURACY, LABEL_PRIOR = 0.95, 20.0
ROUNDS = 15
#: Rows of the feature matrix that a sum takes at once.
ROWS_AT_ONCE = 2048
_WORDS = re.compile(r"[^\W\d_]+")
#: Patterns that may or may not speak for toxicity; the label model weighs them.
PATTERNS = {"shouting": re.compile(r"\b[A-Z]{4,}\b"), "exclaiming": re.compile(r"!{2,}"), "symbols": re.compile(r"[#$%&*@!]{3,}")}


def entries_of(text: str) -> set[str]:
    """Lexicon entries of a text: its words, and word beginnings marked by a trailing star."""
    words = set(_WORDS.findall(text.lower()))
    found = set(words)
    for k in PREFIXES:
        found.update([w[:k] + "*" for w in words if len(w) > k])
    return found


def mine_lexicon(sample: DataFrame) -> list[str]:
    """At most MAX_ENTRIES entries, strongest first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def flushed() -> pa.RecordBatch:
            keys = list(set(counts[0]) | set(counts[1]))
            parts = [pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in counts)]
            for c in counts:
                c.clear()
            return pa.record_batch(parts, names=["entry", "clean", "toxic"])

        for block in text_blocks(batches, max_bytes=1 << 19):
            for text, label in zip(block.rows.column(0).to_pylist(), block.rows.column(1).to_pylist()):
                counts[bool(label)].update(entries_of(text or ""))
            if len(counts[0]) + len(counts[1]) > 100_000:
                yield flushed()
        yield flushed()

    rows = sample.mapInArrow(run, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    totals = sample.groupBy("label").count().collect()
    size = {bool(r["label"]): r["count"] for r in totals}
    if not size.get(True) or not size.get(False):
        return []
    share = F.lit(size[True] / (size[True] + size[False]))
    seen = F.col("toxic") + F.col("clean")
    # signed chi-square-like strength of being in toxic documents more often than the sample's share
    strength = (F.col("toxic") - share * seen) / F.sqrt(share * (1 - share) * seen)
    strong = rows.filter(f"toxic >= {LEAST_TOXIC}").filter(F.col("toxic") / seen > 0.5 + 0.5 * share).orderBy(strength.desc(), "entry").limit(MAX_ENTRIES)
    return [r["entry"] for r in strong.select("entry").collect()]


class Lexicon(NamedTuple):
    """Entries and patterns as columns of a feature matrix."""

    places: dict[str, int]

    @property
    def size(self) -> int:
        return len(self.places) + len(PATTERNS)

    def hits(self, text: str) -> list[int]:
        words = set(_WORDS.findall(text.lower()))
        places = self.places
        found = [places[w] for w in words.intersection(places)]
        if places:
            for k in PREFIXES:
                found += [places[p] for p in {w[:k] + "*" for w in words if len(w) > k}.intersection(places)]
        found += [len(places) + k for k, p in enumerate(PATTERNS.values()) if p.search(text)]
        return sorted(found)


class LabelModel(NamedTuple):
    prior: float
    rate: np.ndarray  # P(vote | class), 2 by voters
    weight: np.ndarray  # share of each voter's evidence that others do not repeat
    label_accuracy: np.ndarray  # P(label = class | class)


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> tuple[LabelModel, np.ndarray, np.ndarray]:
    """Expectation-maximisation; returns the model, and for each row the posterior of class 1 and how much the row counts.

    ``votes`` is 0/1, rows by voters (the way a voter leans shows in its two rates); ``labels`` is 0 or 1, -1 for none.
    """
    votes = np.asarray(votes, dtype=np.float32)
    n, m = votes.shape
    has = labels >= 0
    counts = np.where(has, 1.0, min(1.0, UNLABELLED_MASS * has.sum() / max(1, (~has).sum())))
    accuracy = np.full(2, LABEL_ACCURACY)
    posterior = np.where(labels == 1, LABEL_ACCURACY, 1 - LABEL_ACCURACY)
    weight = np.ones(m)
    prior, rate = 0.5, np.full((2, m), 0.5)
    for k in range(rounds):
        # before the first round nothing is known of documents without labels
        use = counts if k else counts * has
        of = np.stack([use * (1 - posterior), use * posterior])
        mass = of.sum(axis=1)
        prior = float((mass[1] + 1) / (mass.sum() + 2))
        rate = (of @ votes + 0.5) / (mass[:, None] + 1)
        if k:
            agreed = np.array([(of[c] * (labels == c)).sum() for c in (0, 1)])
            accuracy = (agreed + LABEL_PRIOR * LABEL_ACCURACY) / ((of * has).sum(axis=1) + LABEL_PRIOR)
        # correlation of voters given the class, from residuals around the class rates
        together = np.zeros((m, m))
        for c in (0, 1):
            for low in range(0, n, ROWS_AT_ONCE):
                left = votes[low : low + ROWS_AT_ONCE] - rate[c].astype(np.float32)
                together += left.T @ (left * of[c][low : low + ROWS_AT_ONCE, None].astype(np.float32))
        spread = together.diagonal().copy()
        correlation = together / np.sqrt(np.outer(spread, spread) + 1e-9)
        np.fill_diagonal(correlation, 1.0)
        weight = 1 / np.maximum(correlation, 0).sum(axis=1)
        on, off = np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))
        said = np.where(labels == 1, np.log(accuracy[1] / (1 - accuracy[0])), np.where(labels == 0, np.log((1 - accuracy[1]) / accuracy[0]), 0.0))
        evidence = votes @ (weight * (on - off)) + (weight * off).sum()
        posterior = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence + said, -30, 30)))
    return LabelModel(prior, rate, weight, accuracy), posterior, counts


def fit_linear(features: np.ndarray, targets: np.ndarray, counts: np.ndarray | None = None, l2: float = 1.0, steps: int = 40) -> np.ndarray:
    """Logistic regression on soft targets by Newton steps; the last weight is the intercept."""
    counts = np.ones(len(features)) if counts is None else counts
    w = np.zeros(features.shape[1] + 1)
    penalty = np.full(len(w), l2)
    penalty[-1] = 1e-3
    for _ in range(steps):
        slope, curve = -penalty * w, np.diag(penalty)
        for low in range(0, len(features), ROWS_AT_ONCE):
            part = slice(low, low + ROWS_AT_ONCE)
            x = np.column_stack([features[part], np.ones(len(features[part]), dtype=features.dtype)])
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope += x.T @ (counts[part] * (targets[part] - p))
            curve += (x * (counts[part] * (p * (1 - p) + 1e-6)).astype(x.dtype)[:, None]).T @ x
        step = np.linalg.solve(curve, slope)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray
    labels: LabelModel | None

    def score(self, text: str) -> float:
        z = self.weights[-1] + self.weights[self.lexicon.hits(text)].sum()
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    kept = stored(labelled_sample(docs, labels, "toxic", max_labelled))
    sample = kept.df
    lexicon = Lexicon({e: k for k, e in enumerate(mine_lexicon(sample))})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            hits = [lexicon.hits(t or "") for t in block.rows.column(0).to_pylist()]
            yield pa.record_batch([pa.array(hits, pa.list_(pa.int32())), block.rows.column(1)], names=["hits", "label"])

    if not lexicon.places:
        y = np.array([r["label"] for r in sample.select("label").collect()], dtype=np.int64)
        share = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        weights = np.zeros(lexicon.size + 1)
        weights[-1] = np.log(share / (1 - share))
        return Model(lexicon, weights, None)
    rows = sample.unionByName(unlabelled_sample(docs, labels, max_unlabelled)).mapInArrow(run, "hits array<int>, label int").collect()
    y = np.array([-1 if r["label"] is None else r["label"] for r in rows], dtype=np.int64)
    words = np.array([e[-1] != "*" for e in lexicon.places])
    groups = [g for g in (words, ~words, words | ~words) if g.any()]
    # one matrix for both: entries and patterns, then voters that speak where a group of entries is silent
    votes = np.zeros((len(rows), lexicon.size + len(groups)), dtype=np.float32)
    for k, r in enumerate(rows):
        votes[k, r["hits"]] = 1
        entries = [h for h in r["hits"] if h < len(words)]
        votes[k, lexicon.size :] = [not group[entries].any() for group in groups]
    del rows
    x = votes[:, : lexicon.size]
    label_model, posterior, counts = fit_label_model(votes, y)
    return Model(lexicon, fit_linear(x, posterior, counts), label_model)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for block in text_blocks(batches):
            yield pa.record_batch([block.rows.column(0), pa.array([score(t or "") for t in block.rows.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs``, all columns kept, without the rows that score ``threshold`` or more."""
    sent = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = sent.value.score
        for block in text_blocks(batches):
            keep = [score(t or "") < threshold for t in block.rows.column(at).to_pylist()]
            yield block.rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
