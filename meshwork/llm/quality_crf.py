"""Document quality by a linear-chain conditional random field over lines.

Method. Every line is good or bad. Emissions are linear in binned features of the line and of the lines before and
after it (length, word length, repeated and adjacent equal words, symbols, separators, case, digits,
punctuation, equal lines in the text); transitions link neighbouring lines. Labels say only whether a document is
good, so the line labels of bad documents are latent: they start from a line classifier and are re-estimated from
the field's own marginals, with the worst line of a bad document always bad. A document's quality is
the length-weighted mean of its lines' forward-backward marginals, mapped to a probability by a
logistic curve on the same sample.

Scale. The fit uses a sample of at most ``MAX_LABELLED`` labelled documents of any length, in the order of a hash, that ends behind the
document with which it has ``MAX_LINES`` lines. The driver holds a bin of each feature for every line, not columns. Scoring
is one narrow map over whole texts; features are sums over byte and word arrays, and the recursions
run over all texts of a block at once.

Edge cases. A null or empty text is one empty line. Rows without doc_id are scored (held_out null) and never fitted
on; repeated rows each give a row. Without labels of both classes the score is the smoothed share of good labels.
An empty table gives an empty result. Other columns, labels, lang and source among them, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Block, mixed, stored, table, text_blocks, word_hashes, word_spans
from .labelled import HELD_OUT, labelled_sample
from .toxicity import fit_linear

MAX_LABELLED = 5_000
MAX_LINES = 200_000
BINS = 6
ROUNDS = 3
STEPS = 60
FEATURES = ("words", "word_length", "distinct", "adjacent", "symbols", "separators", "upper", "digits", "stops", "marks_at_end", "equal_lines")


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


#: Byte classes.
SYMBOLS, SEPARATORS = _class(b"#$%&*+=<>@^_~`\\{}[]"), _class(b"|/;\t")
UPPER, DIGITS, STOPS = _class(bytes(range(65, 91))), _class(b"0123456789"), _class(b".,!?:")


def _sums(mask: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=total[1:])
    return (total[high] - total[low]).astype(np.float64)


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Raw features of all lines of a block, each line's length in bytes, and the number of lines of each text."""
    data, offsets = block.data, block.offsets
    breaks = np.flatnonzero(data == 10)
    n_texts = len(offsets) - 1
    # a line starts at a text's first byte and behind every line break
    per_text = np.searchsorted(breaks, offsets)
    counts = np.diff(per_text) + 1
    low = np.empty(counts.sum(), dtype=np.int64)
    high = np.empty_like(low)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    first = np.zeros(len(low), dtype=bool)
    first[heads] = True
    low[first], low[~first] = offsets[:-1], breaks + 1
    last = np.zeros(len(low), dtype=bool)
    last[heads + counts - 1] = True
    high[last], high[~last] = offsets[1:], breaks
    size = (high - low).astype(np.float64)
    some = np.maximum(size, 1)

    starts, ends, _ = word_spans(data, offsets)
    w_low, w_high = np.searchsorted(starts, low), np.searchsorted(starts, high)
    words = (w_high - w_low).astype(np.float64)
    several = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    line_of = np.repeat(np.arange(len(low)), w_high - w_low)
    same = np.zeros(len(starts), dtype=bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (line_of[1:] == line_of[:-1])
    _, one = np.unique(hashes ^ mixed(line_of.astype(U64)), return_index=True)
    distinct = np.bincount(line_of[one], minlength=len(low)).astype(np.float64)
    marks = (SYMBOLS | SEPARATORS)[data[ends - 1]] if len(ends) else np.zeros(0, dtype=bool)
    # lines that occur more than once in their text
    text_of = np.repeat(np.arange(n_texts), counts)
    total = np.zeros(len(hashes) + 1, dtype=U64)
    np.cumsum(hashes * mixed(np.arange(len(hashes), dtype=U64) - np.repeat(w_low, w_high - w_low).astype(U64)), out=total[1:])
    line_key = mixed((total[w_high] - total[w_low]) + words.astype(U64)) ^ mixed(text_of.astype(U64) + U64(1))
    _, inverse, times = np.unique(line_key, return_inverse=True, return_counts=True)
    equal = (times[inverse] > 1) & (words > 0)
    raw = np.column_stack([
        words,
        _sums(ends - starts, w_low, w_high) / several,
        np.where(words > 0, distinct / several, 1),
        _sums(same, w_low, w_high) / several,
        _sums(SYMBOLS[data], low, high) / some,
        _sums(SEPARATORS[data], low, high) / some,
        _sums(UPPER[data], low, high) / some,
        _sums(DIGITS[data], low, high) / some,
        _sums(STOPS[data], low, high) / some,
        _sums(marks, w_low, w_high) / several,
        equal.astype(np.float64),
    ])
    return raw, size + 1, counts


def binned(raw: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """The bin of each feature of each line; a feature's bins come after those of the features before it."""
    out = np.empty((len(raw), len(edges)), dtype=np.int32)
    at = 0
    for k, e in enumerate(edges):
        out[:, k] = at + np.searchsorted(e, raw[:, k], "right")
        at += len(e) + 1
    return out


def with_neighbours(own: np.ndarray, counts: np.ndarray, n_bins: int) -> np.ndarray:
    """The line's bins, then those of the line before and after it in its text (a bin for none at the ends), then one for all lines."""
    n, m = own.shape
    out = np.full((n, 3 * m + 1), 3 * n_bins + 1, dtype=np.int32)
    out[:, :m] = own
    out[:, -1] = 3 * n_bins
    inner = np.ones(n, dtype=bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
    rows = np.flatnonzero(inner)
    out[rows, m : 2 * m] = own[rows - 1] + n_bins
    out[rows - 1, 2 * m : 3 * m] = own[rows] + 2 * n_bins
    return out


def emissions(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The log potential of bad against good of each line; the bin for no neighbour has no weight."""
    return np.append(weights, 0.0)[x].sum(axis=1)


def totals(x: np.ndarray, of_line: np.ndarray, n_weights: int) -> np.ndarray:
    """The sum of a value of the lines over the lines of each bin."""
    return np.bincount(x.ravel(), np.repeat(of_line, x.shape[1]), minlength=n_weights + 1)[:n_weights]


def forward_backward(emission: np.ndarray, counts: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(bad) of each line, expected transitions (2 by 2, summed) and the log partition function.

    ``emission`` is the log potential of bad against good. All texts advance together, longest first.
    """
    order = np.argsort(-counts, kind="stable")
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    sizes = counts[order]
    longest = int(sizes[0])
    active = np.searchsorted(-sizes, -np.arange(1, longest + 1), "right")
    top = np.maximum(emission, 0)
    potential = np.stack([np.exp(-top), np.exp(emission - top)], axis=1)
    log_z = float(top.sum())
    table = np.exp(transition)
    alpha, beta = np.empty_like(potential), np.empty_like(potential)
    now = np.zeros((len(sizes), 2))
    for t in range(longest):
        n = active[t]
        rows = heads[:n] + t
        now = potential[rows] if t == 0 else (now[:n] @ table) * potential[rows]
        scale = now.sum(axis=1)
        now = now / scale[:, None]
        log_z += float(np.log(scale).sum())
        alpha[rows] = now
    pairs = np.zeros((2, 2))
    back = np.ones((len(sizes), 2))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        rows = heads[:n] + t
        further = active[t + 1] if t + 1 < longest else 0
        here = np.ones((n, 2))
        if further:
            ahead = potential[rows[:further] + 1] * back[:further]
            here[:further] = ahead @ table.T
            joint = alpha[rows[:further]][:, :, None] * table[None] * ahead[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            here[:further] /= here[:further].sum(axis=1, keepdims=True)
        beta[rows] = here
        back = here
    both = alpha * beta
    return both[:, 1] / both.sum(axis=1), pairs, log_z


def fit_field(x: np.ndarray, counts: np.ndarray, bad: np.ndarray, n_weights: int, l2: float = 2.0, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Emission weights and transitions by conditional likelihood of the lines' labels (Adam)."""
    inner = np.ones(len(x), dtype=bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])] = False
    rows = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (bad[rows - 1], bad[rows]), 1)
    theta = np.zeros(n_weights + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    target = totals(x, bad.astype(np.float64), n_weights)
    for k in range(1, steps + 1):
        marginal, pairs, _ = forward_backward(emissions(x, theta[:-4]), counts, theta[-4:].reshape(2, 2))
        gradient = np.concatenate([target - totals(x, marginal, n_weights), (seen - pairs).ravel()]) - l2 * theta
        gradient /= len(x)
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        theta += 0.15 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def fit_lines(own: np.ndarray, bad: np.ndarray, n_bins: int, l2: float = 5.0, steps: int = 8) -> np.ndarray:
    """P(bad) of each line by logistic regression on its own bins (Newton); where the field's labels start."""
    w = np.zeros(n_bins + 1)
    x = np.column_stack([own, np.full(len(own), n_bins)])
    penalty = np.append(np.full(n_bins, l2), 1e-3)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))
        curve = p * (1 - p) + 1e-6
        hessian = np.diag(penalty)
        for column in x.T:
            # one row of the matrix for each bin of this feature
            pairs = np.bincount((column[:, None] * (n_bins + 1) + x).ravel(), np.repeat(curve, x.shape[1]), minlength=(n_bins + 1) ** 2)
            hessian += pairs.reshape(n_bins + 1, -1)
        w += np.linalg.solve(hessian, totals(x, bad - p, n_bins + 1) - penalty * w)
    return 1 / (1 + np.exp(-np.clip(w[x].sum(axis=1), -30, 30)))


class Model(NamedTuple):
    edges: list[np.ndarray]
    emission: np.ndarray
    transition: np.ndarray
    curve: tuple[float, float]

    def marginals(self, raw: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """P(bad) of each line."""
        x = with_neighbours(binned(raw, self.edges), counts, sum(len(e) + 1 for e in self.edges))
        return forward_backward(emissions(x, self.emission), counts, self.transition)[0]

    def block_scores(self, block: Block) -> np.ndarray:
        if not self.edges:
            return np.full(len(block.offsets) - 1, 1 / (1 + np.exp(-self.curve[1])))
        raw, size, counts = line_features(block)
        return quality(self.marginals(raw, counts), size, counts, self.curve)


def good_share(bad: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    return 1 - np.add.reduceat(bad * size, heads) / np.add.reduceat(size, heads)


def quality(bad: np.ndarray, size: np.ndarray, counts: np.ndarray, curve: tuple[float, float]) -> np.ndarray:
    z = curve[0] * (good_share(bad, size, counts) - 0.5) + curve[1]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            raw, size, counts = line_features(block)
            cuts = np.cumsum(counts)[:-1]
            rows = [x.astype("<f4").tobytes() for x in np.split(raw, cuts)]
            sizes = [x.astype("<f4").tobytes() for x in np.split(size, cuts)]
            yield pa.record_batch([pa.array(rows, pa.binary()), pa.array(sizes, pa.binary()), block.rows.column(1), pa.array(counts, pa.int64())], names=["raw", "size", "label", "lines"])

    found = stored(labelled_sample(docs, labels, "quality", max_labelled).mapInArrow(run, "raw binary, size binary, label int, lines long"))
    order = Window.orderBy("key", "raw").rowsBetween(Window.unboundedPreceding, -1)
    # at most MAX_LABELLED short rows are put in order
    ahead = found.df.select(F.xxhash64("raw").alias("key"), F.sha2("raw", 256).alias("raw"), "label", "lines").withColumn("before", F.coalesce(F.sum("lines").over(order), F.lit(0)))
    last = ahead.filter(F.col("before") < MAX_LINES).agg(F.max(F.struct("key", "raw"))).first()[0]
    chosen = found.df if last is None else found.df.filter((F.xxhash64("raw") < last["key"]) | ((F.xxhash64("raw") == last["key"]) & (F.sha2("raw", 256) <= last["raw"])))
    rows = chosen.select("raw", "size", "label").collect()
    found.drop()
    good = np.array([r["label"] for r in rows], dtype=np.int64)
    if len(set(good.tolist())) < 2:
        share = (good.sum() + 1) / (len(good) + 2) if len(good) else 0.5
        return Model([], np.zeros(0), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    each = [np.frombuffer(r["raw"], "<f4").reshape(-1, len(FEATURES)) for r in rows]
    counts = np.array([len(x) for x in each])
    raw = np.concatenate(each).astype(np.float64)
    size = np.concatenate([np.frombuffer(r["size"], "<f4") for r in rows]).astype(np.float64)
    edges = [np.unique(np.quantile(raw[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(raw.shape[1])]
    # rare features are zero on most lines: a bin of their own for what is above zero, and for its upper half
    for k, e in enumerate(edges):
        positive = raw[:, k][raw[:, k] > 0]
        if len(positive):
            edges[k] = np.unique(np.concatenate([e, [np.nextafter(0, 1), np.median(positive), np.quantile(positive, 0.9)]]))
    n_bins = sum(len(e) + 1 for e in edges)
    own = binned(raw, edges)
    x = with_neighbours(own, counts, n_bins)
    n_weights = 3 * n_bins + 1
    of_bad = np.repeat(good == 0, counts)
    heads = np.concatenate([[0], np.cumsum(counts)[:-1]])
    suspect = fit_lines(own, of_bad.astype(np.float64), n_bins)
    emission, transition = np.zeros(n_weights), np.zeros((2, 2))
    for _ in range(ROUNDS):
        worst = np.maximum.reduceat(suspect, heads)
        bad = (of_bad & ((suspect >= 0.5) | (suspect >= np.repeat(worst, counts)))).astype(np.int64)
        emission, transition = fit_field(x, counts, bad, n_weights)
        suspect = forward_backward(emissions(x, emission), counts, transition)[0]
    share = good_share(suspect, size, counts)
    a, b = fit_linear((share - 0.5)[:, None], good.astype(np.float64), l2=1e-3)
    return Model(edges, emission, transition, (float(a), float(b)))


def line_marginals(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, bad): P(bad) of every line, in order."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            raw, _, counts = line_features(block)
            bad = sent.value.marginals(raw, counts) if sent.value.edges else np.full(len(raw), 0.5)
            yield pa.record_batch([block.rows.column(0), pa.array([x.tolist() for x in np.split(bad, np.cumsum(counts)[:-1])], pa.list_(pa.float64()))], names=["doc_id", "bad"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, bad array<double>")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            yield pa.record_batch([block.rows.column(0), pa.array(sent.value.block_scores(block), pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op4_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scores(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
