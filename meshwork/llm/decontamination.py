"""Benchmark decontamination by latent semantic retrieval, verified by longest common subsequences.

Method. Texts are cut into cells of ``CELL`` words and overlapping passages of ``SCALES`` cells. Terms are those of the
benchmark; their document frequencies are counted over all passages of the corpus. A randomised singular value
decomposition (range finder with a power iteration, each step a distributed sum of A'A times a thin matrix) of
TF-IDF passages, all of the benchmark and of the corpus, gives a latent space. Every passage of every
document is projected and compared with every item by cosine; what reaches ``COSINE``, and far enough along the
item, is a candidate. An item longer than the longest passage is compared in overlapping parts of that length, so
that each part meets passages of its own size; a passage near one part makes the whole item a candidate. So does
every run of ``SEED_WORDS`` words of an item, however common its words are: a copy needs no rare words to be found.
A candidate's surroundings must then hold a common subsequence of at least ``LCS_SHARE`` of the item's words,
within a stretch not much longer than the item, and ``ANSWER_SHARE`` of its answer words (its rarest ones), so
that paraphrases with replaced or inserted words are found and texts that only share common words are not.
Items of fewer than ``LEAST_WORDS`` words are searched for as exact sequences of words, by one automaton.

Scale. Two narrow maps over whole texts (passages, search) and no shuffle of texts; the terms of the passages are stored, for the frequencies and the
three passes of the decomposition. What is sent is bounded: items go in
blocks of at most ``MAX_ITEMS``, terms of a block at most ``MAX_TERMS``, the latent basis terms by ``RANK``; an index is
destroyed behind the jobs that read it, but for the last ones of :func:`keep_uncontaminated`, whose result is a plan that reads them. Blocks have spaces of their own, so a paraphrase's candidates may differ with the blocks; exact
copies and runs of ``SEED_WORDS`` words don't depend on them. The sums A'A add up in Spark, and the driver gets one row for each term. The decomposition
reads all documents, and all are searched.

Edge cases. A null or empty text matches nothing, nor does an item without words. An item of fewer than ``LEAST_WORDS``
words begins and ends at word bounds, unless its outer character is of a script that may be written without spaces
(from U+0E00 on): there it may lie within a longer run. Rows without doc_id or item_id take no part (:func:`keep_uncontaminated` keeps rows without
doc_id unless their text matches). Repeated rows and items each count; (doc_id, item_id) is reported
once. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, U64, Block, stored, table, text_blocks, window_hashes, word_hashes, word_spans

CELL = 16
SCALES = (2, 4)
RANK = 128
OVERSAMPLING = 16
#: No term weighs less than this share of the greatest weight, however many passages hold it: contamination itself
#: makes an item's words common.
LEAST_WEIGHT = 0.05
#: A run of so many of an item's words makes it a candidate.
SEED_WORDS = 5
#: Energy of the items' rows against the corpus' rows in the decomposition: the space is to tell items apart.
ITEM_ENERGY = 20.0
MAX_ITEMS = 2_048
MAX_TERMS = 1 << 16
#: Blocks whose indexes :func:`keep_uncontaminated` holds at the same time.
BLOCKS_AT_ONCE = 2
#: Tasks whose sums meet, at most; terms whose sums travel together; passages that are multiplied at once.
SUM_TASKS = 512
TERMS_A_GROUP = 128
ROWS_AT_ONCE = 32
COSINE = 0.5
#: Least share of an item's own latent length that a passage must reach along it: one rare word points the
#: same way as its item, but not as far.
REACH = 0.4
LCS_SHARE = 0.6
ANSWER_SHARE = 0.5
ANSWER_WORDS = 6
LEAST_WORDS = 8
#: Items of more words than the longest passage are compared in parts of its length, one every so many words.
PART = CELL * SCALES[-1]
PART_STEP = PART // 2
#: Parts that are compared at once.
PARTS_AT_ONCE = 2_048
#: Scripts from here on may be written without spaces.
UNSPACED = "\u0e00"
#: A matching stretch may be this much longer than its item.
STRETCH = 1.5
#: Bytes as read: ASCII letters in lower case, ASCII punctuation as white space.
READ = LOWER.copy()
READ[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def read_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the bounds of each text's words."""
    data = READ[data]
    starts, ends, bounds = word_spans(data, offsets)
    return word_hashes(data, starts, ends), bounds


def item_words(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    return read_words(raw, np.array([0, len(raw)]))[0] if len(raw) else np.zeros(0, dtype=U64)


class Terms(NamedTuple):
    """Sorted term hashes; most words that are no terms are told by a bit table, the rest by binary search."""

    keys: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, sorted_hashes: np.ndarray) -> Terms:
        """The table has 16 to 32 bits for each term, 2**16 at least."""
        size = 1 << max(16, (16 * len(sorted_hashes)).bit_length())
        bits = np.zeros(size, dtype=bool)
        bits[(sorted_hashes & U64(size - 1)).astype(np.int64)] = True
        return cls(sorted_hashes, bits)

    def look(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the terms, -1 for none."""
        out = np.full(len(words), -1, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(words & U64(len(self.bits) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, words[maybe]), len(self.keys) - 1)
        same = self.keys[at] == words[maybe]
        out[maybe[same]] = at[same]
        return out


class Items(NamedTuple):
    ids: list[int]
    words: list[np.ndarray]
    vocabulary: np.ndarray
    terms: Terms
    short: list[tuple[int, str]]  # id and pattern in a spaced text of the items of few words

    def parts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Words of the overlapping parts of all items, and the item of each part."""
        found = [(n, w[k : k + PART]) for n, w in enumerate(self.words) for k in part_starts(len(w))]
        return [w for _, w in found], np.array([n for n, _ in found], dtype=np.int64)


def part_starts(n_words: int) -> list[int]:
    last = max(0, n_words - PART)
    return [*range(0, last, PART_STEP), last]


def spaced(data: np.ndarray) -> str:
    """The words of a text as read, with one space before, between and behind them."""
    return f" {b' '.join(READ[data].tobytes().split()).decode()} "


def short_pattern(text: str) -> str:
    words = spaced(np.frombuffer(text.encode(), dtype=np.uint8))
    return words[words[1] >= UNSPACED : len(words) - (words[-2] >= UNSPACED)]


def item_block(rows: list[tuple[int, str | None]]) -> Items | None:
    read = [(i, t, item_words(t)) for i, t in rows]
    own = [(i, w) for i, _, w in read if len(w) >= LEAST_WORDS]
    short = [(i, short_pattern(t)) for i, t, w in read if 0 < len(w) < LEAST_WORDS]
    if not own and not short:
        return None
    vocabulary = np.unique(np.concatenate([w for _, w in own])) if own else np.zeros(0, dtype=U64)
    return Items([i for i, _ in own] + [i for i, _ in short], [w for _, w in own], vocabulary, Terms.of(vocabulary), short)


def within_terms(rows: list[tuple[int, str | None]]) -> Iterator[list[tuple[int, str | None]]]:
    """The items in runs of at most MAX_TERMS different words; one that alone has more is a run of its own."""
    run: list[tuple[int, str | None]] = []
    seen: set[int] = set()
    for row in rows:
        words = set(item_words(row[1]).tolist())
        if run and len(seen | words) > MAX_TERMS:
            yield run
            run, seen = [], set()
        run.append(row)
        seen |= words
    if run:
        yield run


def _cells(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every word, and the bounds of each text's cells."""
    sizes = np.diff(bounds)
    counts = -(-sizes // width)
    heads = np.concatenate([[0], np.cumsum(counts)])
    position = np.arange(bounds[-1]) - np.repeat(bounds[:-1], sizes)
    return np.repeat(heads[:-1], sizes) + position // width, heads


def corpus_passages(docs: DataFrame, items: Items) -> DataFrame:
    """(terms, times, item): the different terms of each passage of the corpus, none of some, and of each part of the items, and how often they occur there."""
    sent = docs.sparkSession.sparkContext.broadcast(items.terms)
    n_terms = len(items.vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            words, bounds = read_words(block.data, block.offsets)
            cell, heads = _cells(bounds, CELL * SCALES[-1])
            term = sent.value.look(words)
            own = term >= 0
            pairs, times = np.unique(cell[own] * n_terms + term[own], return_counts=True)
            cuts = pa.array(np.searchsorted(pairs, np.arange(heads[-1] + 1) * n_terms), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x.astype(np.int32))) for x in (pairs % n_terms, times)]
            yield pa.record_batch([*lists, pa.array(np.zeros(heads[-1], dtype=bool))], names=["terms", "times", "item"])

    schema = "terms array<int>, times array<int>, item boolean"
    own = [np.unique(items.terms.look(w), return_counts=True) for w in items.parts()[0]]
    own = docs.sparkSession.createDataFrame([(t.tolist(), n.tolist(), True) for t, n in own], schema)
    return docs.select("text").mapInArrow(run, schema).unionByName(own)


def document_frequencies(passages: DataFrame, n_terms: int) -> tuple[np.ndarray, int]:
    """In how many passages of the corpus each term occurs, and the number of passages."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 1, dtype=np.int64)
        for batch in batches:
            total[:-1] += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
            total[-1] += batch.num_rows
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["term", "n"])

    own = passages.filter("NOT item").select("terms").mapInArrow(run, "term long, n long")
    rows = own.groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros(n_terms + 1, dtype=np.int64)
    total[rows["term"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy(dtype=np.int64)
    return total[:-1], int(total[-1])


def _times(passages: DataFrame, weight: np.ndarray, thin: np.ndarray, item_length: float) -> np.ndarray:
    """A'A times a thin matrix, summed over all passages; rows of A are TF-IDF passages of length one, items of ``item_length``.

    Products of a few rows are of single precision, their sums of double.
    """
    sent = passages.sparkSession.sparkContext.broadcast((weight, thin.astype(np.float32)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, thin = sent.value
        total = np.zeros(thin.shape)
        for batch in batches:
            lists = batch.column(0)
            bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
            row = np.repeat(np.arange(len(lists)), np.diff(bounds))
            term = lists.flatten().to_numpy(zero_copy_only=False)
            value = batch.column(1).flatten().to_numpy(zero_copy_only=False) * weight[term]
            length = np.sqrt(np.bincount(row, value**2, minlength=len(lists)))
            wanted = np.where(batch.column(2).to_numpy(zero_copy_only=False), item_length, 1.0)
            value = (value * (wanted / np.maximum(length, 1e-12))[row]).astype(np.float32)
            for first in range(0, len(lists), ROWS_AT_ONCE):
                low, high = bounds[first], bounds[min(first + ROWS_AT_ONCE, len(lists))]
                if low < high:
                    own, at = np.unique(term[low:high], return_inverse=True)
                    rows = np.zeros((ROWS_AT_ONCE, len(own)), dtype=np.float32)
                    rows[row[low:high] - first, at] = value[low:high]
                    total[own] += rows.T @ (rows @ thin[own])
        for low in range(0, len(total), TERMS_A_GROUP):
            part = total[low : low + TERMS_A_GROUP]
            if part.any():
                yield pa.record_batch([pa.array([low], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["first", "rows"])

    def add(group: pa.Table) -> pa.Table:
        # one row for each task, SUM_TASKS of them at most
        total = sum(np.frombuffer(x.as_buffer(), dtype=np.float64) for x in group.column("rows"))
        return pa.table({"first": group.column("first")[:1], "rows": pa.array([total.tobytes()], pa.binary())})

    schema = "first long, rows binary"
    total = np.zeros(thin.shape)
    for row in passages.coalesce(SUM_TASKS).mapInArrow(run, schema).groupBy("first").applyInArrow(add, schema).collect():
        part = np.frombuffer(row["rows"], dtype=np.float64).reshape(-1, thin.shape[1])
        total[row["first"] : row["first"] + len(part)] = part
    sent.destroy()
    return total


def latent_basis(passages: DataFrame, weight: np.ndarray, rank: int = RANK, seed: int = 7) -> np.ndarray:
    """The leading right singular vectors, terms by rank."""
    counts = {bool(r["item"]): r["count"] for r in passages.filter("size(terms) > 0").groupBy("item").count().collect()}
    item_length = float(np.sqrt(max(1.0, ITEM_ENERGY * counts.get(False, 0) / max(1, counts.get(True, 0)))))
    width = min(rank + OVERSAMPLING, len(weight))
    basis = np.random.default_rng(seed).normal(size=(len(weight), width))
    for _ in range(2):
        basis, _ = np.linalg.qr(_times(passages, weight, basis, item_length))
    _, vectors = np.linalg.eigh(basis.T @ _times(passages, weight, basis, item_length))
    return np.ascontiguousarray((basis @ vectors[:, ::-1])[:, :rank], dtype=np.float32)


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a row of the table at a time as the bits of one integer."""
    places: dict[int, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if m := places.get(x):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


class Index(NamedTuple):
    items: Items
    weighted: np.ndarray  # latent vector of each term times its weight
    telling: np.ndarray  # whether a term has a weight; the last place is for words that are no terms
    of: np.ndarray  # the item of each part
    vectors: np.ndarray  # latent vectors of the items' parts, of length one
    lengths: np.ndarray  # what their lengths were
    seeds: Terms  # hashes of the runs of SEED_WORDS words of the items
    holders: list[list[int]]  # the items of each run
    patterns: list[list[int]]  # the items' words as terms
    answers: list[set[int]]

    def verified(self, terms: list[int], item: int) -> tuple[float, float]:
        """The best shares of the item's words and of its answer words in a stretch of ``terms`` that has enough of both."""
        pattern = self.patterns[item]
        own = set(pattern)
        at = [k for k, t in enumerate(terms) if t in own]
        least = LCS_SHARE * len(pattern)
        if len(at) < least:
            return 0.0, 0.0
        size = int(len(pattern) * STRETCH) + 1
        best = (0.0, 0.0)
        answers = self.answers[item]
        end = 0
        most = len(pattern)
        # a stretch may as well begin with one of the item's words
        for n, low in enumerate(at):
            behind = end
            while end < len(at) and at[end] < low + size:
                end += 1
            # a stretch has at most as many words in common as one before it, and those put in since
            most += end - behind
            if end - n >= least and most >= max(least, best[0] * len(pattern) - 0.5):
                part = [terms[k] for k in at[n:end]]
                most = common_subsequence(pattern, part)
                shares = (most / len(pattern), len(answers.intersection(part)) / len(answers))
                if shares[0] >= LCS_SHARE and shares[1] >= ANSWER_SHARE:
                    best = max(best, shares)
                if best == (1.0, 1.0):
                    break
        return best

    def short_automaton(self) -> ahocorasick.Automaton | None:
        """Of the items of few words; a task builds it once."""
        patterns: dict[str, list[int]] = {}
        for n, (_, pattern) in enumerate(self.items.short, len(self.items.words)):
            patterns.setdefault(pattern, []).append(n)
        if not patterns:
            return None
        automaton = ahocorasick.Automaton()
        for pattern, own in patterns.items():
            automaton.add_word(pattern, own)
        automaton.make_automaton()
        return automaton

    def short_matches(self, block: Block, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float, float, float]]:
        """(row of the block, item, 1, 1, 1) for the items of few words, each pair once."""
        out: list[tuple[int, int, float, float, float]] = []
        if automaton is None:
            return out
        for row in range(len(block.offsets) - 1):
            text = spaced(block.data[block.offsets[row] : block.offsets[row + 1]])
            out += [(row, i, 1.0, 1.0, 1.0) for i in sorted({i for _, own in automaton.iter(text) for i in own})]
        return out

    def matches(self, block: Block, automaton: ahocorasick.Automaton | None) -> list[tuple[int, int, float, float, float]]:
        """(row of the block, item, cosine, share of words, share of answer words), each pair once; ``automaton`` is :meth:`short_automaton`'s."""
        return self.long_matches(block) + self.short_matches(block, automaton)

    def long_matches(self, block: Block) -> list[tuple[int, int, float, float, float]]:
        if not self.items.words:
            return []
        words, bounds = read_words(block.data, block.offsets)
        if not len(words):
            return []
        cell, heads = _cells(bounds, CELL)
        term = self.items.terms.look(words)
        candidates = self.near(term, cell, heads)
        hashes, first = window_hashes(words, bounds, SEED_WORDS)
        seed = self.seeds.look(hashes)
        for w in np.flatnonzero(seed >= 0).tolist():
            c = int(cell[first[w]])
            for i in self.holders[seed[w]]:
                if (c, i) not in candidates:
                    candidates[c, i] = self.cosine(term, cell, heads, c, i)
        text_of = np.repeat(np.arange(len(heads) - 1), np.diff(heads))
        places: dict[tuple[int, int], list[tuple[int, float]]] = {}
        for (c, i), cosine in sorted(candidates.items()):
            row = int(text_of[c])
            places.setdefault((row, i), []).append((int(bounds[row]) + (c - int(heads[row])) * CELL, cosine))
        out = []
        for (row, i), found in sorted(places.items()):
            around = int(len(self.items.words[i]) * STRETCH) + 1
            # surroundings that overlap are looked through once
            stretches: list[list] = []
            for low, cosine in found:
                if stretches and low - around <= stretches[-1][1]:
                    stretches[-1][1:] = [low + PART + around, max(stretches[-1][2], cosine)]
                else:
                    stretches.append([low - around, low + PART + around, cosine])
            best = (0.0, 0.0, 0.0)
            for low, high, cosine in stretches:
                share, answer = self.verified(term[max(int(bounds[row]), low) : min(int(bounds[row + 1]), high)].tolist(), i)
                best = max(best, (share, answer, cosine))
                if share == 1.0:
                    break
            if best[0]:
                out.append((row, i, best[2], best[0], best[1]))
        return out

    def cosine(self, term: np.ndarray, cell: np.ndarray, heads: np.ndarray, c: int, i: int) -> float:
        """The cosine of the longest passage from a cell and the nearest part of an item."""
        last = min(c + SCALES[-1], int(heads[np.searchsorted(heads, c, "right")]))
        own = term[np.searchsorted(cell, c) : np.searchsorted(cell, last)]
        v = self.weighted[own[own >= 0]].sum(axis=0)
        return float((self.vectors[self.of == i] @ v).max() / max(float(np.sqrt((v**2).sum())), 1e-12))

    def near(self, term: np.ndarray, cell: np.ndarray, heads: np.ndarray) -> dict[tuple[int, int], float]:
        """The cosine of each cell and item where a passage from that cell is near a part of that item."""
        at = np.flatnonzero(self.telling[term])
        if not len(at):
            return {}
        n = int(heads[-1])
        vectors = np.zeros((n, self.weighted.shape[1]), dtype=np.float32)
        own = cell[at]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        nth = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        for k in range(int(nth.max()) + 1):  # at most CELL rounds; in each a cell occurs once
            part = np.flatnonzero(nth == k)
            vectors[own[part]] += self.weighted[term[at[part]]]
        last_cell = np.repeat(heads[1:], np.diff(heads))  # behind the last cell of each cell's text
        candidates: dict[tuple[int, int], float] = {}
        summed = np.zeros((n + 1, vectors.shape[1]))
        np.cumsum(vectors, axis=0, out=summed[1:])
        for scale in SCALES:
            high = np.minimum(np.arange(n) + scale, last_cell)
            passage = (summed[high] - summed[:-1]).astype(np.float32)
            length = np.sqrt((passage**2).sum(axis=1))
            # no passage reaches further along an item than it is long
            far = np.flatnonzero(length >= REACH * self.lengths.min())
            for low in range(0, len(far), 8192):
                part = far[low : low + 8192]
                for p in range(0, len(self.of), PARTS_AT_ONCE):
                    along = passage[part] @ self.vectors[p : p + PARTS_AT_ONCE].T
                    rows, found = np.nonzero((along >= COSINE * length[part, None]) & (along >= REACH * self.lengths[p : p + PARTS_AT_ONCE]))
                    for c, i, value in zip(part[rows].tolist(), self.of[p + found].tolist(), (along[rows, found] / length[part[rows]]).tolist()):
                        candidates[c, i] = max(candidates.get((c, i), 0.0), value)
        return candidates


def build_index(docs: DataFrame, items: Items) -> Index:
    if not items.words:
        nothing = np.zeros((0, 0), dtype=np.float32)
        return Index(items, nothing, np.zeros(1, dtype=bool), np.zeros(0, dtype=np.int64), nothing, np.zeros(0, dtype=np.float32), Terms.of(items.vocabulary), [], [], [])
    passages = stored(corpus_passages(docs, items))
    frequencies, n = document_frequencies(passages.df, len(items.vocabulary))
    # squared, so that a language's common words, many times in a passage, don't outweigh its rare ones
    weight = np.log((n + 1 + len(items.ids)) / (frequencies + 1.0)) ** 2
    weight = np.maximum(weight, LEAST_WEIGHT * weight.max())
    if not weight.any():
        weight[:] = 1.0
    weighted = latent_basis(passages.df, weight) * weight[:, None].astype(np.float32)
    passages.drop()
    vectors, lengths, patterns, answers = [], [], [], []
    parts, of = items.parts()
    for words in parts:
        v = weighted[items.terms.look(words)].sum(axis=0)
        lengths.append(max(float(np.sqrt((v**2).sum())), 1e-12))
        vectors.append(v / lengths[-1])
    for words in items.words:
        term = items.terms.look(words)
        patterns.append(term.tolist())
        answers.append(set(term[np.argsort(-weight[term], kind="stable")[:ANSWER_WORDS]].tolist()))
    bounds = np.cumsum([0, *map(len, items.words)])
    hashes, first = window_hashes(np.concatenate(items.words), bounds, SEED_WORDS)
    holder = np.searchsorted(bounds, first, "right") - 1
    seeds, at = np.unique(hashes, return_inverse=True)
    holders: list[list[int]] = [[] for _ in seeds]
    for k, i in sorted(set(zip(at.tolist(), holder.tolist()))):
        holders[k].append(i)
    return Index(items, weighted, np.append(weight > 0, False), of, np.array(vectors, dtype=np.float32), np.array(lengths, dtype=np.float32), Terms.of(seeds), holders, patterns, answers)


def indexes(docs: DataFrame, benchmark: DataFrame) -> Iterator[Index]:
    """An index for each block of items."""
    own = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    n_blocks = max(1, -(-own.count() // (MAX_ITEMS // 2)))
    for b in range(n_blocks):
        rows = [(r["item_id"], r["text"]) for r in own.filter(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).orderBy("item_id", "text").collect()]
        for run in within_terms(rows):
            if items := item_block(run):
                yield build_index(docs, items)


MATCHES = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs_share", pa.float64()), ("answer_share", pa.float64())])


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share): documents that hold an item, each pair once."""
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id IS NOT NULL")
    found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, lcs_share double, answer_share double")
    for index in indexes(own, benchmark):
        sent = spark.sparkContext.broadcast(index)

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = sent.value
            short = index.short_automaton()
            for block in text_blocks(batches, max_bytes=1 << 20):
                ids = block.column("doc_id")
                rows = [(int(ids[r]), index.items.ids[i], *x) for r, i, *x in index.matches(block, short)]
                yield pa.record_batch([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(MATCHES)], schema=MATCHES)

        found = found.unionByName(stored(own.mapInArrow(run, found.schema)).df)
        sent.destroy()
    # repeated rows of a document or an item
    best = F.max_by(F.struct("cosine", "lcs_share", "answer_share"), F.struct("lcs_share", "answer_share", "cosine")).alias("best")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs``, all columns kept, without the rows that hold a benchmark item.

    ``BLOCKS_AT_ONCE`` blocks of items filter in one pass; where there are more, what is kept so far is stored and their indexes go.
    """
    kept, before, held = docs, None, []
    for index in indexes(docs, benchmark):
        if len(held) == BLOCKS_AT_ONCE:
            after = stored(kept)
            for sent in held:
                sent.destroy()
            if before:
                before.drop()
            kept, before, held = after.df, after, []
        held.append(docs.sparkSession.sparkContext.broadcast(index))

        def run(batches: Iterable[pa.RecordBatch], sent=held[-1]) -> Iterator[pa.RecordBatch]:
            short = sent.value.short_automaton()
            for block in text_blocks(batches, max_bytes=1 << 20):
                keep = np.ones(block.rows.num_rows, dtype=bool)
                keep[[r for r, *_ in sent.value.matches(block, short)]] = False
                yield block.rows.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
