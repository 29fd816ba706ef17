"""Language-model scores by a Brown class-based bigram model.

Method. Exchange clustering assigns every training word to a class: a word moves to the class that most raises the
class bigram likelihood. The ``SEEDS`` most frequent words are exchanged one at a time until none moves; the ``UNITS`` most
frequent words then in passes over the corpus, in each of which half of them move by their exact gains, until a
pair of passes gains less than ``LEAST_GAIN`` a token; every other word joins the class of
greatest gain in the table so reached. Words seen once are left out of that, as leaving one out leaves them no context: they
make up the open class, which is also the class of words that training has not seen. A token's probability is p(class | class before) p(word | class); the end of a text is a
class of its own and also stands before the first word. Transitions, counted over all training tokens with all
words in their classes, interpolate with the class unigram; emissions are additively smoothed, with one slot for all
unseen words in the open class.

Scale. Word counts, N, V, the classes of all words and the transitions cover all training tokens. The driver and every
task hold the ``DICTIONARY`` most frequent words and tables of UNITS by CLASSES, sizes that are parameters; all other
words stay in tables. Texts are cut into words twice: to count them, and to store them as places in the dictionary with the other
words beside them; passes read those places, and a task sends its summed contexts, not its tokens. Words outside the
dictionary meet their class and count in a sort-merge join and go back to their row by its number; a word that fills a third of the
held-out rows is a skewed partition there, which adaptive execution splits.

Edge cases. A null text is an empty one: one token, the end. Rows without doc_id take no part (they are in no
fold). Repeated rows count as often as they occur and each gives a row. Without training rows N and V are zero and
every word is unseen. A word that only has unclassed words beside it joins the open class. An empty table gives an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stored, named, stored, table, text_blocks

DICTIONARY = 1 << 17
UNITS = 1 << 14
SEEDS = 700
CLASSES = 40
#: Nats a token that two passes over the units must gain for another one.
LEAST_GAIN = 0.02
#: Share of the class bigram against the class unigram in a transition.
LAMBDA = 0.95
DELTA = 0.5
HELD_OUT = "crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 7 = 2"
WORDS_PER_CHUNK = 500_000
#: Words whose gains are worked out at once.
BATCH = 64
#: Tokens that a pass takes at once.
TOKENS = 1 << 20
#: Files of the stored corpus that one task of a pass reads, so that its sums combine more.
FILES_A_TASK = 4


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all tokens of ``training`` but the ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()
        held = 0

        def flushed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for block in text_blocks(batches):
            for i in range(len(block.offsets) - 1):
                words = block.text(i).lower().split()
                held += len(words)
                counts.update(words)
            if held >= WORDS_PER_CHUNK:
                yield flushed()
                counts.clear()
                held = 0
        if counts:
            yield flushed()

    return training.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> pd.DataFrame:
    """(word, n) of the most frequent words, at most DICTIONARY of them, most frequent first.

    A limit would have every task send that many rows; a histogram of counts (sixteen steps to a doubling, so a
    thousand rows whatever the corpus) finds the count from which all words fit.
    """
    step = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    sizes = sorted(((r["step"], r["words"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).collect()), reverse=True)
    least, held = None, 0
    for at, words in sizes:
        held += words
        if held > DICTIONARY:
            break
        least = at
    found = counts.filter(step >= least if least is not None else F.lit(False)).toPandas()
    return found.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)


class Missing(dict):
    """A dictionary of words that gives -1 for any other."""

    def __missing__(self, word):
        return -1


def lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values))


def placed(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """(row, doc_id, training, places, others) of every row: each token's place in the dictionary, -1 for the words in others."""
    sent = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Missing({w: k for k, w in enumerate(sent.value)})
        for block in text_blocks(batches, max_bytes=1 << 20):
            places: list[int] = []
            others: list[bytes] = []
            sizes, rest = [], []
            for i in range(len(block.offsets) - 1):
                text = block.text(i).lower().split()
                own = list(map(known.__getitem__, text))
                before = len(others)
                if -1 in own:
                    others += [w for w, k in zip(text, own) if k < 0]
                places += own
                sizes.append(len(own))
                rest.append(len(others) - before)
            strings = pa.array(others, pa.binary()).cast(pa.string())
            parts = [pa.array(block.column(c)) for c in ("row", "doc_id", "training")]
            other_lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(rest)]), pa.int32()), strings)
            yield pa.record_batch([*parts, lists(np.array(places, dtype=np.int32), np.array(sizes)), other_lists], names=["row", "doc_id", "training", "places", "others"])

    own = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "training", "text")
    return own.mapInArrow(run, "row long, doc_id long, training boolean, places array<int>, others array<string>")


def stream(places: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """All tokens in order with an end behind each text, and the index of each text's first token."""
    sizes = places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(sizes + 1)])
    tokens = np.full(heads[-1], end, dtype=np.int64)
    word = np.ones(heads[-1], dtype=bool)
    word[heads[1:] - 1] = False
    tokens[word] = places.flatten().to_numpy(zero_copy_only=False)
    return tokens, heads[:-1]


def streams(batches: Iterable[pa.RecordBatch], end: int) -> Iterator[np.ndarray]:
    """Tokens of the column ``places``, a bounded number of texts at a time; a text goes on from an end."""
    for batch in batches:
        places = batch.column(batch.schema.get_field_index("places"))
        total = np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        low = 0
        while low < len(places):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + TOKENS, "right")))
            yield stream(places.slice(low, high - low), end)[0]
            low = high


def _summed(rows: DataFrame, keys: list[str], *values: str) -> DataFrame:
    return rows.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def _dense(rows: DataFrame, key: str, length: int) -> np.ndarray:
    """The sums of column n by a whole-number key below ``length``, as an array; batch by batch, no row objects."""
    out = np.zeros(length)
    for batch in _summed(rows, [key], "n").toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _passing(corpus: Stored) -> DataFrame:
    """The training rows' places, several files to a task."""
    own = corpus.df.filter("training").select("places")
    return own.coalesce(max(1, own.rdd.getNumPartitions() // FILES_A_TASK))


def seed_bigrams(corpus: Stored, seeds: int, end: int) -> np.ndarray:
    """Counts of bigrams among the ``seeds`` first words and the end, which comes last."""
    size = seeds + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for tokens in streams(batches, end):
            tokens = np.where(tokens == end, seeds, np.where(tokens < seeds, tokens, -1))
            before = np.concatenate([[seeds], tokens[:-1]])
            both = (tokens >= 0) & (before >= 0)
            total += np.bincount(before[both] * size + tokens[both], minlength=size * size)
        pairs = np.flatnonzero(total)
        yield pa.record_batch([pa.array(pairs, pa.int64()), pa.array(total[pairs], pa.int64())], names=["pair", "n"])

    return _dense(_passing(corpus).mapInArrow(run, "pair long, n long"), "pair", size * size).reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(pairs: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that depends on the classes."""
    return float(_xlogx(pairs).sum() - _xlogx(pairs.sum(axis=0)).sum() - _xlogx(pairs.sum(axis=1)).sum())


def gains(pairs: np.ndarray, of: np.ndarray, left: np.ndarray, right: np.ndarray, loops: np.ndarray) -> np.ndarray:
    """Words by classes: what the likelihood gains if the word joins the class, all others staying.

    ``pairs`` counts class bigrams, a word's own ones among them where it has a class (``of``, else -1). ``left`` and
    ``right`` count the classes before and after each word, without its bigrams with itself, which ``loops`` counts.
    """
    out = np.empty((len(of), len(pairs)))
    for low in range(0, len(of), BATCH):
        own = slice(low, min(low + BATCH, len(of)))
        a, l, r, k = of[own], left[own], right[own], loops[own]
        without = np.repeat(pairs[None], len(a), axis=0)
        has = np.flatnonzero(a >= 0)
        without[has, a[has], :] -= r[has]
        without[has, :, a[has]] -= l[has]
        without[has, a[has], a[has]] -= k[has]
        base = _xlogx(without)
        # the neighbours' own totals grow by the word's bigrams whichever class it joins
        rows, columns, d = without.sum(axis=2) + l, without.sum(axis=1) + r, without.diagonal(axis1=1, axis2=2)
        found = (_xlogx(without + r[:, None, :]) - base).sum(axis=2) + (_xlogx(without + l[:, :, None]) - base).sum(axis=1)
        found += _xlogx(d + r + l + k[:, None]) - _xlogx(d + r) - _xlogx(d + l) + _xlogx(d)
        found -= _xlogx(rows + (r.sum(axis=1) + k)[:, None]) - _xlogx(rows) + _xlogx(columns + (l.sum(axis=1) + k)[:, None]) - _xlogx(columns)
        out[own] = found
    return out


def exchange(bigrams: np.ndarray, classes: int) -> np.ndarray:
    """The class of each unit, one move at a time until none gains. The last unit (the end) is the last class and stays there."""
    size = len(bigrams)
    free = max(1, classes - 1)
    weight = bigrams.sum(axis=0) + bigrams.sum(axis=1)
    of = np.empty(size, dtype=np.int64)
    order = np.lexsort((np.arange(size - 1), -weight[:-1]))
    of[order] = np.arange(size - 1) % free
    of[-1] = free
    n = bigrams.astype(np.float64)
    one = np.zeros((size, free + 1))
    one[np.arange(size), of] = 1.0
    out_of, into = n @ one, n.T @ one  # unit by class: bigrams from the unit, to the unit
    pairs = one.T @ out_of
    moved = True
    while moved:
        moved = False
        for u in order[weight[order] > 0]:
            a, loop = of[u], n[u, u]
            right, left = out_of[u].copy(), into[u].copy()
            right[a] -= loop
            left[a] -= loop
            gain = gains(pairs, of[u : u + 1], left[None], right[None], n[u : u + 1, u])[0, :free]
            b = int(gain.argmax())
            # counts are whole, so a gain that is real is far above this
            if gain[b] <= gain[a] + 1e-6:
                continue
            for c, sign in ((a, -1), (b, 1)):
                pairs[c] += sign * right
                pairs[:, c] += sign * left
                pairs[c, c] += sign * loop
                out_of[:, c] += sign * n[:, u]
                into[:, c] += sign * n[u]
            of[u] = b
            moved = True
    return of


def unit_contexts(corpus: Stored, of: np.ndarray, end: int, classes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of the classes before and after each unit (units by classes), and of each unit after itself.

    ``of`` has the class of each unit, -1 for none yet; its last place is the end.
    """
    size = len(of)
    class_of = np.full(end + 2, -1)
    class_of[: size - 1], class_of[end] = of[:-1], of[-1]
    unit_of = np.full(end + 2, -1)
    unit_of[: size - 1], unit_of[end] = np.arange(size - 1), size - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = np.zeros(size * classes, dtype=np.int64), np.zeros(size * classes, dtype=np.int64)
        loops = np.zeros(size, dtype=np.int64)
        for tokens in streams(batches, end):
            unit, own = unit_of[tokens], class_of[tokens]
            before, before_class = (np.concatenate([[x], y[:-1]]) for x, y in ((size - 1, unit), (of[-1], own)))
            at = (unit >= 0) & (before_class >= 0)
            left += np.bincount(unit[at] * classes + before_class[at], minlength=len(left))
            at = (before >= 0) & (own >= 0)
            right += np.bincount(before[at] * classes + own[at], minlength=len(right))
            loops += np.bincount(unit[(unit == before) & (unit >= 0)], minlength=size)
        for first, total in ((0, left), (len(left), right), (2 * len(left), loops)):
            found = np.flatnonzero(total)
            yield pa.record_batch([pa.array(found + first, pa.int32()), pa.array(total[found], pa.int64())], names=["place", "n"])

    total = _dense(_passing(corpus).mapInArrow(run, "place int, n long"), "place", size * (2 * classes + 1))
    left, right = total[: 2 * size * classes].reshape(2, size, classes)
    return left, right, total[2 * size * classes :]


def class_pairs(of: np.ndarray, right: np.ndarray) -> np.ndarray:
    pairs = np.zeros((right.shape[1], right.shape[1]))
    np.add.at(pairs, of[of >= 0], right[of >= 0])
    return pairs


def clustered(corpus: Stored, n_words: int, repeated: int, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray]:
    """The class of each unit (the end comes last), and the class bigrams of the units.

    The dictionary has ``n_words`` words, the first ``repeated`` of them seen twice or more.
    """
    units, seeds = min(UNITS, repeated), min(SEEDS, repeated)
    free = classes - 2  # the last two are the open class and the end
    of = np.full(units + 1, -1)
    of[:seeds], of[-1] = exchange(seed_bigrams(corpus, seeds, n_words), classes - 1)[:-1], classes - 1
    dealt = (np.arange(units) * 40503 >> 4) & 1
    kept = None
    gained, share, turn = [np.inf, np.inf], 1.0, 0
    draw = np.random.default_rng(11)
    while True:
        left, right, loops = unit_contexts(corpus, of, n_words, classes)
        pairs = class_pairs(of, right)
        whole = bool((of >= 0).all())
        if whole:
            now = likelihood(pairs)
            if kept is not None and now < kept[0]:
                # moves that were made at once got in each other's way: take them back and try fewer
                share /= 2
                if share < 1 / 8:
                    break
            else:
                gained = [gained[1], np.inf if kept is None else now - kept[0]]
                kept = (now, of, pairs, left, right, loops)
                if sum(gained) <= LEAST_GAIN * pairs.sum():
                    break
            _, of, pairs, left, right, loops = kept
        # in a random order, so that neighbours in frequency don't follow one another
        own = draw.permutation(np.flatnonzero((dealt == turn % 2) & (draw.random(units) < share)) if whole else np.flatnonzero(of[:-1] < 0))
        turn += whole
        at, has = of[own], np.flatnonzero(of[own] >= 0)
        l, r, k = left[own], right[own], loops[own]
        l[has, at[has]] -= k[has]
        r[has, at[has]] -= k[has]
        of, pairs, moved = of.copy(), pairs.copy(), 0
        for n in range(len(own)):
            # one at a time: words that see the same empty class at once would all move into it. Later words see the table as
            # the earlier ones' moves leave it, but for bigrams of two words that move
            part = slice(n, n + 1)
            gain = gains(pairs, at[part], l[part], r[part], k[part])[0, :free]
            best = int(gain.argmax())
            if gain[best] <= (gain[at[n]] if at[n] >= 0 else -np.inf) + 1e-6:
                continue
            for c, sign in ((at[n], -1), (best, 1)):
                if c >= 0:
                    pairs[c] += sign * r[n]
                    pairs[:, c] += sign * l[n]
                    pairs[c, c] += sign * k[n]
            of[own[n]] = best
            moved += 1
        if whole and not moved:
            gained = [gained[1], 0.0]
            if sum(gained) <= LEAST_GAIN * pairs.sum():
                break
    return kept[1], kept[2]


def other_contexts(corpus: Stored, words: list[bytes], of: np.ndarray, classes: int) -> DataFrame:
    """(word, place, pair, n): how often each word that is no unit stands between two classes; place is -1 outside the dictionary."""
    spark = corpus.df.sparkSession
    end, units, wide = len(words), len(of) - 1, classes + 1
    class_of = np.full(end + 2, -1)
    class_of[:units], class_of[end] = of[:-1], of[-1]
    sent = spark.sparkContext.broadcast(words)
    schema = pa.schema([("word", pa.string()), ("place", pa.int64()), ("pair", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, _ = stream(batch.column(0), end)
            own = class_of[tokens]
            pair = (np.concatenate([[of[-1]], own[:-1]]) + 1) * wide + np.concatenate([own[1:], [-1]]) + 1
            rare = tokens == -1
            text = batch.column(1).flatten().dictionary_encode()
            known = (tokens >= units) & (tokens < end)
            for place, codes, pairs in ((-1, text.indices.to_numpy(zero_copy_only=False), pair[rare]), (0, tokens[known], pair[known])):
                keys, n = np.unique(codes.astype(np.int64) * wide**2 + pairs, return_counts=True)
                codes = keys // wide**2
                if place:
                    said, at = text.dictionary.take(pa.array(codes)), np.full(len(codes), -1)
                else:
                    said, at = pa.array([sent.value[k] for k in codes.tolist()], pa.binary()).cast(pa.string()), codes
                yield pa.record_batch([said, pa.array(at, pa.int64()), pa.array(keys % wide**2, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return corpus.df.filter("training").select("places", "others").mapInArrow(run, "word string, place long, pair long, n long")


def joining_gains(pairs: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """As :func:`gains` for words without a class or bigrams with themselves, by their non-zero contexts alone."""
    base = _xlogx(pairs)
    out = np.zeros(left.shape)
    for counts, table_, of_table in ((right, pairs.T, base.T), (left, pairs, base)):
        word, x = np.nonzero(counts)
        if len(word):
            rows = _xlogx(table_[x] + counts[word, x][:, None]) - of_table[x]
            heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            out[word[heads]] += np.add.reduceat(rows, heads, axis=0)
    d, rows, columns = pairs.diagonal(), pairs.sum(axis=1) + left, pairs.sum(axis=0) + right
    out += _xlogx(d + left + right) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d)
    out -= _xlogx(rows + right.sum(axis=1, keepdims=True)) - _xlogx(rows) + _xlogx(columns + left.sum(axis=1, keepdims=True)) - _xlogx(columns)
    return out


def other_classes(contexts: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(word, place, n, class) of each word of :func:`other_contexts`; open for words seen once or without a classed neighbour."""
    wide = len(pairs) + 1
    schema = pa.schema([("word", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("class", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4096):
                part = batch.slice(low, 4096)
                found = part.column(2)
                word = np.repeat(np.arange(len(found)), found.value_lengths().to_numpy(zero_copy_only=False))
                pair, n = (found.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("pair", "n"))
                sides = []
                for at in (pair // wide, pair % wide):
                    total = np.zeros((len(found), wide))
                    np.add.at(total, (word, at), n)
                    sides.append(total[:, 1:])
                gain = joining_gains(pairs, *sides)[:, : len(pairs) - 2]
                times = np.bincount(word, n, minlength=len(found)).astype(np.int64)
                tells = (times > 1) & (sides[0].any(axis=1) | sides[1].any(axis=1))
                yield pa.record_batch([part.column(0), part.column(1), pa.array(times), pa.array(np.where(tells, gain.argmax(axis=1), len(pairs) - 2), pa.int64())], schema=schema)

    # dealt by the word alone, so that both sums are one shuffle; a word has at most (CLASSES + 1) ** 2 pairs
    each = _summed(contexts.repartition("word", "place"), ["word", "place", "pair"], "n")
    return each.groupBy("word", "place").agg(F.collect_list(F.struct("pair", "n")).alias("found")).mapInArrow(run, "word string, place long, n long, class long")


class Model(NamedTuple):
    words: list[bytes]  # the dictionary
    counts: np.ndarray  # training tokens of each dictionary word
    of: np.ndarray  # class of each dictionary word
    others: Stored  # (word, n, class) of all other training words
    total: np.ndarray  # log10 of each class's emission denominator
    open: int  # class of words that training has not seen
    end_count: int
    n_tokens: int
    n_types: int


def train(corpus: Stored, counts: DataFrame, classes: int = CLASSES) -> Model:
    """The classes of all training words. ``counts`` is their table (word, n)."""
    n_texts = corpus.df.filter("training").count()
    row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    frequent = frequent_words(counts)
    words = [w.encode() for w in frequent["word"]]
    n = frequent["n"].to_numpy(dtype=np.float64)
    units, pairs = clustered(corpus, len(words), int((n > 1).sum()), classes)
    found = stored(other_classes(other_contexts(corpus, words, units, classes), pairs))
    of = np.full(len(words), -1)
    of[: len(units) - 1] = units[:-1]
    own = found.df.filter("place >= 0").select("place", "class").toPandas()
    of[own["place"].to_numpy(dtype=np.int64)] = own["class"].to_numpy(dtype=np.int64)
    others = stored(found.df.filter("place < 0").select("word", "n", "class"))
    found.drop()
    rare = others.df.groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("types")).toPandas()
    mass, types = (np.bincount(of, w, minlength=classes).astype(float) for w in (n, np.ones(len(n))))
    mass[rare["class"].to_numpy(dtype=np.int64)] += rare["n"].to_numpy(dtype=np.float64)
    types[rare["class"].to_numpy(dtype=np.int64)] += rare["types"].to_numpy(dtype=np.float64)
    mass[-1], types[-1], open_class = n_texts, 1, classes - 2
    types[open_class] += 1
    return Model(words, n, of, others, np.log10(np.maximum(mass + DELTA * types, DELTA)), open_class, n_texts, int(row["n"]) + n_texts, int(row["v"]) + (n_texts > 0))


def rare_terms(corpus: Stored) -> DataFrame:
    """(row, word, at): each row's words outside the dictionary and their places in its text."""
    schema = pa.schema([("row", pa.int64()), ("word", pa.string()), ("at", pa.list_(pa.int32()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, heads = stream(batch.column(1), -2)
            rare = np.flatnonzero(tokens == -1)
            if not len(rare):
                continue
            text = batch.column(2).flatten().dictionary_encode()
            code = text.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.searchsorted(heads, rare, "right") - 1
            key = row * len(text.dictionary) + code
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.concatenate([[True], np.diff(key[order]) > 0]))
            at = lists((rare - heads[row])[order].astype(np.int32), np.diff(np.append(first, len(order))))
            heads_ = order[first]
            yield pa.record_batch([batch.column(0).take(pa.array(row[heads_])), text.dictionary.take(pa.array(code[heads_])), at], schema=schema)

    return corpus.df.filter("size(others) > 0").select("row", "places", "others").mapInArrow(run, "row long, word string, at array<int>")


CLASSED = "doc_id long, training boolean, n_tokens long, n_known long, base_score double, emission double, classes array<tinyint>"


def classed(corpus: Stored, model: Model) -> DataFrame:
    """For every row the class of each token, and the parts of its scores that need no transitions."""
    end = len(model.words)
    class_of = np.concatenate([model.of, [len(model.total) - 1, model.open]])
    count_of = np.concatenate([model.counts, [model.end_count, 0]])
    total, open_class = model.total, model.open
    scale = np.log10(model.n_tokens + model.n_types + 1)
    schema = pa.schema([("doc_id", pa.int64()), ("training", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("emission", pa.float64()), ("classes", pa.list_(pa.int8()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, heads = stream(batch.column(2), end)
            of, n = class_of[tokens], count_of[tokens]
            hits = batch.column(3)
            row = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            found = hits.flatten()
            at = found.field("at")
            times = at.value_lengths().to_numpy(zero_copy_only=False)
            place = np.repeat(heads[row], times) + at.flatten().to_numpy(zero_copy_only=False)
            for values, name, none in ((of, "class", open_class), (n, "n", 0)):
                values[place] = np.repeat(found.field(name).fill_null(none).to_numpy(zero_copy_only=False), times)
            sizes = np.diff(np.append(heads, len(tokens)))
            summed = lambda x: np.add.reduceat(x, heads)
            parts = [batch.column(0), batch.column(1), sizes, summed((n > 0).astype(np.int64)), summed(np.log10(n + 1)) - sizes * scale, summed(np.log10(n + DELTA) - total[of]), lists(of.astype(np.int8), sizes)]
            yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(parts, schema)], schema=schema)

    hits = rare_terms(corpus).hint("merge").join(model.others.df.hint("merge"), "word", "left")
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("at", "n", "class")).alias("hits"))
    return corpus.df.join(hits, "row", "left").select("doc_id", "training", "places", "hits").mapInArrow(run, CLASSED)


def transitions(rows: DataFrame, classes: int) -> np.ndarray:
    """log10 of the probability of each class behind each class, from the training rows of :func:`classed`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, dtype=np.int64)
        for batch in batches:
            of = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(of):
                total += np.bincount(np.concatenate([[classes - 1], of[:-1]]) * classes + of, minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.record_batch([pa.array(found, pa.int64()), pa.array(total[found], pa.int64())], names=["pair", "n"])

    pairs = _dense(rows.filter("training").select("classes").mapInArrow(run, "pair long, n long"), "pair", classes * classes).reshape(classes, classes)
    single = (pairs.sum(axis=0) + 1) / (pairs.sum() + classes)
    before = pairs.sum(axis=1, keepdims=True)
    return np.log10(np.where(before > 0, LAMBDA * pairs / np.maximum(before, 1) + (1 - LAMBDA) * single, single))


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def scored(docs: DataFrame, training: str, classes: int = CLASSES) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity) for every row of ``docs``; ``training`` is the condition on doc_id of the rows that are learned from."""
    own = named(docs, "doc_id", "text").selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").withColumn("training", F.expr(training))
    counts = stored(word_counts(own.filter("training")))
    corpus = stored(placed(own, [w.encode() for w in frequent_words(counts.df)["word"]]))
    model = train(corpus, counts.df, classes)
    rows = stored(classed(corpus, model))
    for table_ in (counts, corpus, model.others):
        table_.drop()
    step = transitions(rows.df, classes)
    n_tokens = model.n_tokens

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch.column(1).to_numpy()
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            of = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            score = batch.column(4).to_numpy() + np.add.reduceat(step[np.concatenate([[classes - 1], of[:-1]]), of], heads)
            parts = [batch.column(0), batch.column(1), batch.column(2), pa.array(np.full(len(sizes), n_tokens), pa.int64()), batch.column(3), pa.array(score), pa.array(10 ** np.minimum(-score / sizes, 300))]
            yield pa.record_batch(parts, names=[c.split()[0] for c in SCORED.split(", ")])

    return rows.df.select("doc_id", "n_tokens", "n_known", "base_score", "emission", "classes").mapInArrow(run, SCORED)


def op10_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents"), f"NOT ({HELD_OUT})")
    return found.withColumn("held_out", F.expr(HELD_OUT)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
