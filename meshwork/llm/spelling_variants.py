"""Spelling variant grouping: deletion keys from rolling hashes find the words that one edit tells apart.

Method. Two words differ by one replaced code point where deleting the same place of both leaves one string, and by
one inserted code point where deleting a place of the longer leaves the shorter. The 64-bit key of every such deletion comes from
prefix sums of a polynomial over code points (the part before the place, and the part after it moved down by one), for all words
of a batch at once. Keys are dealt by their leading bits and sorted; a pass over a sorted partition keeps the keys that meet another.
Only these fetch their word, and the deleted strings themselves, not their hashes, decide: a
collision of keys costs a row and changes nothing. A place inside a run of one letter leaves the same string as the run's first, so
only the first stands for an insertion.

Scale. Texts are read once; a task counts its own words before the shuffle. All that follows grows with the distinct words:
a row of 20 bytes for each code point of a word. What shares a deleted string and its place differs by one letter of the alphabet
of 90 (26 and those of U+00C0 to U+00FF), so no group can grow; near words are counted and the best of them is taken within
groups, pairs of equal length are never listed. A word has at least five times its variant's occurrences, so a chain of forms has
at most 27 steps and is followed by doubling.

Edge cases. A null text has no words; a null doc_id is the empty string before the colon. Repeated rows count each time.
Words of any length take part. Ties of occurrences go to the word that is smallest by code points. Bytes that are not UTF-8 end a
run. An empty table, or one without a word often enough, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BASE, LOWER, U64, Stored, mixed, powers, run_spans, stored, table, text_blocks

LEAST_LENGTH = 6
LEAST_COUNT = 5
#: A word is written as its form where that occurs so many times as often.
FORM_RATIO = 5
#: One in so many occurrences of a run, by its checksum, loses a letter.
TYPO_EVERY = 199
#: Runs of more bytes get their checksum one by one.
LONG_RUN = 64
#: Distinct words that a task holds before it hands their counts on.
HELD_WORDS = 200_000
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to A-Z, a-z or U+00C0 to U+00FF (C3 and a continuation byte)."""
    mark = _LETTER[data]
    if len(data) > 1:
        pair = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] & 0xC0 == 0x80))
        mark[pair] = mark[pair + 1] = True
    return mark


def checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The crc32 of each span, continued from ``before``."""
    state = ~before.astype(np.uint32)
    at = np.flatnonzero(ends - starts <= LONG_RUN)
    done = 0
    while len(at):
        own = state[at]
        state[at] = _CRC[(own ^ data[starts[at] + done]) & 0xFF] ^ (own >> np.uint32(8))
        done += 1
        at = at[ends[at] - starts[at] > done]
    out = ~state
    for k in np.flatnonzero(ends - starts > LONG_RUN).tolist():
        out[k] = zlib.crc32(data[starts[k] : ends[k]].tobytes(), int(before[k]))
    return out


def block_words(data: np.ndarray, offsets: np.ndarray, ids: list[str | None], least: int, typo_every: int | None) -> pa.Array:
    """The words of a block of texts, each as often as it occurs."""
    data = LOWER[data]
    starts, ends, bounds = run_spans(letter_bytes(data), offsets)
    points = np.concatenate([[0], np.cumsum(data & 0xC0 != 0x80)])
    sizes = points[ends] - points[starts]
    text = np.repeat(np.arange(len(ids)), np.diff(bounds))
    long = sizes >= least
    starts, ends, sizes, text = starts[long], ends[long], sizes[long], text[long]
    typos: list[bytes] = []
    if typo_every:
        before = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], dtype=np.uint32)
        h = checksums(data, starts, ends, before[text])
        hit = h % np.uint32(typo_every) == 0
        for k in np.flatnonzero(hit & (sizes > least)).tolist():
            run = data[starts[k] : ends[k]].tobytes().decode()
            at = int(h[k]) % len(run)
            typos.append((run[:at] + run[at + 1 :]).encode())
        starts, ends = starts[~hit], ends[~hit]
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    own = data[np.cumsum(inside[:-1], dtype=np.int8) > 0].tobytes() + b"".join(typos)
    cut = np.concatenate([[0], np.cumsum([*(ends - starts).tolist(), *map(len, typos)])]).astype(np.int32)
    return pa.Array.from_buffers(pa.utf8(), len(cut) - 1, [None, pa.py_buffer(cut), pa.py_buffer(own)])


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, typo_every: int | None = None) -> DataFrame:
    """(word, n): the runs of letters of all texts, A-Z lower-cased, of at least so many code points."""
    schema = pa.schema([("word", pa.utf8()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word").aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["word", "n"])

        for block in text_blocks(batches):
            ids = block.rows.column(block.rows.schema.get_field_index("id")).to_pylist()
            found = pc.value_counts(block_words(block.data, block.offsets, ids, least_length, typo_every))
            held.append(pa.table({"word": found.field(0), "n": found.field(1)}, schema=schema))
            if sum(t.num_rows for t in held) > 2 * HELD_WORDS:
                held[:] = [summed()]
                if held[0].num_rows > HELD_WORDS:
                    yield from held.pop().to_batches()
        if held:
            yield from summed().to_batches()

    own = docs.select(F.col("doc_id").cast("string").alias("id"), "text")
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(key, at, wid, first) of all words (word, wid) of a batch: a key without each place, and the whole word's with at = -1."""
    words = batch.column(0).to_pylist()
    codes = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    up, down = powers(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, dtype=U64)
    np.cumsum(mixed((codes.astype(U64) + U64(1)) * U64(BASE)) * up[: len(codes)], out=sums[1:])
    whole = mixed((sums[ends] - sums[starts]) * down[starts] + sizes.astype(U64))
    word = np.repeat(np.arange(len(words)), sizes)
    at = np.arange(len(codes))
    before = sums[at] - sums[starts[word]]
    after = (sums[ends[word]] - sums[at + 1]) * down[1]
    without = mixed((before + after) * down[starts[word]] + (sizes[word] - 1).astype(U64))
    first = np.ones(len(codes), dtype=bool)
    first[1:] = (codes[1:] != codes[:-1]) | (word[1:] != word[:-1])
    ids = batch.column(1).to_numpy(zero_copy_only=False)
    columns = {
        "key": np.concatenate([whole, without]).view(np.int64),
        "at": np.concatenate([np.full(len(words), -1), at - starts[word]]).astype(np.int32),
        "wid": np.concatenate([ids, ids[word]]),
        "first": np.concatenate([np.zeros(len(words), dtype=bool), first]),
    }
    return pa.record_batch({k: pa.array(v) for k, v in columns.items()})


def meeting(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(wid, at, inserted) of the sorted keys that another word's key equals, or that equal a whole word's."""
    kept = None

    def of(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, at, wid, first = rows
        new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=bool)
        group = np.cumsum(new) - 1
        has_whole = np.zeros(group[-1] + 1 if len(group) else 0, dtype=bool)
        has_whole[group[at < 0]] = True
        like = (key[1:] == key[:-1]) & (at[1:] == at[:-1]) & (at[1:] >= 0)
        same = np.concatenate([[False], like]) | np.concatenate([like, [False]]) if len(key) else new
        longer = first & has_whole[group]
        return pa.record_batch({"wid": pa.array(np.concatenate([wid[same], wid[longer]])), "at": pa.array(np.concatenate([at[same], at[longer]])), "inserted": pa.array(np.repeat([False, True], [same.sum(), longer.sum()]))})

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if kept is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(kept, rows)]
        # a key's rows may go on in the next batch
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        yield of([x[:last] for x in rows])
        kept = [x[last:] for x in rows]
    if kept is not None:
        yield of(kept)


def variant_links(words: DataFrame) -> Stored:
    """(inserted, at, shared, word, n), stored: the words (word, n, wid) that may meet another, each with the string that its deletion leaves."""
    keys = words.select("word", "wid").mapInArrow(lambda batches: map(deletion_keys, batches), "key long, at int, wid long, first boolean")
    dealt = keys.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key", "at")
    found = dealt.mapInArrow(meeting, "wid long, at int, inserted boolean")
    shared = F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)"))
    return stored(found.join(words, "wid").select("inserted", "at", shared.alias("shared"), "word", "n"))


def near_words(words: DataFrame, links: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): how many words are near, and the most frequent of them."""
    group = Window.partitionBy("shared", "at")
    ranks = group.orderBy(F.desc("n"), "word")
    pair = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    whole = ranks.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    replaced = links.filter("NOT inserted").select(
        "word",
        (F.count("*").over(group) - 1).alias("near"),
        F.when(F.row_number().over(ranks) == 1, F.nth_value(pair, 2).over(whole)).otherwise(F.first(pair).over(whole)).alias("best"),
    )
    longer = links.filter("inserted").select("shared", F.col("word").alias("longer"), F.col("n").alias("longer_n")).join(words.select(F.col("word").alias("shared"), "n"), "shared")
    both = F.array(
        F.struct(F.col("longer").alias("word"), F.struct((-F.col("n")).alias("less"), F.col("shared").alias("word")).alias("best")),
        F.struct(F.col("shared").alias("word"), F.struct((-F.col("longer_n")).alias("less"), F.col("longer").alias("word")).alias("best")),
    )
    inserted = longer.select(F.explode(both).alias("x")).select("x.word", F.lit(1).cast("long").alias("near"), "x.best")
    found = replaced.filter("near > 0").union(inserted).groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))


def roots(forms: DataFrame) -> Stored:
    """(word, root), stored, of every word that has a form (word, form): the end of its chain, by doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.df.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = stored(now.df.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now.drop()
        now = Stored(after.df.select("word", "root"), after.path)
        if after.df.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = FORM_RATIO, typo_every: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of at least ``least_count`` occurrences."""
    counted = word_counts(docs, least_length, typo_every).filter(F.col("n") >= least_count)
    words = stored(counted.withColumn("wid", F.monotonically_increasing_id()))
    links = variant_links(words.df)
    near = near_words(words.df, links.df)
    is_form = F.col("best_n") >= ratio * F.col("n")
    found = words.df.select("word", "n").join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n")
    )
    found = stored(found)
    links.drop()
    words.drop()
    ends = roots(found.df.filter("form IS NOT NULL"))
    return found.df.join(ends.df, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), typo_every=TYPO_EVERY)
