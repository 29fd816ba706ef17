"""Cross-tokenizer alignment: where the tokens of two tokenizers end together in a text.

Method. A text's tokens are byte ranges. ``np.union1d`` of both tokenizers' ends cuts it into elementary intervals, and
``np.searchsorted`` finds each interval's owner on either side: every interval is one overlap of a token of A and a token of B. Ends
that both have close a group; a group's tokens, product-wise, are the pairs that it may be read as. :class:`Alignment` has all three
(``overlaps``, ``groups``, ``products``), and the pairs whose ranges end together (``ends``), which the query counts.

A (byte-level BPE) encodes a space and the text, B (sentencepiece BPE) the text, before which it puts a space itself. Neither merges
across a single space between two characters that are no white space, so texts are cut there and the distinct pieces of a block are
encoded and aligned once; a text's tokens are its pieces' tokens. Where B's model has a piece that could cross such a cut, texts stay whole.

Scale. Texts are read once, in one narrow map that stores each one's links as numbers of id pairs. Two tokens that end together hold
one another as a suffix, so the pairs that can be linked are listed from the two vocabularies: their number is
below the vocabularies' bytes whatever the corpus (``MAX_PAIRS`` is checked). Counts are therefore summed in a task and
gathered as one row for each pair and task, and the table of counts that goes back to the texts is of bounded size. No text is ever shuffled.

Edge cases. Texts that are null, empty, not UTF-8, or whose bytes either tokenizer changes have no tokens: zeros, and an empty digest.
Strings of special tokens in a text are plain text. Every row gives a row; repeated rows and rows without doc_id count
each. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, Block, batches_of, stored, table, text_blocks
from .token_counts import PATTERN

FOLDER = os.environ.get("MESHWORK_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = f"{FOLDER}/byte_bpe_50k.json"
MODEL = f"{FOLDER}/piece_bpe_32k.model"
MAX_FILE_BYTES = 16 << 20
#: Pairs of ids that can be linked, at most; two public vocabularies have a few hundred thousand.
MAX_PAIRS = 4_000_000
#: Bytes of texts whose distinct pieces are encoded together.
BLOCK_BYTES = 2 << 20
#: Texts of an Arrow batch.
TEXTS_A_BATCH = 1_000
LINKS = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links array<int>"
_UNSURE_BEFORE = np.zeros(256, dtype=bool)
_UNSURE_BEFORE[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF, *range(0x1C, 0x20)]] = True
_UNSURE_BEFORE |= SPACE
_UNSURE_AFTER = np.zeros(256, dtype=bool)
_UNSURE_AFTER[[0xC2, 0xE1, 0xE2, 0xE3, *range(0x1C, 0x20)]] = True
_UNSURE_AFTER |= SPACE
_LOADED: dict[tuple, Tokenizers] = {}


def byte_letters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class Files(NamedTuple):
    vocabulary: bytes
    model: bytes


def read_files(vocabulary: str = VOCABULARY, model: str = MODEL) -> Files:
    out = []
    for path in (vocabulary, model):
        if os.path.getsize(path) > MAX_FILE_BYTES:
            raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
        with open(path, "rb") as f:
            out.append(f.read())
    return Files(*out)


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens."""

    def __init__(self, files: Files) -> None:
        import sentencepiece
        import tiktoken

        letters = byte_letters()
        own = json.loads(files.vocabulary)
        special = {x["content"] for x in own["added_tokens"]}
        ranks = {bytes(letters[c] for c in piece): i for piece, i in own["model"]["vocab"].items() if piece not in special}
        self.a = tiktoken.Encoding("alignment", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=files.model)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.a_bytes[i] = piece
        self.b_bytes = []
        self.cuts = True
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.cuts &= re.search("[^▁]▁", piece) is None
            self.b_bytes.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else piece.replace("▁", " ").encode())
        self.a_size = np.array(list(map(len, self.a_bytes)), dtype=np.int64)
        self.b_size = np.array(list(map(len, self.b_bytes)), dtype=np.int64)
        self.a_text = np.array([str(i) for i in range(len(self.a_bytes))], dtype=object)
        self.b_text = np.array([str(i) for i in range(len(self.b_bytes))], dtype=object)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids of all pieces and how many each has, and B's. Pieces begin with a space, which B puts there itself."""
        strings = [p.decode("utf-8", "replace") for p in pieces]
        b = self.b.encode([x[1:] for x in strings], num_threads=1)
        n_b = np.fromiter(map(len, b), dtype=np.int64, count=len(b))
        # pieces that may stand between any others are encoded together: a call for each costs more than the encoding
        sizes = np.array(list(map(len, pieces)), dtype=np.int64)
        plain = np.array([len(p) > 1 and not _UNSURE_BEFORE[p[-1]] and not _UNSURE_AFTER[p[1]] for p in pieces], dtype=bool) & self.cuts
        n_a, parts = np.zeros(len(pieces), dtype=np.int64), {}
        at = np.flatnonzero(plain)
        together = np.array(self.a.encode_ordinary("".join([strings[k] for k in at.tolist()])), dtype=np.int64)
        ends = np.searchsorted(np.cumsum(self.a_size[together]), np.cumsum(sizes[at]), "right")
        n_a[at] = np.diff(ends, prepend=0)
        if len(at) and (len(together) != ends[-1] or np.any(np.cumsum(self.a_size[together])[ends - 1] != np.cumsum(sizes[at]))):
            plain[:] = False  # bytes that are not UTF-8
        for k in np.flatnonzero(~plain).tolist():
            parts[k] = np.array(self.a.encode_ordinary(strings[k]), dtype=np.int64)
            n_a[k] = len(parts[k])
        a = np.empty(int(n_a.sum()), dtype=np.int64)
        own = np.repeat(plain, n_a)
        a[own] = together[: own.sum()]
        starts = np.cumsum(n_a) - n_a
        for k, ids in parts.items():
            a[starts[k] : starts[k] + len(ids)] = ids
        return a, n_a, np.fromiter((i for x in b for i in x), dtype=np.int64, count=int(n_b.sum())), n_b


def tokenizers(files: Files) -> Tokenizers:
    """Made once in each Python worker."""
    key = tuple(map(hash, files))
    if key not in _LOADED:
        _LOADED[key] = Tokenizers(files)
    return _LOADED[key]


def linkable(own: Tokenizers) -> np.ndarray:
    """All (a << 32) + b, sorted, of tokens of which one is a suffix of the other: no others can end together."""
    a_of, b_of = defaultdict(list), defaultdict(list)
    for i, x in enumerate(own.a_bytes):
        a_of[x].append(i)
    for i, x in enumerate(own.b_bytes):
        b_of[x].append(i)
    pairs = [(i << 32) + k for i, x in enumerate(own.a_bytes) for at in range(len(x)) for k in b_of.get(x[at:], ())]
    pairs += [(i << 32) + k for k, x in enumerate(own.b_bytes) for at in range(1, len(x)) for i in a_of.get(x[at:], ())]
    if len(pairs) > MAX_PAIRS:
        raise ValueError(f"{len(pairs)} pairs of tokens can end together, more than {MAX_PAIRS}")
    return np.sort(np.array(pairs, dtype=np.int64))


class Alignment(NamedTuple):
    """Two tokenizations of the same bytes: token ids and ends on either side, and the owners of the elementary intervals."""

    a: np.ndarray
    b: np.ndarray
    a_ends: np.ndarray
    b_ends: np.ndarray
    cuts: np.ndarray  # the intervals' ends
    a_at: np.ndarray  # the token of A, and of B, that an interval lies in
    b_at: np.ndarray

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> Alignment:
        cuts = np.union1d(a_ends, b_ends)
        return cls(a, b, a_ends, b_ends, cuts, np.searchsorted(a_ends, cuts), np.searchsorted(b_ends, cuts))

    def overlaps(self) -> np.ndarray:
        """(token of A, token of B, end) of each interval."""
        return np.column_stack([self.a_at, self.b_at, self.cuts])

    def closing(self) -> np.ndarray:
        """The intervals that close a group: both tokens end there."""
        return np.flatnonzero((self.a_ends[self.a_at] == self.cuts) & (self.b_ends[self.b_at] == self.cuts))

    def ends(self) -> np.ndarray:
        """(token of A, token of B) of all pairs whose ranges end together, one for each group."""
        at = self.closing()
        return np.column_stack([self.a_at[at], self.b_at[at]])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """For each token of A, and of B, the number of its group."""
        last = self.cuts[self.closing()]
        return np.searchsorted(last, self.a_ends), np.searchsorted(last, self.b_ends)

    def products(self) -> Iterator[tuple[int, int]]:
        """(token of A, token of B) of all pairs inside a group, one by one."""
        a_last, b_last = -1, -1
        for a_to, b_to in self.ends().tolist():
            yield from ((i, k) for i in range(a_last + 1, a_to + 1) for k in range(b_last + 1, b_to + 1))
            a_last, b_last = a_to, b_to


class Pieces(NamedTuple):
    """The distinct pieces of a block; where is a piece's part of the flat arrays."""

    same: np.ndarray  # whether both tokenizers give the piece's bytes
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    links: np.ndarray  # pairs (a << 32) + b
    link_at: np.ndarray
    text: list[str]  # the groups as text


def _given(pieces: list[bytes], token_bytes: list[bytes], ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Whether each piece's tokens have its bytes."""
    tokens = [token_bytes[i] for i in ids.tolist()]
    sizes = np.array(list(map(len, pieces)), dtype=np.int64)
    ends = np.concatenate([[0], np.cumsum(list(map(len, tokens)))]).astype(np.int64)[np.cumsum(n)]
    if np.array_equal(ends, np.cumsum(sizes)) and b"".join(tokens) == b"".join(pieces):
        return np.ones(len(pieces), dtype=bool)
    bounds = np.concatenate([[0], np.cumsum(n)]).tolist()
    return np.array([b"".join(tokens[i:k]) == p for p, i, k in zip(pieces, bounds, bounds[1:])], dtype=bool)


def aligned(own: Tokenizers, pieces: list[bytes]) -> Pieces:
    a, n_a, b, n_b = own.encode(pieces)
    same = _given(pieces, own.a_bytes, a, n_a) & _given(pieces, own.b_bytes, b, n_b)
    a, b, n_a, n_b = a[np.repeat(same, n_a)], b[np.repeat(same, n_b)], np.where(same, n_a, 0), np.where(same, n_b, 0)
    # the pieces stand one after the other, so every piece's end is shared
    found = Alignment.of(a, b, np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b]))
    pairs = found.ends()
    piece = np.repeat(np.arange(len(pieces)), n_a)[pairs[:, 0]]
    n_groups = np.bincount(piece, minlength=len(pieces))
    return Pieces(same, n_a, n_b, n_groups, (a[pairs[:, 0]] << 32) + b[pairs[:, 1]], np.concatenate([[0], np.cumsum(n_groups)]), _rendered(own, found, n_groups))


def _rendered(own: Tokenizers, found: Alignment, n_groups: np.ndarray) -> list[str]:
    """a1,a2|b1;a3|b2,b3 for each piece."""
    a_last, b_last = found.ends().T
    a_group, b_group = found.groups()
    a_text, b_text = own.a_text[found.a] + ",", own.b_text[found.b] + ","
    a_text[a_last], b_text[b_last] = own.a_text[found.a[a_last]] + "|", own.b_text[found.b[b_last]] + ";"
    # a group's tokens of A stand before its tokens of B
    out = np.empty(len(a_text) + len(b_text), dtype=object)
    out[np.arange(len(a_text)) + np.concatenate([[0], b_last + 1])[a_group]] = a_text
    at = np.arange(len(b_text)) + (a_last + 1)[b_group]
    out[at] = b_text
    ends = np.cumsum(np.fromiter(map(len, out), dtype=np.int64, count=len(out)))
    whole = "".join(out.tolist())
    cuts = np.concatenate([[0], ends[at[b_last]]])[np.concatenate([[0], np.cumsum(n_groups)])].tolist()
    return [whole[i : max(i, k - 1)] for i, k in zip(cuts, cuts[1:])]


def piece_bounds(block: Block, cuts: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The block's texts with a space before each, the starts of their pieces and one end, and for each text its first piece."""
    n = len(block.offsets) - 1
    data = np.insert(block.data, block.offsets[:-1], 0x20)
    offsets = block.offsets + np.arange(n + 1)
    start = np.zeros(len(data) + 1, dtype=bool)
    if cuts and len(data) > 2:
        start[1:-2] = (data[1:-1] == 0x20) & ~_UNSURE_BEFORE[data[:-2]] & ~_UNSURE_AFTER[data[2:]]
    start[offsets] = True
    at = np.flatnonzero(start)
    return data, at, np.searchsorted(at, offsets)


def linked(docs: DataFrame, files: Files) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, groups_sha256, links) of every row; links are places in :func:`linkable`."""
    context = docs.sparkSession.sparkContext
    sent, pairs = context.broadcast(files), context.broadcast(linkable(tokenizers(files)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(sent.value)
        for block in text_blocks(batches, max_bytes=BLOCK_BYTES):
            yield _aligned_block(own, pairs.value, block)

    return docs.select("doc_id", "text").mapInArrow(run, LINKS)


def _aligned_block(own: Tokenizers, pairs: np.ndarray, block: Block) -> pa.RecordBatch:
    data, at, first = piece_bounds(block, own.cuts)
    every = pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    which = every.indices.to_numpy()
    found = aligned(own, every.dictionary.to_pylist())
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    ok = (np.bincount(text, ~found.same[which], minlength=n) == 0) & (np.diff(block.offsets) > 0)
    total = lambda x: np.where(ok, np.bincount(text, x[which], minlength=n), 0).astype(np.int64)
    used = which[ok[text]]
    sizes = found.n_groups[used]
    take = np.repeat(found.link_at[used] - np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(used) else sizes, sizes) + np.arange(sizes.sum())
    links = np.searchsorted(pairs, found.links).astype(np.int32)[take]
    groups = total(found.n_groups)
    digests = []
    for k, (low, high) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        digests.append(hashlib.sha256(";".join([found.text[p] for p in which[low:high].tolist()]).encode()).hexdigest() if ok[k] else "")
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(groups)]).astype(np.int32)), pa.array(links))
    columns = [block.rows.column(0), pa.array(total(found.n_a)), pa.array(total(found.n_b)), pa.array(groups), pa.array(digests, pa.string()), lists]
    return pa.record_batch(columns, names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links"])


def pair_counts(links: DataFrame, n_pairs: int) -> DataFrame:
    """(pair, n): how many links of the corpus hold each pair of ids linked; a task sums its own first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(n_pairs, dtype=np.int64)
        for batch in batches:
            own = batch.column(0).flatten().to_numpy()
            if len(own):
                counts += np.bincount(own, minlength=n_pairs)
        at = np.flatnonzero(counts)
        yield pa.record_batch({"pair": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})

    return links.select("links").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def best_pairs(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Which pairs have the greatest count of their id of B."""
    b = pairs & ((1 << 32) - 1)
    most = np.zeros(int(b.max(initial=0)) + 1, dtype=np.int64)
    np.maximum.at(most, b, counts)
    return counts == most[b]


def alignment_scores(docs: DataFrame, files: Files | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    context = docs.sparkSession.sparkContext
    files = files or read_files()
    pairs = linkable(tokenizers(files))
    with batches_of(docs.sparkSession, TEXTS_A_BATCH):
        links = stored(linked(docs, files)).df
    counts = np.zeros(len(pairs), dtype=np.int64)
    for r in pair_counts(links, len(pairs)).collect():
        counts[r["pair"]] = r["n"]
    sent = context.broadcast((counts, best_pairs(pairs, counts)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, best = sent.value
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index("links"))
            own = lists.flatten().to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            totals = [np.concatenate([[0], np.cumsum(x[own], dtype=np.int64)])[np.concatenate([[0], ends])] for x in (best, count)]
            out = {name: batch.column(batch.schema.get_field_index(name)) for name in ("doc_id", "n_a", "n_b", "n_groups", "groups_sha256")}
            out |= {"n_links": pc.cast(lists.value_lengths(), pa.int64()), "n_best": pa.array(np.diff(totals[0])), "count_sum": pa.array(np.diff(totals[1]))}
            yield pa.record_batch(out)

    scored = links.mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, n_links long, n_best long, count_sum long")
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def token_spans(docs: DataFrame, kind: str = "overlaps", files: Files | None = None) -> DataFrame:
    """(doc_id, a_id, b_id, a_end, b_end): the aligned token occurrences of every text, with their ends in the space and the text.

    ``kind`` is overlaps (every interval), ends (ranges that end together) or products (all pairs inside a group).
    """
    if kind not in ("overlaps", "ends", "products"):
        raise ValueError(f"Unknown kind of alignment: {kind}")
    sent = docs.sparkSession.sparkContext.broadcast(files or read_files())
    names = ["doc_id", "a_id", "b_id", "a_end", "b_end"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(sent.value)
        for block in text_blocks(batches):
            ids = block.rows.column(0).to_pylist()
            for k, doc_id in enumerate(ids):
                found = align_text(own, block.text(k))
                if found is None:
                    continue
                pairs = found.overlaps()[:, :2] if kind == "overlaps" else found.ends() if kind == "ends" else np.array(list(found.products()))
                a, b = pairs[:, 0], pairs[:, 1]
                yield pa.record_batch([pa.array([doc_id] * len(a), pa.int64()), *map(pa.array, (found.a[a], found.b[b], found.a_ends[a], found.b_ends[b]))], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(f"{x} long" for x in names))


def align_text(own: Tokenizers, text: bytes) -> Alignment | None:
    """A whole text's alignment; None where it has no tokens."""
    if not text:
        return None
    whole = [b" " + text]
    a, n_a, b, n_b = own.encode(whole)
    if not (_given(whole, own.a_bytes, a, n_a) & _given(whole, own.b_bytes, b, n_b))[0]:
        return None
    return Alignment.of(a, b, np.cumsum(own.a_size[a]), np.cumsum(own.b_size[b]))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_scores(table(spark, sf_dir, "documents"))
