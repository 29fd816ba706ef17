"""Personal data: anchors found by one Aho-Corasick pass, expanded by deterministic local parsers.

Method. An automaton over at-signs, digit pairs, plus-digit pairs, URL schemes and identifier cues
runs once over a text. Each hit is handed to the parser of its kind, which reads outwards from
the anchor to the ends of the candidate, validates it (octets, Luhn, digit counts) and moves a
cursor past it, so a text is read a bounded number of times however many anchors it has.

The kinds ``email``, ``ip``, ``card`` and ``phone`` equal the leftmost non-overlapping matches of
the patterns below, with failing candidates dropped. The anchors add ``url`` (after a scheme) and
``account`` (a value after a cue such as ``password=``); they never change the other four.

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+), octets up to 255
    card   [0-9]([\\x20-]?[0-9])+, 14 to 19 digits that pass Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9], 10 to 15 digits

Scale. One narrow map over whole texts: no shuffle, memory bounded by a block and its longest text.

Edge cases. A null or empty text has no spans; every row gives a row, repeated rows and rows without
doc_id included. Offsets count code points, ends are exclusive. Other columns are ignored by
:func:`pii_spans` and kept by :func:`redact`. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_blocks

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
#: The schemes and cues that the automaton looks for, in lower, title and upper case.
SCHEMES = ("http://", "https://", "ftp://", "ssh://")
CUES = ("password", "passwd", "secret", "token", "api_key", "apikey", "iban", "account", "ssn", "passport")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = "0123456789"
_OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])*")
_PHONE = re.compile(r"[ ().0-9-]*")
_URL = re.compile(r"[^\s<>\"']+")
_VALUE = re.compile(r"\s{0,2}(?:[:=]|\bis\b)\s{0,2}[\"']?([A-Za-z0-9_-]{6,})")

Span = tuple[int, int, int]


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    add = lambda kind, word: found.add_word(word, (kind, len(word)))
    add("email", "@")
    for a in _DIGITS:
        add("phone", f"+{a}")
        for b in _DIGITS:
            add("ip", f"{a}.{b}")
            for between in ("", " ", "-"):
                add("card", f"{a}{between}{b}")
    for word in SCHEMES:
        for form in {word, word.title(), word.upper()}:
            add("url", form)
    for word in CUES:
        for form in {word, word.title(), word.upper()}:
            add("account", form)
    found.make_automaton()
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def find_spans(text: str) -> list[Span]:
    """(start, kind as an index of KINDS, end), by start and then kind."""
    out: list[Span] = []
    email_end = ip_end = card_end = phone_end = url_end = account_end = 0
    for last, (kind, length) in _automaton().iter(text):
        at = last - length + 1
        if kind == "card":
            if at < card_end:
                continue
            # everything before this hit that could join the run would itself have been a hit
            end = card_end = _CARD.match(text, at).end()
            digits = text[at:end].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out.append((at, 2, end))
        elif kind == "ip":
            if at < ip_end:
                continue
            start = at
            while start > ip_end and text[start - 1] in _DIGITS:
                start -= 1
            ip_end = _OCTETS.match(text, start).end()
            parts = text[start:ip_end].split(".")
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(map(_octet, four)):
                    out.append((start, 1, end))
                start = end + 1
        elif kind == "email":
            start = at
            while start > email_end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                email_end = m.end()
                out.append((start, 0, email_end))
        elif kind == "phone":
            if at < phone_end:
                continue
            end = _PHONE.match(text, at + 2).end()
            while end > at + 3 and text[end - 1] not in _DIGITS:
                end -= 1
            if end > at + 3:
                phone_end = end
                if 10 <= sum(c in _DIGITS for c in text[at:end]) <= 15:
                    out.append((at, 3, end))
        elif kind == "url":
            if at >= url_end and (m := _URL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]}"))
                if end > last + 1:
                    url_end = end
                    out.append((at, 4, end))
        elif at >= account_end and (m := _VALUE.match(text, last + 1)) and any(c in _DIGITS for c in m[1]):
            account_end = m.end(1)
            out.append((m.start(1), 5, account_end))
    out.sort()
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))


def _texts(block) -> list[str]:
    return [x or "" for x in block.rows.column(block.rows.schema.get_field_index("text")).to_pylist()]


def pii_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every span with its kind, code point range and text, by start and then kind."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            spans = [[{"kind": KINDS[k], "start": a, "end": b, "value": t[a:b]} for a, k, b in find_spans(t)] for t in _texts(block)]
            yield pa.record_batch([block.rows.column(0), pa.array(spans, SPANS)], names=["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,value:string>>")


def masked(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans make one."""
    parts, at = [], 0
    for start, kind, end in find_spans(text):
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs``, all columns kept, with personal data in ``text`` masked; null texts stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            texts = [None if x is None else masked(x) for x in block.rows.column(at).to_pylist()]
            yield block.rows.set_column(at, block.rows.schema.field(at), pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of the spans of every document, by the operator's parser."""
    names = ["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"]
    types = [pa.int64()] * 5 + [pa.string()] * 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches):
            columns: list[list] = [[] for _ in names[1:]]
            for text in _texts(block):
                spans = find_spans(text)
                kinds = [k for _, k, _ in spans]
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                base = ",".join(s for s, k in zip(said, kinds) if k < len(BASE_KINDS))
                for column, value in zip(columns, (*map(kinds.count, range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(said))):
                    column.append(value)
            yield pa.record_batch([block.rows.column(0), *(pa.array(x, t) for x, t in zip(columns, types[1:]))], names=names)

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
