import hashlib
import random
import re

from meshwork.llm import pii as op
from tests.llm.helpers import corpus, frame

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[::2] + [sum(divmod(2 * x, 10)) for x in d[1::2]]) % 10 == 0


def brute(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15]
    return sorted(out)


CASES = [
    "", "a@b", "a@b@c.d", "a@b.c.d@e.f", "x.y%z+1-_@a-b.c-d.e.", "@a.b", "1.2.3.4.5.6.7.8", "1.2.3.256 1.2.3.4", "0001.002.3.4", "1.2.3", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1111-", "4111  1111 1111 1111", "4111111111111112", "+1 (555) 123-4567.", "+1", "+12", "+1 2", "+1 ", "++49 30 1234567 89",
    "+1 234 567 890 +44 1234567890", "+123456789012345678", "é@a.b 漢字a@b.cé", "٣٤@a.b ١٢٣.1.2.3", "password=abc123def token = \"1beb58b8af\"", "http://x.y/z?a=1, https://a@b.c/d.", "12 34" * 50,
]


def test_base_kinds_equal_the_patterns():
    r = random.Random(3)
    texts = CASES + ["".join(r.choice("0123456789 .-+@ab()%_é\n") for _ in range(r.randint(0, 80))) for _ in range(4000)]
    texts += ["".join(r.choice("01.+@ -") for _ in range(60)) for _ in range(2000)]
    texts += [" ".join(r.choice(["4111 1111 1111 1111", "1.2.3.4", "+49 30 123456789", "a.b@c.de", "x", "9"]) for _ in range(8)) for _ in range(300)]
    for t in texts:
        assert [s for s in op.find_spans(t) if s[1] < 4] == brute(t), t


def test_added_kinds():
    spans = {(op.KINDS[k], t) for t, k in ((("x password=abc123def y")[a:b], k) for a, k, b in op.find_spans("x password=abc123def y"))}
    assert ("account", "abc123def") in spans
    assert [(op.KINDS[k], a, b) for a, k, b in op.find_spans("see http://x.y/z.")] == [("url", 4, 16)]


def test_table(spark):
    rows = corpus(2) + [(5000, CASES[16] + " " + CASES[3] + " 1.2.3.4"), (5001, "4" * 3_000 + " a@b.cd")]
    df = frame(spark, rows)
    got = {(r.doc_id, tuple((s.start, op.KINDS.index(s.kind), s.end) for s in r.spans if s.kind in op.BASE_KINDS)) for r in op.pii_spans(df).collect()}
    assert got == {(i, tuple(brute(t))) for i, t in rows}
    clean = op.redact(df).collect()
    assert len(clean) == len(rows)
    assert {(r.doc_id, r.text) for r in clean if r.doc_id == 1000} == {(1000, None)}
    assert all(not brute(r.text) for r in clean)
    assert op.redact(df).columns == df.columns


def test_query(spark, tmp_path):
    rows = [(1, "a@b.cd 1.2.3.4"), (2, None), (None, "x")]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op.op6_pii(spark, str(tmp_path)).collect()}
    assert got[1].spans == "email:0:6,ip:7:14" and (got[1].n_email, got[1].n_ip, got[1].n_card) == (1, 1, 0)
    assert got[1].base_sha256 == hashlib.sha256(b"email:0:6,ip:7:14").hexdigest()
    assert got[2].base_sha256 == hashlib.sha256(b"").hexdigest() and got[2].spans == ""
    assert len(got) == 3


def test_a_long_secret_is_masked_to_its_end():
    secret = "0123456789abcdef" * 8
    assert op.masked(f"token={secret} and more") == "token=[account] and more"
