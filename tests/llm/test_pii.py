"""PII spans against the patterns as the contract states them."""
import random
import re

import pytest

from cartograph.llm import pii

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        v = int(c) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def plain(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub("[^0-9]", "", m.group())
            ok = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in s.split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and plain_luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_base_spans_match_patterns(seed):
    rng = random.Random(seed)
    for _ in range(6000):
        t = "".join(rng.choice(["a", "@", ".", "-", "1", "2", "25", "0", "+", " ", "(", ")", "é", "%", "4111111111111111",
                                "b@c.de", "1.2.3.4", "+1 (017) 555-7713"]) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(t) == plain(t), t


def test_documents_match_patterns(spark):
    from cartograph.llm.queries import op9_pii
    import hashlib
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op9_pii(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain(d.text or ""), got[d.doc_id]
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in base)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[0] == k for b in base) for k in PATTERNS]
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))


def test_added_kinds_and_context():
    kinds = lambda t: [k for k, *_ in pii.spans(t)[1]]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 TODAY") == ["iban"]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 today") == []
    assert kinds("his ssn is 219-09-9999") == ["ssn"] and kinds("part 219-09-9999") == []
    assert kinds("call 555-123-4567 now") == ["national"] and kinds("lot 555-123-4567") == []
    assert kinds("call +1 (017) 555-7713") == ["phone"]


def test_long_runs_are_linear():
    for t in ("1" * 300_000, "a" * 300_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "a." * 100_000 + "@"):
        pii.spans(t)


def test_edge_rows_and_redaction(spark):
    rows = [(1, None, 0, "a"), (2, "", 0, "b"), (None, "x@y.zz and é 1.2.3.4", 5, "c"), (2, "no data", 7, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, spans string")
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.spans) for r in pii.scan(df).collect()), key=str)
    assert got == sorted([(1, 0, 0, ""), (2, 0, 0, ""), (2, 0, 0, ""), (None, 1, 1, "email:0:6,ip:13:20")], key=str)
    out = pii.redact(df)
    assert out.columns == df.columns
    assert sorted(out.collect(), key=str) == sorted([(1, None, 0, "a"), (2, "", 0, "b"), (2, "no data", 7, "d"),
                                                     (None, "<EMAIL> and é <IP>", 18, "c")], key=str)
    assert pii.scan(df.limit(0)).count() == 0
