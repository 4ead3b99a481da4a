"""Personal data: patterns propose spans, checksums confirm them, context words
adjust their score.

Four kinds are always kept once confirmed: ``email``, ``ip``, ``card`` and
``phone``. Further kinds start from a score of their own, to which words near
the span add or from which they take: ``iban`` (mod-97), ``ssn`` and
``national`` (a telephone number without country code). Those are kept from a
score of ``LEAST_SCORE``, unless they overlap a span kept before.

Offsets are code points, the end exclusive. Each text is scanned once per
pattern, in time linear in its length.
"""

from __future__ import annotations

import bisect
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "national")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# no digit before: a start inside a run of digits would fail as the run's first does
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}([\x20-])(?!00)[0-9]{2}\1(?!0000)[0-9]{4}(?![0-9-])")
NATIONAL = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])")

LEAST_SCORE = 0.5
#: Characters on either side of a span that are searched for context words.
NEAR = 40
#: kind -> (score without context, words that add 0.3, words that take 0.3)
CONTEXT = {
    "iban": (0.9, re.compile(r"\b(?:iban|account|konto|compte|cuenta|bank|bic|swift)\b", re.I),
             re.compile(r"\b(?:sample|dummy|checksum|serial)\b", re.I)),
    "ssn": (0.3, re.compile(r"\b(?:ssn|social security|taxpayer|tax id|sozialversicherung)\b", re.I),
            re.compile(r"\b(?:part|order|invoice|isbn|version|serial)\b", re.I)),
    "national": (0.3, re.compile(r"\b(?:phone|call|tel|telephone|telefon|tél|teléfono|mobile|fax|contact|dial)\b", re.I),
                 re.compile(r"\b(?:part|order|invoice|isbn|version|serial)\b", re.I)),
}


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    """Sum of digits, every second one from the right doubled, is a multiple of 10."""
    odd = sum(map(int, number[::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in number[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str):
    """Matches of local part, @ and dotted domain, found from the @ signs: the
    local part is the run before one, cut at the end of the match before."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)  # nothing before this sign can belong to a later match
        at = text.find("@", max(done, at + 1))


def confirmed(kind: str, s: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))
    if kind == "card":
        d = digits(s)
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(digits(s)) <= 15


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Confirmed spans of the four base kinds, by kind and start."""
    found = [("email", *span) for span in emails(text)] if "@" in text else []
    for kind, pattern in (("ip", IP), ("card", CARD), ("phone", PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if confirmed(kind, m.group())]
    return found


def score(kind: str, text: str, start: int, end: int) -> float:
    value, up, down = CONTEXT[kind]
    near = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    return value + 0.3 * bool(up.search(near)) - 0.3 * bool(down.search(near))


def iban_end(text: str, start: int, end: int) -> int | None:
    """End of the longest confirmed account number that starts the match, cut
    at a space (upper-case words may follow a number)."""
    while len(text[start:end].replace(" ", "")) >= 15:
        if mod97(text[start:end]):
            return end
        end = text.rfind(" ", start, end)
    return None


def spans(text: str) -> tuple[list[tuple], list[tuple]]:
    """The base spans, and all spans that are kept."""
    base = base_spans(text)
    kept, taken = list(base), merged([x[1:] for x in base])
    for kind, pattern in (("iban", IBAN), ("ssn", SSN), ("national", NATIONAL)):
        new = []
        for m in pattern.finditer(text):
            s, e = m.start(), iban_end(text, *m.span()) if kind == "iban" else m.end()
            if e and score(kind, text, s, e) >= LEAST_SCORE and not overlaps(taken, s, e):
                new.append((kind, s, e))
        kept += new
        taken = merged(taken + [x[1:] for x in new]) if new else taken
    return base, kept


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def overlaps(ranges: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether (start, end) meets one of the ordered, separate ranges."""
    i = bisect.bisect_left(ranges, (start, start))
    return (i < len(ranges) and ranges[i][0] < end) or (i > 0 and ranges[i - 1][1] > start)


def joined(found: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def redacted(text: str) -> str:
    """``text`` with every span replaced by its kind; a span inside another,
    or overlapping it, goes with the one that starts first."""
    out, at = [], 0
    for kind, s, e in sorted(spans(text)[1], key=lambda x: (x[1], -x[2], KINDS.index(x[0]))):
        if s >= at:
            out += [text[at:s], f"<{kind.upper()}>"]
        at = max(at, e)
    return "".join(out) + text[at:]


SPANS = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"


def spans_column(text: Column) -> Column:
    @F.arrow_udf(SPANS)
    def find(raw: pa.Array) -> pa.Array:
        rows = []
        for t in raw:
            base, kept = spans(t.as_py() or "")
            n = {k: sum(b[0] == k for b in base) for k in BASE}
            rows.append({f"n_{k}": n[k] for k in BASE} | {
                "base_sha256": hashlib.sha256(joined(base).encode()).hexdigest(), "spans": joined(kept)})
        kinds = [(f"n_{k}", pa.int64()) for k in BASE] + [("base_sha256", pa.string()), ("spans", pa.string())]
        return pa.array(rows, pa.struct(kinds))
    return find(text)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(<id>, n_email, n_ip, n_card, n_phone,
    base_sha256, spans)``: counts and hash of the base spans, and all spans as
    ``kind:start:end``, joined by commas, by kind and then start. A null text
    counts as empty. Null ids and repeated rows are rows like any other; an
    empty table gives no rows. Other columns are not read."""
    x = docs.select(F.col(id_col).alias("id"), spans_column(F.col(text_col)).alias("s"))
    return x.select(F.col("id").alias(id_col), "s.*")


def redact(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data in the text replaced by ``<KIND>``; null
    stays null. ``chars_col``, if the table has it, becomes the new length."""
    @F.arrow_udf("string")
    def clean(raw: pa.Array) -> pa.Array:
        return pa.array([None if t.as_py() is None else redacted(t.as_py()) for t in raw], pa.string())
    out = docs.withColumn(text_col, clean(F.col(text_col)))
    if chars_col and chars_col in docs.columns:
        kind = docs.schema[chars_col].dataType
        out = out.withColumn(chars_col, F.coalesce(F.length(text_col).cast(kind), F.col(chars_col)))
    return out.select(*docs.columns)


