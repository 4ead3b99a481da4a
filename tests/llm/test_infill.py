"""Fill-in-the-middle against a plain cut of the texts, and its class matrix
against plain counts."""
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograph.llm import infill

PATTERN = {"lines": r"[^\n]*\n|[^\n]+", "sentences": r"[^\n.?!]*[\n.?!]|[^\n.?!]+"}


def plain(doc, text, unit="lines", seed=7, plain_percent=0, spm_percent=50):
    """(n, form, prefix characters, middle characters, output)."""
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[i:i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 100 - plain_percent:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm_percent:
        return len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts(n, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(["a", " ", "\n", ".", "é", "語", "😀", "!", "?", "\r", "<", "P>", "\x0b", " "])
                    for _ in range(rng.choice([0, 1, 2, 5, 40, 700]))) for _ in range(n)]


EDGE = [None, "", "\n", "\n\n\n", "no end", "end\n", "é\n語", "has <P> in it\nx", "<S>", "a<M>\n", "<\n<P\nS>", "x\n" * 40_000, "ü" * 100_000 + "\n"]


def test_matrix_counts_and_finds_every_class():
    rng = random.Random(1)
    for size in (0, 1, 63, 64, 511, 512, 513, 3000):
        data = np.array([rng.choice(list(b"ab\n.?!\x80\xbf\xc3")) for _ in range(size)], np.uint8)
        m, kinds = infill.ClassMatrix(data), infill.CLASS[data]
        at = np.arange(size + 1)
        for kind in range(6):
            assert m.rank(kind, at).tolist() == [int((kinds[:i] == kind).sum()) for i in at]
            places = np.flatnonzero(kinds == kind)
            if len(places):
                assert m.select(kind, np.arange(len(places))).tolist() == places.tolist()


@pytest.mark.parametrize("unit", ["lines", "sentences"])
def test_equals_a_plain_cut_and_restores(spark, unit):
    rows = [(i, t) for i, t in enumerate(EDGE + texts(300))] + [(5, "é\n語")] * 3 + [(None, "a\nb\nc\n"), (-4, "q\nr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2)})
    got = infill.transform(docs, unit, plain_percent=10, spm_percent=40)
    found = got.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    want = [(d, *plain(d, t, unit, 7, 10, 40), t or "") for d, t in rows]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert {r.form for r in found} == {"plain", "spm", "psm"}


def test_text_ids_and_empty_table(spark):
    docs = spark.createDataFrame([("a-1", "x\ny\nz"), ("", "x\ny"), (None, "x\ny")], "doc_id string, text string")
    found = {r.doc_id: tuple(r)[1:] for r in infill.transform(docs).collect()}
    assert found == {d: plain(d, t) for d, t in (("a-1", "x\ny\nz"), ("", "x\ny"), (None, "x\ny"))}
    assert infill.transform(docs.limit(0)).collect() == []


def test_oracle_on_edge_rows(spark):
    from cartograph.llm.queries import op12_fill_in_middle
    import tempfile
    rows = [(i, t) for i, t in enumerate([t for t in EDGE if t is None or len(t) < 100] + texts(40, 9))]
    path = tempfile.mkdtemp(prefix="cartograph-infill-")
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{path}/documents.parquet")
    got = op12_fill_in_middle(spark, path)
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{path}/documents.parquet/*.parquet'")
    want = con.execute(infill.oracle())
    names = [c[0] for c in want.description]
    assert sorted(map(str, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(str, want.fetchall()))
    assert all(r.restored_sha256 == hashlib.sha256((dict(rows)[r.doc_id] or "").encode()).hexdigest() for r in got.collect())
