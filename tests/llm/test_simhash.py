"""SimHash near-dedup against brute force."""
import itertools
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from cartograph.llm import simhash
from cartograph.llm.common import Scratch, components


def plain_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", (text or "").translate(
        {c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return 0
    sh = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def classes(ids_fps):
    """id -> smallest id reachable, by brute force."""
    by, first = {}, {}
    for i, f in ids_fps:
        first[f] = min(first.get(f, i), i)
    fps = list(first)
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            root[find(a)] = find(b)
    for f in fps:
        by[find(f)] = min(by.get(find(f), first[f]), first[f])
    return {f: by[find(f)] for f in fps}


def unsigned(v):
    return v & 0xFFFFFFFFFFFFFFFF


def test_fingerprint_matches_definition():
    rng = random.Random(3)
    texts = ["", None, "  \n\t ", "One", "one TWO", "ÀB c\x0bd", "a b c d", "x " * 500,
             " ".join(rng.choice(["Ab", "cd", "éÉ", "f\n"]) for _ in range(70000))]
    for t in texts:
        got = simhash.fingerprint(t.encode() if t is not None else None)
        assert unsigned(got) == plain_fp(t)


def test_query_matches_brute_force(spark):
    from cartograph.llm.queries import op3_simhash
    got = {r.doc_id: r for r in op3_simhash(spark, "/root/testdata/sf0.01").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = [(d.doc_id, plain_fp(d.text)) for d in docs]
    label = classes(want)
    assert len(got) == len(docs)
    for i, f in want:
        assert got[i].fingerprint == f"{f:016x}"
        assert got[i].component_id == label[f]


@pytest.mark.parametrize("most", [1024, 16])
def test_links_connect_as_all_pairs_do(spark, most):
    rng = random.Random(7)
    fps = {0, 1, (1 << 63) - 1, -1, -2}
    for _ in range(6):  # dense clouds around a few centres, far past one bucket
        c = rng.getrandbits(64) - (1 << 63)
        for _ in range(25):
            f = c
            for b in rng.sample(range(64), rng.randint(0, 4)):
                f ^= (1 << b) if b < 63 else -(1 << 63)
            fps.add(f)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    scratch = Scratch(spark, "t")
    label = {r.node: r.label for r in components(simhash.links(df, scratch, most=most), scratch).collect()}
    want = classes([(f, unsigned(f)) for f in fps])
    mine, theirs = {}, {}
    for f in fps:
        mine.setdefault(label.get(f, f), set()).add(f)
        theirs.setdefault(want[unsigned(f)], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_edge_rows(spark):
    rows = [(5, "", "a"), (3, None, "b"), (None, " ", "c"), (8, "same words here now", "d"), (7, "Same WORDS here now", "e"),
            (7, "same words here now", "f"), (None, "only null ids here again", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in simhash.groups(df).collect()), key=str)
    assert [(i, c) for i, f, c in got if f == 0] == sorted([(5, 3), (3, 3), (None, 3)], key=str)
    assert sorted(c for i, f, c in got if i in (7, 8)) == [7, 7, 7]
    assert [(i, c) for i, f, c in got if c is None] == [(None, None)]
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    got = sorted(((r.doc_id, r.fp) for r in kept.collect()), key=str)
    assert len(got) == 3 and (3, "b") in got and (None, "g") in got
    assert simhash.groups(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_components_long_chain(spark):
    df = spark.range(1, 40).select(F.col("id").alias("a"), (F.col("id") - 1).alias("b"))
    got = components(df, Scratch(spark, "t")).collect()
    assert {r.node: r.label for r in got} == {i: 0 for i in range(1, 40)}
