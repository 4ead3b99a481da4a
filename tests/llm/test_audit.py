"""Filter audit against its SQL, which walks every order, and hand-made counts."""
import itertools
import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cartograph.llm import audit

COLS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def found(df):
    return sorted(tuple(r) for r in df.select(*COLS).collect())


def by_oracle(docs, labels):
    con = duckdb.connect()
    for name, rows, kinds in (("documents", docs, [("doc_id", pa.int64()), ("text", pa.string()), ("source", pa.string())]),
                              ("labels", labels, [("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])):
        cols = list(zip(*rows)) or [[]] * 3
        con.register(name, pa.table({n: pa.array(c, k) for (n, k), c in zip(kinds, cols)}))
    return sorted(tuple(r) for r in con.execute(f"select {', '.join(COLS)} from ({audit.oracle()})").fetchall())


def frames(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    return (d.withColumns({"part": F.lit(1), "good": F.lit("x"), "failed": F.lit(2), "id": F.lit(3), "n": F.lit(4), "key": F.lit(5)}),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y")))


def corpus(rng):
    kinds = [lambda: " ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 250]))), lambda: " ".join(str(i) for i in range(220)),
             lambda: "ABC " * 210, lambda: "a # b" * rng.choice([1, 200]), lambda: "same text", lambda: "", lambda: None]
    docs = [(rng.choice([i, i // 2]), rng.choice(kinds)(), rng.choice(["web", "", None, "böök"])) for i in range(150)]
    docs += [(None, "same text", "web"), (None, "a text of its own", "web")] * 2 + [(7, "same text", s) for s in ("web", "wiki", "wiki")]
    labels = [(rng.randrange(150), rng.choice([0, 1, None]), rng.choice([0, 1])) for _ in range(120)] + [(None, 1, 1)]
    return docs, labels


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_a_walk_over_every_order(spark, seed):
    docs, labels = corpus(random.Random(seed))
    want = by_oracle(docs, labels)
    assert found(audit.filter_audit(*frames(spark, docs, labels))) == want
    assert len(want) == 600 * len({d[2] or "" for d in docs})


def test_empty_tables(spark):
    d, lab = frames(spark, [], [])
    assert found(audit.filter_audit(d, lab)) == []
    docs = [(1, "x", "only")]
    assert found(audit.filter_audit(*frames(spark, docs, []))) == by_oracle(docs, [])


def test_paths_through_the_lattice(spark):
    """Forward and backward counts against the orders themselves, three filters."""
    edges, steps = audit.lattice(spark, "XYZ")
    paths = {(r.state, r.filter): r.paths for r in edges.collect()}
    walked = {}
    for order in itertools.permutations(range(3)):
        for i, f in enumerate(order):
            s = sum(1 << g for g in order[:i])
            walked[s, f] = walked.get((s, f), 0) + 1
    assert paths == walked
    assert steps.count() == 18


def test_parts_without_some_sets(spark):
    cells = spark.createDataFrame([("p", 3, 5)], "part string, failed int, n long")
    got = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in audit.audit(cells, "AB").collect()}
    assert got == {("AB", 1): (0, 5, 0, 0, 5), ("AB", 2): (0, 0, 5, 0, 5), ("BA", 1): (0, 5, 0, 0, 5), ("BA", 2): (0, 0, 5, 0, 5)}
