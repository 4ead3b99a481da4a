"""MIL classifier: gradient, plain scores of every text, held-out accuracy,
bounded sample, edge rows."""
import zlib

import numpy as np
from pyspark.sql import functions as F

from cartograph.llm import attention


def test_attention_finds_the_telling_passage():
    rng = np.random.default_rng(2)
    bags, label = [], []
    for i in range(200):
        x = rng.standard_normal((rng.integers(1, 9), attention.WIDTH)).astype(np.float32) * 0.1
        if i % 2:
            x[rng.integers(len(x)), 7] += 3
        bags.append(x)
        label.append(i % 2)
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    m = attention.fit(np.concatenate(bags), starts, np.array(label, np.float32))
    assert ((m.score(np.concatenate(bags), starts) >= 0.5) == np.array(label)).mean() > 0.97


def bags(seed, n=12):
    rng = np.random.default_rng(seed)
    x = [rng.standard_normal((rng.integers(1, 6), attention.WIDTH)).astype(np.float32) for _ in range(n)]
    return np.concatenate(x), np.cumsum([0] + [len(b) for b in x[:-1]]), rng.integers(0, 2, n).astype(np.float32)


def test_fit_follows_the_gradient():
    """One round of Adam moves every weight by the rate against the sign of the
    loss's slope, which is taken here by finite differences in double precision."""
    x, starts, label = bags(4)
    before, after = attention.fit(x, starts, label, rounds=0), attention.fit(x, starts, label, rounds=1)
    z = ((x - before.mean) * before.scale).astype(np.float32).astype(np.float64)
    names = ("w", "v", "u", "a", "c", "b")
    exact = attention.Model(before.mean, before.scale, *[getattr(before, n).astype(np.float64) for n in names])

    def loss():
        s = attention.forward(exact, z, starts)[0]
        penalty = sum((getattr(exact, n) ** 2).sum() for n in names) * attention.DECAY / 2
        return -(label * np.log(s) + (1 - label) * np.log(1 - s)).mean() + penalty

    rng = np.random.default_rng(1)
    for n in names:
        weights = getattr(exact, n)
        for k in rng.integers(0, weights.size, 12):
            old = weights.flat[k]
            weights.flat[k] = old + 1e-6
            up = loss()
            weights.flat[k] = old - 1e-6
            slope = (up - loss()) / 2e-6
            weights.flat[k] = old
            if abs(slope) > 1e-5:
                moved = getattr(after, n).flat[k] - getattr(before, n).flat[k]
                assert abs(moved + attention.RATE * np.sign(slope)) < 1e-3 * attention.RATE + 1e-6, n


def plain_score(m, text):
    """The module's formula, passage by passage in plain Python."""
    h, logits = [], []
    for row in (attention.encode(text) - m.mean) * m.scale:
        h.append(np.tanh(row @ m.w))
        logits.append(float((np.tanh(h[-1] @ m.v) / (1 + np.exp(-(h[-1] @ m.u)))) @ m.a))
    weight = [np.exp(x - max(logits)) for x in logits]
    bag = sum(w * v for w, v in zip(weight, h)) / sum(weight)
    return 1 / (1 + np.exp(-(bag @ m.c + m.b[0])))


def test_query_scores_every_text_by_the_formula(spark):
    """Every row of the query against the plain formula, with the model that the
    query's own labels give."""
    from cartograph.llm.queries import op2_quality_classifier
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label")).where(~attention.held_out(F.col("id")))
    m = attention.train(docs.select(F.col("doc_id").alias("id"), "text"), known)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = op2_quality_classifier(spark, d).collect()
    assert len(got) == len(text)
    assert max(abs(r.score - plain_score(m, text[r.doc_id])) for r in got) < 1e-4


def test_sample_is_bounded_in_rows_and_passages(spark):
    """One id has 20,000 rows, one text 300 passages."""
    rows = [(1, f"text number {i}") for i in range(20_000)] + [(2, "w " * attention.PASSAGE * 300), (2, "w"), (2, "w"), (3, None)]
    docs = spark.createDataFrame(rows, "id long, text string").repartition(4)
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0), (3, 1)], "id long, label int")
    got = attention.sample(docs, labels, 10).collect()
    assert len(got) == 10
    only = attention.sample(docs, labels.where("id > 1"), 10).collect()
    assert sorted((r.id, len(r.x) // (4 * attention.WIDTH)) for r in only) == [(2, 1), (2, attention.MOST_PASSAGES), (3, 1)]


def test_held_out_accuracy(spark):
    from cartograph.llm.queries import op2_quality_classifier
    d = "/root/testdata/sf0.01"
    got = op2_quality_classifier(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert ((got.score >= 0) & (got.score <= 1)).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    test = got[got.held_out & got.quality.notna()]
    assert (test.predicted == test.quality).mean() >= 0.9


def test_labels_of_held_out_rows_are_not_used(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("quality", F.when(attention.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (attention.quality(docs, x).orderBy("doc_id").select("score").collect() for x in (labels, flipped))
    assert a == b


def test_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (None, "text here", "c"), (3, "w " * 50000, "d"), (3, "again", "e"),
                                  (4, "good words here", "f"), (5, "$$$ ### !!!", "g")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (2, None), (None, 1), (77, 0)], "doc_id long, quality int")
    got = attention.quality(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    one, two = (next(r.score for r in got if r.doc_id == i) for i in (1, 2))
    assert one == two
    assert {r.score for r in attention.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert attention.quality(docs.limit(0), labels).count() == 0
