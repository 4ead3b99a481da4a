"""Nearest neighbours against all distances, and the parts of the search."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cartograph.llm import neighbours

NO = [None, [0.0] * 4, [1.0, None, 1.0, 1.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], []]


def brute(rows, k=10, every=100):
    """{(query_id, its vector): [(vec_id, score)]} over different (id, vector)."""
    good = sorted({(i, tuple(v)) for i, v in rows
                   if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            others = [(math.sqrt(float(np.sum((np.array(w) - np.array(v)) ** 2))), j) for j, w in good if (j, w) != (i, v) and len(w) == len(v)]
            out[i, v] = [(j, d) for d, j in sorted(others)[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def as_rows(x, first=0):
    return [(first + i, v) for i, v in enumerate(x.tolist())]


def run(spark, rows, kind="double", **kw):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "cid", "cell", "rank", "dist")})
    return neighbours.nearest(df, **kw)


def clusters(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 50, dim))[rng.integers(0, n // 50, n)] + spread * rng.standard_normal((n, dim))


@pytest.mark.parametrize("spread", [0.1, 5.0])
def test_recall_and_exact_scores_over_many_blocks(spread, spark):
    rows = as_rows(clusters(3000, 24, 5, spread))
    want = {i: w for (i, _), w in brute(rows, every=20).items()}
    got = found(run(spark, rows, every=20, most=200))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    dist = {(i, j): d for i, w in want.items() for j, d in w}
    hits = sum((i, j) in dist for i, g in got.items() for j, _ in g)
    assert hits >= 0.97 * len(dist)
    assert all(abs(d - dist[i, j]) < 1e-12 for i, g in got.items() for j, d in g if (i, j) in dist)
    assert all(g == sorted(g, key=lambda x: (x[1], x[0])) for g in got.values())


def test_copies_ties_nulls_and_lengths(spark):
    """One block holds all, so that nothing but the stopping test may miss;
    with the chance set to 1e-12 the answer is the exact one."""
    rng = np.random.default_rng(2)
    x = clusters(200, 4, 3)
    rows = as_rows(x) + [(i, x[7].tolist()) for i in range(1000, 1060)] + [(300, x[7].tolist())] * 5
    rows += [(None, x[3].tolist()), (400, x[3].tolist()), (400, x[4].tolist()), (-100, x[5].tolist())]
    rows += [(500 + i, v) for i, v in enumerate(NO)] + [(i, rng.standard_normal(6).tolist()) for i in (600, 601, 700)] + [(900, [1.0])]
    got = run(spark, rows, miss=1e-12)
    want = brute(rows)
    flat = sorted((i, j, round(d, 9)) for (i, _), w in want.items() for j, d in w)
    assert sorted((r.query_id, r.vec_id, round(r.score, 9)) for r in got.collect()) == flat
    assert {r.vec_id for r in got.where("query_id = 600").collect()} == {601, 700}
    assert got.where("query_id in (500, 900)").count() == 0


def test_single_precision_and_small_tables(spark):
    rows = as_rows(clusters(100, 8, 4).astype(np.float32).astype(float))
    got = found(run(spark, rows, "float", every=10, miss=1e-12))
    want = {i: w for (i, _), w in brute(rows, every=10).items()}
    assert {i: [j for j, _ in g] for i, g in got.items()} == {i: [j for j, _ in w] for i, w in want.items()}
    assert run(spark, []).collect() == []
    assert run(spark, [(0, [1.0, 2.0])]).collect() == []
    assert [tuple(r) for r in run(spark, [(0, [1.0, 2.0]), (5, [1.0, 5.0])]).collect()] == [(0, 1, 5, 3.0)]


def test_chi_square_and_trees():
    assert neighbours.chi2(2 * math.log(2), 2) == pytest.approx(0.5)  # exponential
    assert neighbours.chi2(3.841458820694124, 1) == pytest.approx(0.95)
    assert neighbours.stop_factor(0.05, 10) == pytest.approx(18.307038053275146)
    rng = np.random.default_rng(1)
    # projected over true squared distances follow the distribution, over all projections
    under = []
    for dim in range(20, 220):
        x = rng.standard_normal((50, dim))
        p = x @ neighbours.projection(dim, 8)
        under.append(((p ** 2).sum(axis=1) / (x ** 2).sum(axis=1) <= neighbours.stop_factor(0.1, 8)).mean())
    assert abs(np.mean(under) - 0.9) < 0.01
    points = rng.standard_normal((1000, 3))
    leaf = neighbours.leaf_of(points, neighbours.split_tree(points, 16))
    assert sorted(set(leaf)) == list(range(16)) and np.bincount(leaf).max() <= 64
    order = neighbours.buckets(points, 32)
    assert sorted(order) == list(range(1000))
    low, high = points.min(axis=0)[None], points.max(axis=0)[None]
    assert neighbours.box_distance(points, low, high).max() == 0
    assert neighbours.box_distance(high + 2, low, high)[0, 0] == pytest.approx(12)
    same = np.ones((100, 2))
    assert len(set(neighbours.leaf_of(same, neighbours.split_tree(same, 8)))) == 1
