"""Embedding near-duplicates against brute force in double precision."""
import numpy as np
import pytest

from cartograph.llm import embeddings


def brute(rows, threshold=0.9):
    """id, vector rows -> (id, n_links, component, kept) by all pairs."""
    out, good = [], []
    for i, (_, v) in enumerate(rows):
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.append(i)
    unit = {i: np.array(rows[i][1], float) / np.linalg.norm(np.array(rows[i][1], float)) for i in good}
    root = {i: i for i in good}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = dict.fromkeys(range(len(rows)), 0)
    for k, i in enumerate(good):
        for j in good[:k]:
            if len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in good:
        ids = [rows[j][0] for j in good if find(j) == find(i) and rows[j][0] is not None]
        least[i] = min(ids) if ids else None
    for i, (vid, _) in enumerate(rows):
        c = least.get(i, vid)
        out.append((vid, links[i], c, vid == c))
    return sorted(out, key=str)


def got(df, **kw):
    return sorted((tuple(r) for r in embeddings.near_duplicates(df, **kw).select("vec_id", "n_links", "component_id", "kept")
                   .collect()), key=str)


@pytest.mark.parametrize("most", [1024, 16])
def test_clusters_and_hot_bucket(spark, most):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((150, 16))
    hot = rng.standard_normal(16)
    near = hot + 0.08 * rng.standard_normal((60, 16))
    edge = hot * 1.0 + 0.3 * rng.standard_normal((40, 16))  # cosines around the threshold
    rows = [(int(i), [float(np.float32(c)) for c in v]) for i, v in enumerate(np.concatenate([x, near, edge, near[:5]]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    mine, want = got(df, most=most), brute(rows)
    assert mine == want


def test_edge_rows(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 2.0, 0.0]
    rows = [(5, a), (3, [2.0, 0.0, 0.0]), (None, a), (9, None), (8, [0.0, 0.0, 0.0]), (7, [1.0, None, 0.0]),
            (6, [float("nan"), 1.0, 0.0]), (4, [float("inf"), 0.0, 0.0]), (2, b), (2, b), (1, []), (0, [1.0, 0.0]),
            (11, [1e30, 0.0, 1e-30]), (None, None), (None, [0.0, 0.0, 5.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cid string, copies int")
    assert got(df) == brute(rows)
    assert got(df.limit(0)) == []


def test_query_matches_brute_force(spark):
    from cartograph.llm.queries import op1_embedding_links
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    mine = sorted((tuple(r) for r in op1_embedding_links(spark, "/root/testdata/sf0.01")
                   .select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert mine == brute(rows)


@pytest.mark.parametrize("dim", [32, 300])
def test_estimates_are_unbiased_and_bounded(monkeypatch, dim):
    """The library's codes and estimates over many rotations."""
    rng = np.random.default_rng(1)
    o = rng.standard_normal(dim)
    q = 0.7 * o + 0.7 * rng.standard_normal(dim)
    o, q = embeddings.unit(np.stack([o, q]))
    errors, standard = [], []
    for _ in range(400):
        p = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        monkeypatch.setitem(embeddings._ROTATED, (dim, 1), p[None])
        codes, factor = embeddings.encode(o[None])
        assert codes.nbytes == -(-dim // 8)
        signs = embeddings.decode(codes, dim)
        assert np.array_equal(signs[0], np.sign(o @ p))
        errors.append(float(embeddings.estimates(signs, factor, (q @ p)[None])[0, 0] - o @ q))
        standard.append(float(o @ q - embeddings.least_estimate(factor, dim, o @ q, 1)[0]))
    assert abs(np.mean(errors)) < 3 * np.std(errors) / 20
    assert np.std(np.array(errors) / np.array(standard)) < 1.1 and max(-np.array(errors) / np.array(standard)) < embeddings.ERRORS


def test_least_estimate_never_drops_what_is_certain():
    """At every threshold, also where the confidence bound is the wider one, pairs
    at the threshold pass."""
    rng = np.random.default_rng(3)
    for dim in (2, 8, 64, 400):
        o = embeddings.unit(rng.standard_normal((200, dim)))
        other = embeddings.unit(o + 0.4 * rng.standard_normal((200, dim)) / np.sqrt(dim))
        codes, factor = embeddings.encode(o)
        est = np.diag(embeddings.estimates(embeddings.decode(codes, dim), factor, other @ embeddings.rotated(dim, 1)[0]))
        for e, f, cos in zip(est, factor, (o * other).sum(axis=1)):
            assert e >= embeddings.least_estimate(np.array([f]), dim, cos)[0] - 1e-5


@pytest.mark.parametrize("most", [4096, 100])
def test_no_link_of_a_large_cluster_around_the_threshold_is_lost(spark, most):
    rng = np.random.default_rng(7)
    hot = rng.standard_normal(64)
    x = np.concatenate([hot + 0.335 * rng.standard_normal((1200, 64)), rng.standard_normal((300, 64))]).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    unit = embeddings.unit(x)
    cosines = unit @ unit.T
    linked = cosines >= 0.9
    np.fill_diagonal(linked, False)
    assert linked.sum() > 100_000 and (abs(cosines - 0.9) < 0.01).sum() > 100_000
    links = {r.vec_id: r.n_links for r in embeddings.near_duplicates(
        spark.createDataFrame(rows, "vec_id long, embedding array<float>"), most=most).collect()}
    assert [links[i] for i in range(len(x))] == linked.sum(axis=1).tolist()
