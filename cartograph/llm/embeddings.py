"""Near-duplicate vectors by exact angle bounds and randomised-rotation codes.

Every pair of vectors is decided; a bound only ever drops pairs that cannot be
a link.

A few vectors of the table are pivots. Vectors lie in blocks of their nearest
pivot, at most about ``MOST`` to a block, and a block keeps the least and the
greatest angle of its members to each pivot. Angles obey the triangle
inequality, so two blocks whose angles to some pivot lie further apart than
the threshold's angle hold no link between them; all other pairs of blocks,
and each block with itself, are a tile. Which vectors are pivots changes the
number of tiles, not the result.

A unit vector o is rotated at random and stored as the signs of its
coordinates, packed to bits: the code s, with c = s / sqrt(D) the nearest corner
of the unit cube's sphere, and the factor f = <c, P o>. Both are made once per
vector. Inside a tile, ``<c, P q> / f`` is an unbiased estimate of <o, q> for a
rotated unit vector q, with a standard error of at most
sqrt((1 - f^2) / f^2 / (D - 1)). A pair is dropped when its estimate lies under
the threshold by ``ERRORS`` of them (a link is missed with a probability of 3e-10
at most), or when it lies under what a link must reach for certain, as q at an
angle of at most t to o has an angle of at most arccos(f) + t to the code;
whichever drops more. The pairs that are left are recomputed: in double
precision where they are few, else in single precision first and in double
what its rounding error leaves open.

Tiles return counts and a tree of links, never pairs. Equal vectors are one
node with a number of copies from the start. Vectors without clusters leave
nothing for the pivots to drop: then the products grow with the square of the
number of different vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, components

THRESHOLD = 0.9
#: Standard errors that the estimate by a code may be off.
ERRORS = 6.2
#: Vectors of a block.
MOST = 4096
#: Fewest and most pivots, and the vectors they are picked from.
PIVOTS = (16, 256)
SAMPLE = 1024
SEED = 29


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, the same wherever they are made."""
    rng = np.random.default_rng((SEED, dim))
    return np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(count)])


_ROTATED: dict[tuple[int, int], np.ndarray] = {}


def rotated(dim: int, count: int) -> np.ndarray:
    if (dim, count) not in _ROTATED:
        _ROTATED[dim, count] = rotations(dim, count)
    return _ROTATED[dim, count]


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision; the largest component is
    taken out first, so that no square over- or underflows."""
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def pick_pivots(vectors: list, count: int) -> dict[int, np.ndarray]:
    """Up to ``count`` unit vectors per length, each far from those before it."""
    found = {}
    for dim in {len(v) for v in vectors}:
        x = unit(np.array([v for v in vectors if len(v) == dim]))
        at, nearest = [0], x @ x[0]
        while len(at) < min(count, len(x)):
            at.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, x @ x[at[-1]])
        found[dim] = x[at]
    return found


def angles(x: np.ndarray, pivots: dict[int, np.ndarray]) -> np.ndarray:
    """Angle of every row to every pivot of its length; without any, one column of zeros."""
    own = pivots.get(x.shape[1])
    return np.zeros((len(x), 1)) if own is None else np.arccos(np.clip(x @ own.T, -1, 1))


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (packed bits) and factors of unit vectors."""
    turned = x @ rotated(x.shape[1], 1)[0]
    factor = np.minimum(1, np.abs(turned).sum(axis=1) / math.sqrt(x.shape[1]))
    return np.packbits(turned >= 0, axis=1), factor


def decode(codes: np.ndarray, dim: int) -> np.ndarray:
    """Signs (1 or -1) of packed codes."""
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimates(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray) -> np.ndarray:
    """Unbiased estimates of the products of coded vectors with ``turned``
    (rotated unit vectors), one row per code."""
    return signs @ turned.T / (factor * math.sqrt(signs.shape[1]))[:, None]


def least_estimate(factor: np.ndarray, dim: int, threshold: float, errors: float = ERRORS) -> np.ndarray:
    """The estimate under which a pair is no link, by confidence or for certain."""
    confident = threshold - errors * np.sqrt((1 - factor ** 2) / factor ** 2 / max(1, dim - 1))
    certain = np.cos(np.minimum(math.pi, np.arccos(factor) + math.acos(max(-1, min(1, threshold))))) / factor
    return np.maximum(confident, certain)


def nearest_pivot(pivots: dict[int, np.ndarray], kind: str):
    """mapInArrow: (cid, copies, vector) to (cid, copies, dim, pivot, code, factor, vector as ``kind``)."""
    schema = pa.schema([("cid", pa.int64()), ("copies", pa.int64()), ("dim", pa.int32()), ("pivot", pa.int32()), ("code", pa.binary()),
                        ("factor", pa.float64()), ("vector", pa.binary())])

    def run(batches):
        for b in batches:
            cid, copies = b.column("cid").to_numpy(), b.column("copies").to_numpy()
            vectors = b.column("vector").to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                raw = np.array([vectors[j] for j in at], kind)
                x = unit(raw)
                pivot, (codes, factor) = angles(x, pivots).argmin(axis=1), encode(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[at]), pa.array(copies[at]), pa.array([dim] * len(at), pa.int32()), pa.array(pivot.astype(np.int32)),
                     pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(factor), pa.array([r.tobytes() for r in raw], pa.binary())], schema=schema)
    return run


def block_of(pivots: dict[int, np.ndarray], kind: str):
    """applyInPandas on the members of a block: one row with all of them."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        dim = int(key[0])
        pdf = pdf.sort_values("cid")
        vectors = b"".join(pdf["vector"])
        to = angles(unit(np.frombuffer(vectors, kind).reshape(-1, dim)), pivots)
        return pd.DataFrame({"dim": [dim], "block": [pdf["cid"].iloc[0]], "low": [to.min(axis=0).tolist()], "high": [to.max(axis=0).tolist()],
                             "cids": [pdf["cid"].to_numpy("<i8").tobytes()], "copies": [pdf["copies"].to_numpy("<i8").tobytes()],
                             "codes": [b"".join(pdf["code"])], "factors": [pdf["factor"].to_numpy("<f8").tobytes()], "vectors": [vectors]})
    return run


def united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (every node's smallest known node of its component) with links a - b."""
    while True:
        a, b = root[a], root[b]
        open_ = a != b
        if not open_.any():
            return root
        a, b = a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]


#: Pairs computed at once in double precision.
PAIRS = 1 << 16


def tile_links(threshold: float, kind: str):
    """applyInPandas on a tile of one or two blocks: links counted and a tree
    of them, per member."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        dim, n = int(pdf["dim"].iloc[0]), len(pdf["cids"].iloc[0]) // 8
        cid, copies = (np.frombuffer(b"".join(pdf[c]), "<i8") for c in ("cids", "copies"))
        raw = np.frombuffer(b"".join(pdf["vectors"]), kind).reshape(-1, dim)
        x = unit(raw)
        one = len(pdf) == 1
        second = slice(0, n) if one else slice(n, len(x))
        base = second.start
        first = pdf.iloc[0]
        factor = np.frombuffer(first["factors"], "<f8")
        signs = decode(np.frombuffer(first["codes"], np.uint8).reshape(n, -1), dim)
        turned, single = (x[second] @ rotated(dim, 1)[0]).astype(np.float32), x.astype(np.float32)
        # more than single precision can be off in a product of unit vectors
        slack = (dim + 16) * 2.0 ** -23
        least = (least_estimate(factor, dim, threshold) - slack / factor).astype(np.float32)
        factor = factor.astype(np.float32)
        links, root = np.zeros(len(x), np.int64), np.arange(len(x))

        def exact(p, q):
            good = [np.einsum("ij,ij->i", x[p[k:k + PAIRS]], x[q[k:k + PAIRS]]) >= threshold for k in range(0, len(p), PAIRS)]
            return np.concatenate(good) if good else np.zeros(0, bool)

        for i in range(0, n, 256):
            rows = slice(i, min(n, i + 256))
            maybe = estimates(signs[rows], factor[rows], turned) >= least[rows, None]
            if one:
                maybe &= np.arange(n) > np.arange(rows.start, rows.stop)[:, None]
            left = np.count_nonzero(maybe)
            if 32 * left > maybe.size:
                product = single[rows] @ single[second].T
                maybe &= product >= threshold - slack
                p, q = np.nonzero(maybe & (product < threshold + slack))
                good = exact(p + i, q + base)
                maybe[p[~good], q[~good]] = False
                p, q = np.nonzero(maybe)
                p, q = p + i, q + base
            else:
                p, q = np.nonzero(maybe)
                p, q = p + i, q + base
                good = exact(p, q)
                p, q = p[good], q[good]
            if len(p):
                links += np.bincount(p, copies[q], len(x)).astype(np.int64) + np.bincount(q, copies[p], len(x)).astype(np.int64)
                root = united(root, p, q)
        own = links > 0
        return pd.DataFrame({"cid": cid[own], "root": cid[root[own]], "links": links[own]})
    return run


def valid(vector: Column) -> Column:
    """Neither null nor zero, and every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD,
                    most: int = MOST) -> DataFrame:
    """One row per vector: ``(<id>, n_links, component_id, kept)``.

    ``n_links`` counts the other rows linked directly (cosine of at least
    ``threshold``), ``component_id`` is the smallest id reachable by links and
    ``kept`` says whether that is the row's own. Null, zero or non-finite
    vectors, and those of another length, link with nothing. A row with a null
    id takes part; its component is the smallest non-null id, or null. Repeated
    rows are vectors of their own. An empty table gives no rows. Other columns
    are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "vectors")
    # what the buckets shuffle is as wide as the input
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = own.where(valid(F.col("vector")))
    # stored, so that the number of a class is the same wherever it is read
    classes = scratch.save(good.groupBy("vector").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"))
                           .withColumn("cid", F.monotonically_increasing_id()), "classes")
    few, many = PIVOTS
    sample = [r.vector for r in classes.select("vector").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()]
    pivots = pick_pivots(sample, min(many, max(few, 2 * classes.count() // most)))
    near = scratch.save(classes.select("cid", "copies", "vector").mapInArrow(
        nearest_pivot(pivots, kind), "cid long, copies long, dim int, pivot int, code binary, factor double, vector binary"), "near")
    sizes = near.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    blocks = scratch.save(
        near.join(sizes, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int"))
        .groupBy("dim", "pivot", "part").applyInPandas(
            block_of(pivots, kind), "dim int, block long, low array<double>, high array<double>, cids binary, copies binary, codes binary, "
            "factors binary, vectors binary"),
        "blocks")
    # the slack is far above the rounding error of an angle
    apart = math.acos(max(-1, min(1, threshold))) + 1e-6
    a, b = (blocks.select("dim", F.col("block").alias(f"{s}_block"), F.col("low").alias(f"{s}_low"), F.col("high").alias(f"{s}_high"))
            for s in ("left", "right"))
    gaps = F.zip_with("left_low", "right_high", lambda x, y: x - y), F.zip_with("right_low", "left_high", lambda x, y: x - y)
    # every block meets every other of its length: in slices, so that no task has all pairs
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    a = a.withColumn("slice", F.pmod(F.xxhash64("left_block"), F.lit(slices)).cast("int"))
    b = b.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    tiles = a.join(b, ["dim", "slice"]).where("left_block <= right_block") \
        .where((F.array_max(gaps[0]) <= apart) & (F.array_max(gaps[1]) <= apart)) \
        .select("left_block", "right_block", F.explode(F.array_distinct(F.array("left_block", "right_block"))).alias("block"))
    found = scratch.save(
        tiles.join(blocks.drop("low", "high"), "block").groupBy("left_block", "right_block")
        .applyInPandas(tile_links(threshold, kind), "cid long, root long, links long"), "links")
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    label = components(found.where("cid != root").select(F.col("cid").alias("a"), F.col("root").alias("b")), scratch)
    nodes = classes.join(links, "cid", "left").join(label.withColumnRenamed("node", "cid"), "cid", "left") \
        .select("vector", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("label", "cid").alias("label"))
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    of = nodes.join(least, "label").select(F.col("vector").alias("v"), "n_links", "component_id", F.lit(True).alias("linked"))
    out = own.join(of, F.col("vector") == F.col("v"), "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def oracle(rows: str = "embeddings", threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for the rows of :func:`near_duplicates` over table ``rows``
    (unique, non-null ids): all pairs, and their closure."""
    return f"""
WITH RECURSIVE x AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM {rows}),
v AS (SELECT * FROM x WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0
      AND len(list_filter(e, lambda c: c <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      AND list_cosine_similarity(a.e, b.e) >= {threshold}),
r(id, root) AS (SELECT vec_id, vec_id FROM x UNION SELECT r.id, p.b FROM r JOIN p ON p.a = r.root),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY a)
SELECT id AS vec_id, CAST(coalesce(any_value(n_links), 0) AS BIGINT) AS n_links, min(root) AS component_id, id = min(root) AS kept
FROM r LEFT JOIN n ON n.a = id GROUP BY id"""
