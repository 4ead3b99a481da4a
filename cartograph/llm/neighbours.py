"""Approximate nearest neighbours by stable projections and a kd-tree.

Every vector is projected to ``PLACES`` Gaussian (2-stable) coordinates: for a
pair at Euclidean distance d, the squared distance of the projections divided
by d^2 follows the chi-square distribution with ``PLACES`` degrees of freedom.
Neighbours of a query are met in order of projected distance and verified by
their true one. With the k-th best true distance D so far, a vector not met
yet, at projected distance r or more, is nearer than D with a chance of at
most ``1 - chi2(r^2 / D^2)``; the search stops when that is ``MISS`` or less.
Nothing else ends it: there is no cap on the vectors verified.

The projections are indexed by a kd-tree. Its upper part is split at the
medians of a sample of at most ``SAMPLE`` vectors into at most ``CELLS``
cells, which shrink where vectors are dense; every vector then goes to its
cell, whose exact box is kept. Its lower part is a block of at most about
``MOST`` vectors of a cell, split at the medians into buckets with boxes.

1. A query searches its own block. That gives a first D.
2. Cells whose box is not further from the query's projection than the
   stopping test allows at that D are visited, block by block, and D shrinks
   within each.
3. The nearest over all visited blocks are kept per query.

Equal vectors are one node that keeps its ``k + 1`` least ids, and equal
queries search once. Blocks and their queries meet in groups of one block and
at most about ``QUERIES`` queries.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch
from cartograph.llm.embeddings import valid

#: Projected coordinates, and the chance that the stopping test passes over a
#: nearer vector.
PLACES = 8
MISS = 0.01
#: Vectors the upper tree is fitted on, and its most cells.
SAMPLE = 1 << 14
CELLS = 1 << 12
#: Vectors of a block, of a bucket in it, and queries that meet a block at once.
MOST = 4096
BUCKET = 32
QUERIES = 1024
SEED = 31


def chi2(x: float, m: int) -> float:
    """Distribution function of the chi-square distribution with ``m`` degrees
    of freedom, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-17:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def stop_factor(miss: float, m: int) -> float:
    """Squared projected over squared true distance from which the test holds."""
    low, high = 0.0, 1.0
    while chi2(high, m) < 1 - miss:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if chi2(mid, m) >= 1 - miss else (mid, high)
    return high


_MATRICES: dict[tuple[int, int], np.ndarray] = {}


def projection(dim: int, places: int) -> np.ndarray:
    """Gaussian matrix (dim x places), the same wherever it is made."""
    if (dim, places) not in _MATRICES:
        _MATRICES[dim, places] = np.random.default_rng((SEED, dim, places)).standard_normal((dim, places))
    return _MATRICES[dim, places]


def split_tree(points: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """kd-tree over ``points`` with up to ``cells`` leaves (a power of 2):
    axis and place of every inner node, in heap order; a leaf is a node after
    them. Each node halves its points on the axis where they spread most."""
    inner = cells - 1
    axis, place = np.zeros(inner, np.int32), np.zeros(inner)
    own = {0: np.arange(len(points))}
    for node in range(inner):
        at = own.pop(node)
        if len(at):
            axis[node] = (points[at].max(axis=0) - points[at].min(axis=0)).argmax()
            place[node] = np.median(points[at, axis[node]])
        up = points[at, axis[node]] > place[node]
        own[2 * node + 1], own[2 * node + 2] = at[~up], at[up]
    return axis, place


def leaf_of(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Leaf of every point, from 0."""
    axis, place = tree
    node = np.zeros(len(points), np.int64)
    for _ in range((len(axis) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), axis[node]] > place[node])
    return node - len(axis)


def buckets(points: np.ndarray, size: int) -> np.ndarray:
    """Order of the points in which runs of ``size`` are the leaves of a
    kd-tree (median splits on the widest axis, at multiples of ``size``)."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        at = todo.pop()
        if len(at) <= size:
            out.append(at)
            continue
        axis = np.ptp(points[at], axis=0).argmax()
        half = -(-len(at) // size) // 2 * size
        at = at[np.argpartition(points[at, axis], half)]
        todo += [at[half:], at[:half]]
    return np.concatenate(out)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances of every row of ``q`` to every box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):  # axis by axis: no third dimension in memory
        off = np.maximum(0, np.maximum(low[None, :, j] - q[:, None, j], q[:, None, j] - high[None, :, j]))
        out += off * off
    return out


def placed(trees: dict[int, tuple], places: int, kind: str):
    """mapInArrow: (cid, ids, vector) to its cell and projection."""
    schema = pa.schema([("cid", pa.int64()), ("ids", pa.binary()), ("dim", pa.int32()), ("cell", pa.int32()), ("projected", pa.binary()),
                        ("vector", pa.binary())])

    def run(batches):
        for b in batches:
            cid, ids, vectors = b.column("cid").to_numpy(), b.column("ids").to_pylist(), b.column("vector").to_pylist()
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                x = np.array([vectors[j] for j in at], np.float64)
                p = x @ projection(int(dim), places)
                cell = leaf_of(p, trees[dim]) if dim in trees else np.zeros(len(at))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[at]), pa.array([np.array(ids[j], "<i8").tobytes() for j in at], pa.binary()),
                     pa.array([dim] * len(at), pa.int32()), pa.array(cell.astype(np.int32)), pa.array([r.tobytes() for r in p], pa.binary()),
                     pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], schema=schema)
    return run


def block_of(places: int):
    """applyInPandas on the vectors of a block: one row with all of them, in
    the order of its kd-tree, and the block's box."""
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        p = np.frombuffer(b"".join(pdf["projected"]), np.float64).reshape(-1, places)
        order = buckets(p, BUCKET)
        pdf = pdf.iloc[order]
        ids = pdf["ids"]
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "cell": [int(key[1]) >> 32],
                             "low": [p.min(axis=0).tolist()], "high": [p.max(axis=0).tolist()], "cids": [pdf["cid"].to_numpy("<i8").tobytes()],
                             "counts": [(ids.str.len() // 8).to_numpy("<i8").tobytes()], "ids": [b"".join(ids)],
                             "projected": [p[order].tobytes()], "vectors": [b"".join(pdf["vector"])]})
    return run


class Block:
    """A block's kd-tree: buckets of vectors, met in order of their boxes."""

    def __init__(self, row: pd.Series, places: int, kind: str):
        dim = int(row["dim"])
        self.counts, self.ids = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["ids"], "<i8")
        self.begin = np.cumsum(self.counts) - self.counts
        self.p = np.frombuffer(row["projected"], np.float64).reshape(-1, places)
        self.x = np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.float64)
        self.first = np.arange(0, len(self.p), BUCKET)
        self.low, self.high = np.minimum.reduceat(self.p, self.first), np.maximum.reduceat(self.p, self.first)

    def search(self, q: np.ndarray, p: np.ndarray, bound: float, to_boxes: np.ndarray, k: int, factor: float):
        """Distances, ids and places in the block of the ``k`` nearest rows to
        ``q`` (projected to ``p``) that the stopping test lets through, nearest
        first; no row further than ``bound`` counts."""
        order = np.argsort(to_boxes, kind="stable")
        far, best, i, step = to_boxes[order], bound, 0, 2
        near, ids, own = np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while i < len(order) and far[i] <= factor * best * best:
            j = min(i + step, int(np.searchsorted(far, factor * best * best, side="right")))
            at = (self.first[order[i:j], None] + np.arange(BUCKET)).ravel()
            at = at[at < len(self.p)]
            off = self.p[at] - p
            at = at[np.einsum("ij,ij->i", off, off) <= factor * best * best]
            off = self.x[at] - q
            dist = np.sqrt((off * off).sum(axis=1))
            at, dist = at[dist <= best], dist[dist <= best]
            if len(at):
                n = self.counts[at]
                rows = np.repeat(self.begin[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                near, ids, own = (np.concatenate(x) for x in ((near, np.repeat(dist, n)), (ids, self.ids[rows]), (own, np.repeat(at, n))))
                keep = np.lexsort((ids, near))[:k]
                near, ids, own = near[keep], ids[keep], own[keep]
                if len(near) == k:
                    best = min(best, float(near[-1]))
            i, step = j, 2 * step
        return near, ids, own


def searched(k: int, factor: float, places: int, kind: str):
    """cogroup().applyInPandas on a block and queries that visit it."""
    def run(key: tuple, block: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        qs, cids, ids, dists = [], [], [], []
        if len(block) and len(queries):
            row = block.iloc[0]
            b, own = Block(row, places, kind), np.frombuffer(row["cids"], "<i8")
            p = np.frombuffer(b"".join(queries["projected"]), np.float64).reshape(-1, places)
            x = np.frombuffer(b"".join(queries["vector"]), kind).reshape(-1, int(row["dim"])).astype(np.float64)
            bounds, qcid = queries["bound"].to_numpy(), queries["qcid"].to_numpy()
            for i in range(0, len(p), 256):
                boxes = box_distance(p[i:i + 256], b.low, b.high)
                for j in range(len(boxes)):
                    got = b.search(x[i + j], p[i + j], bounds[i + j], boxes[j], k, factor)
                    qs += [qcid[i + j]] * len(got[0])
                    dists += got[0].tolist()
                    ids += got[1].tolist()
                    cids += own[got[2]].tolist()
        return pd.DataFrame({"qcid": np.array(qs, np.int64), "dist": np.array(dists, np.float64), "cid": np.array(cids, np.int64),
                             "id": np.array(ids, np.int64)})
    return run


def visits(boxes: dict[int, tuple], factor: float, places: int):
    """mapInArrow: (qcid, home, dim, projected, bound) to the cells that the stopping
    test does not exclude."""
    def run(batches):
        for b in batches:
            qcid, home, dims, bound = (b.column(c).to_numpy() for c in ("qcid", "home", "dim", "bound"))
            p = np.frombuffer(b"".join(b.column("projected").to_pylist()), np.float64).reshape(-1, places)
            for dim in np.unique(dims):
                cells, low, high = boxes[int(dim)]
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 256):
                    own = at[i:i + 256]
                    near = box_distance(p[own], low, high) <= factor * np.square(bound[own])[:, None]
                    q, c = np.nonzero(near)
                    yield pa.RecordBatch.from_arrays([pa.array(qcid[own][q]), pa.array(home[own][q]), pa.array([dim] * len(q), pa.int32()), pa.array(cells[c], pa.int32())],
                                                     names=["qcid", "home", "dim", "cell"])
    return run


def nearest(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", miss: float = MISS,
            places: int = PLACES, most: int = MOST) -> DataFrame:
    """The ``k`` nearest rows of every row whose id is divisible by ``every``:
    ``(query_id, rank, vec_id, score)``, ``score`` the Euclidean distance of
    the original vectors in double precision; ranks from 1, ties to the
    smaller id. Fewer candidates than ``k`` are all returned.

    A row's true neighbour is missed with a chance of at most ``miss``; what is
    returned is exact. Vectors that are null, zero or hold null or non-finite
    components, and rows without id, take no part; vectors of another length
    are no candidates. Rows of equal id and vector count once; a query's
    own row is no candidate, but one of its id with another vector is. An
    empty table gives no rows. Other columns are not read.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "neighbours")
    factor = stop_factor(miss, places)
    kind = "<f4" if rows.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")) \
        .where(F.col("id").isNotNull() & valid(F.col("vector")))
    # ids of a vector beyond the k + 1 least can be no neighbour; a window group
    # limit drops them before the shuffle
    least = own.distinct().withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).where(F.col("at") <= k + 1)
    nodes = scratch.save(least.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids"))
                         .withColumn("cid", F.monotonically_increasing_id()), "nodes")
    asked = scratch.save(own.where(F.col("id") % every == 0).distinct()
                         .join(nodes.select("cid", F.col("vector").alias("v")), F.col("vector") == F.col("v"))
                         .select(F.col("id").alias("query_id"), F.col("cid").alias("qcid")), "asked")

    # the upper tree: bounded sample, bounded cells
    sample = [r.vector for r in nodes.select("vector").orderBy(F.xxhash64("cid")).limit(SAMPLE).collect()]
    count = nodes.count()
    trees = {}
    for dim in {len(v) for v in sample}:
        points = np.array([v for v in sample if len(v) == dim]) @ projection(dim, places)
        share = len(points) / len(sample)
        cells = 1
        while 2 * cells <= share * CELLS and cells * most < share * count:
            cells *= 2
        trees[dim] = split_tree(points, cells)
    put = scratch.save(nodes.select("cid", "ids", "vector").mapInArrow(
        placed(trees, places, kind), "cid long, ids binary, dim int, cell int, projected binary, vector binary"), "placed")
    sizes = put.groupBy("dim", "cell").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("cid"), F.col("parts"))
    put = put.join(sizes, ["dim", "cell"]).withColumn("block", F.shiftleft(F.col("cell").cast("long"), 32) + part)
    blocks = scratch.save(put.groupBy("dim", "block").applyInPandas(
        block_of(places), "dim int, block long, cell int, low array<double>, high array<double>, cids binary, counts binary, ids binary, "
                          "projected binary, vectors binary"), "blocks")
    # at most CELLS boxes; each side of a box is the least or greatest of its blocks
    side = lambda f, c: F.array(*[f(F.get(c, F.lit(i))) for i in range(places)])
    boxes = {}
    for r in blocks.groupBy("dim", "cell").agg(side(F.min, "low").alias("low"), side(F.max, "high").alias("high")).collect():
        boxes.setdefault(r.dim, []).append((r.cell, r.low, r.high))
    boxes = {d: tuple(np.array(x) for x in zip(*b)) for d, b in boxes.items()}

    queries = put.join(asked.select(F.col("qcid").alias("cid")).distinct(), "cid", "left_semi") \
        .select(F.col("cid").alias("qcid"), "dim", "block", "projected", "vector")

    def meet(hits: DataFrame) -> DataFrame:
        """Queries ``(qcid, dim, block, projected, vector, bound)`` search their blocks."""
        chunks = hits.groupBy("dim", "block").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("chunks"))
        left = blocks.drop("low", "high", "cell").join(chunks, ["dim", "block"]) \
            .withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        right = hits.join(chunks, ["dim", "block"]).withColumn("chunk", F.pmod(F.xxhash64("qcid"), F.col("chunks")).cast("int")).drop("chunks")
        right = right.select(*[F.col(c).alias(c) for c in right.columns])  # not the columns of ``left``, which both sides come from
        keys = ("dim", "block", "chunk")
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(
            searched(k + 1, factor, places, kind), "qcid long, dist double, cid long, id long")

    home = scratch.save(meet(queries.withColumn("bound", F.lit(float("inf")))), "home")
    enough = F.when(F.count(F.lit(1)) > k, F.max("dist")).otherwise(float("inf"))
    bounded = scratch.save(queries.withColumnRenamed("block", "home").join(home.groupBy("qcid").agg(enough.alias("bound")), "qcid"), "bounded")
    cells = bounded.select("qcid", "home", "dim", "projected", "bound") \
        .mapInArrow(visits(boxes, factor, places), "qcid long, home long, dim int, cell int")
    hits = scratch.save(cells.join(blocks.select("dim", "cell", "block"), ["dim", "cell"]).where("block != home").select("qcid", "block"), "hits")
    found = home.unionByName(scratch.save(meet(hits.join(bounded.drop("home"), "qcid")), "found"))

    order = [F.col("dist"), F.col("id"), F.col("cid")]
    best = found.withColumn("at", F.row_number().over(Window.partitionBy("qcid").orderBy(*order))).where(F.col("at") <= k + 1)
    out = asked.join(best, "qcid").where((F.col("qcid") != F.col("cid")) | (F.col("query_id") != F.col("id")))
    rank = F.row_number().over(Window.partitionBy("query_id", "qcid").orderBy(*order))
    return out.withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", F.col("id").alias("vec_id"), F.col("dist").alias("score"))

