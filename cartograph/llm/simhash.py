"""SimHash near-duplicates.

A text's fingerprint has 64 bits: each is 1 if it is set in over half of the
XXH64 hashes of the text's word shingles. Texts whose fingerprints differ in
at most three bits are linked.

Candidates come from pigeonhole blocks: the 64 bits are cut into four blocks,
and two fingerprints with at most three differing bits agree in one of them at
least. A block value shared by more than ``MOST`` distinct fingerprints is cut
again: its members agree on the block, so their difference lies in the other
bits, which are cut into four blocks in turn. The fingerprints in a bucket are
distinct, so a bucket whose open bits number ten or fewer holds at most 1,024
of them, and the cutting ends for any data. Every bucket is verified by the
Hamming distance and returns a tree of links, not its pairs.

Equal fingerprints (any number of copies) are one node from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, components, fresh

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Most distinct fingerprints in one verified bucket (2 ** 10).
MOST = 1024


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; no words: 0. ``bytes.lower``
    and ``bytes.split`` work on A-Z and ASCII white space only."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:n].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    ends = ends[min(shingle, len(words)) - 1:].tolist()
    for i in range(0, n, 65280):  # 255 * 256: bounded memory for a text of any length
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[i:i + 65280], ends[i:i + 65280])], np.uint64)
        h = np.concatenate((h, np.zeros(-len(h) % 255, np.uint64)))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprint_column(text, shingle: int = SHINGLE):
    """Column of fingerprints (long) of a text column."""
    @F.arrow_udf("long")
    def simhash(raw: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), shingle) for x in raw], pa.int64())
    return simhash(F.col(text).cast("binary") if isinstance(text, str) else text.cast("binary"))


def cut(mask: int, blocks: int) -> list[int]:
    """Masks that fix ``mask`` and one of ``blocks`` runs of its open bits."""
    open_bits = [i for i in range(64) if not mask >> i & 1]
    return [mask | sum(1 << int(i) for i in run) for run in np.array_split(open_bits, blocks) if len(run)]


def keyed(distance: int):
    """mapInArrow: (mask, fp) to (mask, key, fp) for each finer mask."""
    def run(batches):
        for b in batches:
            mask = b.column("mask").to_numpy().view(np.uint64)
            fp = b.column("fp").to_numpy().view(np.uint64)
            for m in np.unique(mask):
                own = fp[mask == m]
                for finer in cut(int(m), distance + 1):
                    finer = np.uint64(finer)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), finer).view(np.int64)), pa.array((own & finer).view(np.int64)),
                         pa.array(own.view(np.int64))], names=["mask", "key", "fp"])
    return run


def tree(fps: list[int], distance: int) -> list[tuple[int, int]]:
    """Edges to the smallest member for each linked class of one bucket."""
    a = np.array(sorted(fps), np.int64)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= distance
    label = np.arange(len(a))
    while True:
        new = np.where(near, label[None, :], len(a)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(a[i]), int(a[r])) for i, r in enumerate(label) if i != r]


def verified(distance: int):
    """mapInArrow: buckets of fingerprints to the edges that hold."""
    def run(batches):
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for b in batches:
            edges = []
            for fps in b.column("fps").to_pylist():
                if len(fps) <= 8:
                    edges += [(x, y) for i, x in enumerate(fps) for y in fps[:i]
                              if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= distance]
                else:
                    edges += tree(fps, distance)
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()),
                                              pa.array([e[1] for e in edges], pa.int64())], schema=schema)
    return run


def links(fps: DataFrame, scratch: Scratch, distance: int = DISTANCE, most: int = MOST) -> DataFrame:
    """Edges ``(a, b)`` that connect the distinct fingerprints ``fps(fp)``
    just as all pairs within ``distance`` bits do."""
    members, found, level = fps.select(F.lit(0).cast("long").alias("mask"), "fp"), None, 0
    while True:
        rows = scratch.save(members.mapInArrow(keyed(distance), "mask long, key long, fp long"), f"keyed-{level}")
        hot = scratch.save(rows.groupBy("mask", "key").count().where(F.col("count") > most).select("mask", "key"),
                           f"hot-{level}")
        again = not hot.isEmpty()
        cold = rows.join(hot, ["mask", "key"], "left_anti") if again else rows
        buckets = cold.groupBy("mask", "key").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        edges = scratch.save(buckets.select("fps").mapInArrow(verified(distance), "a long, b long"), f"links-{level}")
        found = edges if found is None else found.unionByName(edges)
        if not again:
            return found
        members, level = rows.join(hot, ["mask", "key"], "left_semi").select("mask", "fp"), level + 1


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
           distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``(<id>, fp, component_id)``.

    ``component_id`` is the smallest id in the document's class of linked
    fingerprints. A null or empty text, or one without words, has fingerprint
    0, which links like any other. A row with a null id takes part in the
    links; its component is the smallest non-null id, or null if there is
    none. Repeated rows are kept. Other columns of ``docs`` are not read.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    prints = scratch.save(docs.select(F.col(id_col).alias("id"), fingerprint_column(text_col, shingle).alias("fp")),
                          "prints")
    return classed(prints, scratch, distance).select(F.col("id").alias(id_col), "fp", "component_id")


def classed(prints: DataFrame, scratch: Scratch, distance: int = DISTANCE) -> DataFrame:
    """Adds ``component_id`` and ``label``, the class's smallest fingerprint, to rows ``(id, fp)``."""
    nodes = scratch.save(prints.groupBy("fp").agg(F.min("id").alias("first")), "nodes")
    label = components(links(nodes.select("fp"), scratch, distance), scratch)
    nodes = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left") \
        .select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = nodes.groupBy("label").agg(F.min("first").alias("component_id"))
    return prints.join(nodes.join(least, "label").select("fp", "label", "component_id"), "fp")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """``docs`` with one document of each class, the one with the smallest id.

    Of repeated rows with that id one stays. A class without any non-null id
    keeps one row too. The columns are those of ``docs``.
    """
    scratch = scratch or Scratch(docs.sparkSession, "simhash")
    fp, row = fresh(docs, "fp"), fresh(docs, "row")
    # stored, so that a row number is the same wherever it is read
    rows = scratch.save(docs.withColumn(fp, fingerprint_column(text_col)).withColumn(row, F.monotonically_increasing_id()),
                        "rows")
    prints = scratch.save(rows.select(F.col(id_col).alias("id"), F.col(fp).alias("fp"), F.col(row).alias("row")),
                          "prints")
    best = classed(prints, scratch).where(F.col("id").eqNullSafe(F.col("component_id"))) \
        .groupBy("label").agg(F.min("row").alias(row)).select(row)
    return rows.join(best, row, "left_semi").select(*docs.columns)
