"""Best-fit packing of token sequences by large-item matching.

Documents are encoded, and only those longer than the capacity are cut. Pieces
above a third of the capacity pair at most twice per sequence: from the longest
on, each takes the longest other large piece that still fits. Smaller pieces
then go, from the longest on, to the sequence with the smallest gap that takes
them; where none does, a new sequence starts.

Lengths are whole numbers up to the capacity, so the plan is made from the
number of pieces of each length, a table no longer than the capacity whatever
the corpus. The plan lists patterns: how many sequences hold which lengths at
which offsets. Each piece finds its place by its rank among the pieces of its
length. Ranks are a counter inside the task that encodes plus the totals of
the tasks before it, so no piece, and no token, is shuffled to be packed.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cartograph.llm.common import Scratch
from cartograph.llm.tokens import encoder, runs

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns ``(sequences, lengths in order)`` for ``counts`` of lengths.

    Works on groups of equal sequences. Every step uses up a length or a
    group, so there are at most a few times ``capacity`` patterns.
    """
    left = {n: c for n, c in counts.items() if c}
    bins: dict[int, list[list]] = defaultdict(list)  # gap -> [sequences, lengths]
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large.pop()
        while left[n]:
            i = bisect.bisect_right(large, capacity - n)
            if 2 * n <= capacity and left[n] > 1 and (i == 0 or large[i - 1] <= n):
                pairs, mate = left[n] // 2, n
                left[n] -= 2 * pairs
            elif i:
                mate = large[i - 1]
                pairs = min(left[n], left[mate])
                left[n] -= pairs
                left[mate] -= pairs
                if not left[mate]:
                    large.pop(i - 1)
            else:
                bins[capacity - n].append([left[n], [n]])
                left[n] = 0
                continue
            bins[capacity - n - mate].append([pairs, [n, mate]])
    gaps = sorted(bins)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect.bisect_left(gaps, n)
            if i == len(gaps):
                gap, group = capacity, [-(-left[n] // (capacity // n)), []]
            else:
                gap = gaps[i]
                group = bins[gap].pop()
                if not bins[gap]:
                    gaps.pop(i)
            fit = gap // n  # the filled sequence stays the one with the smallest gap
            full = min(group[0], left[n] // fit)
            rest = min(left[n] - full * fit, fit) if full < group[0] else 0
            for times, more in ((full, fit), (1 if rest else 0, rest), (group[0] - full - (1 if rest else 0), 0)):
                if times and (more or group[1]):
                    at = gap - more * n
                    if not bins[at]:
                        bisect.insort(gaps, at)
                    bins[at].append([times, group[1] + [n] * more])
            left[n] -= full * fit + rest
    return [(times, lengths) for gap in sorted(bins) for times, lengths in bins[gap]]


def places(patterns: list[tuple[int, list[int]]]) -> dict[int, np.ndarray]:
    """length -> rows (first rank, first sequence, offset), by first rank."""
    found, base, used = defaultdict(list), 0, defaultdict(int)
    for times, lengths in patterns:
        offset = 0
        for n in lengths:
            found[n].append((used[n], base, offset))
            used[n] += times
            offset += n
        base += times
    return {n: np.array(rows, np.int64) for n, rows in found.items()}


def pieces_of(path: str, end: int, capacity: int, width: int):
    """mapInArrow: (id, text) to encoded pieces with their rank inside the task;
    ``ids`` take ``width`` bytes each, their checksum is that of four bytes."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("task", pa.int32()), ("rank", pa.int64())])

    def run(batches):
        encode, task, seen = encoder(path, end), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for ids, texts in runs(batches):
            rows = []
            for doc, tokens in zip(ids, encode.batch(texts)):
                for k, start in enumerate(range(0, len(tokens), capacity)):
                    part = tokens[start:start + capacity].astype("<u4")
                    n = len(part)
                    rows.append((doc, k, start, n, part.astype(f"<u{width}").tobytes(), zlib.crc32(part), task, int(seen[n])))
                    seen[n] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
    return run


def placed_by(table: dict[int, np.ndarray]):
    """mapInArrow: (length, before, task, rank, ...) to (sequence_id, offset, ...)."""
    def run(batches):
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + b.column("before").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                own, rows = length == n, table[int(n)]
                at = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                sequence[own], offset[own] = at[:, 1] + rank[own] - at[:, 0], at[:, 2]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("piece"), b.column("start"), b.column("length"), b.column("ids_crc32"),
                 pa.array(sequence), pa.array(offset), b.column("task"), b.column("rank")],
                names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "task", "rank"])
    return run


class Packed:
    """Result of :func:`pack`: ``pieces`` with their place, ``ids`` with tokens."""

    def __init__(self, placed: DataFrame, encoded: DataFrame, id_col: str, width: int):
        self.placed, self.encoded, self.id_col, self.width = placed, encoded, id_col, width
        self.pieces = placed.drop("task", "rank").withColumnRenamed("id", id_col)

    def sequences(self) -> DataFrame:
        """``(sequence_id, ids, pieces)``: the packed sequences, ids as
        little-endian integers of ``width`` bytes (2 if the vocabulary allows)."""
        key = ["task", "length", "rank"]  # names one piece, whatever its id
        x = self.placed.join(self.encoded.select(*key, "ids"), key)
        parts = F.array_sort(F.collect_list(F.struct("offset", "id", "piece", "ids")))
        return x.groupBy("sequence_id").agg(parts.alias("parts")).select(
            "sequence_id", F.expr("aggregate(transform(parts, p -> p.ids), cast('' as binary), (a, b) -> concat(a, b))").alias("ids"),
            F.transform("parts", lambda p: F.struct(p["id"].alias(self.id_col), p["piece"], p["offset"])).alias("pieces"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0,
         capacity: int = CAPACITY, scratch: Scratch | None = None) -> Packed:
    """Encode and pack every document of ``docs``.

    One row per piece: ``(<id>, piece, start, length, ids_crc32, sequence_id,
    offset)``. A null or empty text is one piece of the end id alone. Rows with
    a null id and repeated rows are packed like any other. An empty table gives
    no rows. Which of several pieces of one length takes which place depends on
    how the input is split into tasks; the plan itself does not.
    """
    scratch = scratch or Scratch(docs.sparkSession, "packing")
    width = 2 if max(end + 1, Tokenizer.from_file(tokenizer).get_vocab_size()) <= 1 << 16 else 4
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = scratch.save(x.mapInArrow(pieces_of(tokenizer, end, capacity, width),
                                     "id long, piece int, start long, length long, ids binary, ids_crc32 long, task int, rank long"),
                        "pieces")
    per_task = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, capacity))
    w = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "task", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("before"))
    keyed = rows.select("id", "piece", "start", "length", "ids_crc32", "task", "rank").join(before, ["length", "task"])
    out = keyed.mapInArrow(placed_by(table), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, task int, rank long")
    return Packed(out, rows, id_col, width)
