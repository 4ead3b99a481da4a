"""Token-id files as wavelet matrices.

Documents are encoded and laid out in ascending order of their id. A shard is
a run of whole documents; its payload is one compressed block of bytes that
answers, without decoding the rest, which token stands at a position
(``access``), how often a token occurs before one (``rank``) and where its
k-th occurrence is (``select``).

A wavelet matrix over ``b`` bits keeps ``b`` bit-planes. The plane of the
highest bit lists that bit of every token in text order; then tokens are
ordered by the bit, zeros first, stably, and the next plane lists the next bit
in the new order. With the number of ones before any place of a plane, a
position is followed from plane to plane.

Payload, little-endian: magic ``CGW1``; tokens, documents (u64), planes (u32);
zstd frames with their sizes (u32) for document ids (i64), document ends
(u64), and for each plane its zeros (u64), the ones before every block (u64)
and its blocks. A block is ``BLOCK`` bits, a zstd frame of its own. The count
of ones in a block is checked on reading it in full.

Payloads are stored as the binary column of a Parquet table, one row per
shard, so they live wherever Spark writes, commits and retries included.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartograph.llm.common import Scratch, parts_for
from cartograph.llm.tokens import encoder, runs

MAGIC = b"CGW1"
#: Bits of one separately compressed block of a plane.
BLOCK = 1 << 16
#: Tokens after which a shard ends (with the document that reaches them).
SHARD_TOKENS = 2 << 20
LEVEL = 1


def frame(a: np.ndarray, c: zstandard.ZstdCompressor) -> bytes:
    data = c.compress(a.tobytes())
    return struct.pack("<I", len(data)) + data


def build(tokens: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray) -> bytes:
    """Payload of a shard: ``tokens`` of documents ``doc_ids`` (0 stands for a
    null id, see :func:`write`) that end before ``ends``."""
    planes = max(1, int(tokens.max()).bit_length() if len(tokens) else 1)
    c = zstandard.ZstdCompressor(level=LEVEL)
    out = [MAGIC, struct.pack("<QQI", len(tokens), len(ends), planes), frame(doc_ids.astype("<i8"), c),
           frame(ends.astype("<u8"), c)]
    a = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    for bit in reversed(range(planes)):
        ones = (a & a.dtype.type(1 << bit)) != 0
        packed = np.packbits(ones, bitorder="little")
        blocks = [packed[i:i + BLOCK // 8] for i in range(0, len(packed), BLOCK // 8)]
        count = np.array([int(np.bitwise_count(b).sum()) for b in blocks], np.uint64)
        before = np.concatenate(([0], np.cumsum(count))).astype("<u8")
        out += [struct.pack("<Q", len(a) - int(before[-1])), frame(before, c), *(frame(b, c) for b in blocks)]
        # places, not masks: a random mask costs a wrong branch a token
        a = np.concatenate((a[np.flatnonzero(~ones)], a[np.flatnonzero(ones)]))
    return b"".join(out)


class Matrix:
    """Reader of a payload. Blocks are decompressed when first touched."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token shard")
        self.data, self.unpack = memoryview(payload), zstandard.ZstdDecompressor()
        self.n, docs, self.planes = struct.unpack_from("<QQI", payload, 4)
        at = 24
        doc_ids, at = self._frame(at)
        ends, at = self._frame(at)
        self.doc_ids, self.ends = np.frombuffer(doc_ids, "<i8"), np.frombuffer(ends, "<u8").astype(np.int64)
        self.zeros, self.before, self.at, self.cache = [], [], [], {}
        for _ in range(self.planes):
            self.zeros.append(struct.unpack_from("<Q", payload, at)[0])
            before, at = self._frame(at + 8)
            self.before.append(np.frombuffer(before, "<u8").astype(np.int64))
            places = []
            for _ in range(-(-self.n // BLOCK)):
                places.append(at)
                at += 4 + struct.unpack_from("<I", payload, at)[0]
            self.at.append(places)

    def _frame(self, at: int) -> tuple[bytes, int]:
        size = struct.unpack_from("<I", self.data, at)[0]
        return self.unpack.decompress(self.data[at + 4:at + 4 + size]), at + 4 + size

    def _bits(self, plane: int, block: int) -> np.ndarray:
        if (plane, block) not in self.cache:
            self.cache[plane, block] = np.unpackbits(np.frombuffer(self._frame(self.at[plane][block])[0], np.uint8),
                                                     bitorder="little")
        return self.cache[plane, block]

    def _ones(self, plane: int, i: int) -> int:
        """Ones of a plane before place ``i``."""
        block, rest = divmod(i, BLOCK)
        return int(self.before[plane][block]) + (int(self._bits(plane, block)[:rest].sum()) if rest else 0)

    def access(self, i: int) -> int:
        """Token at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p in range(self.planes):
            bit = int(self._bits(p, i // BLOCK)[i % BLOCK])
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if bit else i - ones
            token = token << 1 | bit
        return token

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Places of ``token`` among the first ``i`` in the last order."""
        lo, hi = 0, i
        for p in range(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (self.zeros[p] + a, self.zeros[p] + b) if token >> self.planes - 1 - p & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before position ``i`` (all of them: None)."""
        if token >> self.planes:
            return 0
        lo, hi = self._range(token, self.n if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Position of the ``k``-th occurrence (from 0) of ``token``."""
        lo, hi = self._range(token, self.n) if not token >> self.planes else (0, 0)
        if not 0 <= k < hi - lo:
            raise IndexError(k)
        i = lo + k
        for p in reversed(range(self.planes)):
            bit = token >> self.planes - 1 - p & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Place of the ``k``-th ``bit`` of a plane."""
        ones = self.before[plane]
        count = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        block = int(np.searchsorted(count, k, side="right")) - 1
        bits = self._bits(plane, block)[:min(BLOCK, self.n - block * BLOCK)]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(count[block])])

    def tokens(self) -> np.ndarray:
        """All tokens in text order, from the last plane back to the first."""
        a = np.zeros(self.n, np.uint16 if self.planes <= 16 else np.uint32)
        for p in reversed(range(self.planes)):
            parts = [np.frombuffer(self._frame(at)[0], np.uint8) for at in self.at[p]]
            ones = np.unpackbits(np.concatenate(parts or [np.zeros(0, np.uint8)]), bitorder="little")[:self.n].astype(bool)
            if self.n - int(ones.sum()) != self.zeros[p]:
                raise ValueError("plane and its count differ")
            up = np.empty_like(a)
            up[np.flatnonzero(~ones)] = a[:self.zeros[p]]
            up[np.flatnonzero(ones)] = a[self.zeros[p]:] | a.dtype.type(1 << self.planes - 1 - p)
            a = up
        return a


def shards_of(path: str, end: int, shard_tokens: int):
    """mapInArrow: (id, text) in order to payloads."""
    def run(batches):
        encode, part, number = encoder(path, end), TaskContext.get().partitionId(), 0
        ids, tokens, size = [], [], 0

        def shard():
            nonlocal ids, tokens, size, number
            ends = np.cumsum([len(t) for t in tokens], dtype=np.int64)
            nulls = [i for i, d in enumerate(ids) if d is None]
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()),
                 pa.array([nulls], pa.list_(pa.int32())),
                 pa.array([build(np.concatenate(tokens), np.array([d or 0 for d in ids], np.int64), ends)], pa.binary())],
                names=["part", "number", "n_tokens", "null_ids", "payload"])
            ids, tokens, size, number = [], [], 0, number + 1
            return row

        for own, texts in runs(batches):
            for doc, t in zip(own, encode.batch(texts)):
                ids.append(doc)
                tokens.append(t)
                size += len(t)
                if size >= shard_tokens:
                    yield shard()
        if ids:
            yield shard()
    return run


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 0,
          shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the token shards of ``docs`` to the table ``path``.

    Rows ``(part, number, n_tokens, null_ids, payload)``: shards in order of
    (part, number) hold the documents in ascending order of id, null ids first;
    ``null_ids`` lists a shard's documents whose id is null. Equal ids are in
    order of their text. A null text counts as empty. Documents are dealt by
    ranges of the id, and of the text among equal ids, into parts of about 64
    MB of text.
    """
    x = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = parts_for(x, F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    x.repartitionByRange(n, "id", F.xxhash64("text")).sortWithinPartitions("id", "text") \
        .mapInArrow(shards_of(tokenizer, end, shard_tokens),
                    "part int, number int, n_tokens long, null_ids array<int>, payload binary") \
        .write.parquet(path)


def documents_of(digest: bool):
    """mapInArrow: payloads to one row per document, with its ids or their checksum."""
    def run(batches):
        for b in batches:
            for part, number, nulls, payload in zip(*(b.column(c).to_pylist() for c in ("part", "number", "null_ids", "payload"))):
                m = Matrix(payload)
                tokens, starts = m.tokens().astype("<u4"), np.concatenate(([0], m.ends[:-1]))
                ids = m.doc_ids.tolist()
                for i in nulls:
                    ids[i] = None
                own = [tokens[s:e] for s, e in zip(starts, m.ends)]
                last = pa.array([zlib.crc32(t) for t in own], pa.int64()) if digest else pa.array([t.tobytes() for t in own], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), pa.array([number] * len(ids), pa.int32()), pa.array(ids, pa.int64()),
                     pa.array(starts, pa.int64()), pa.array(m.ends - starts, pa.int64()), last],
                    names=["part", "number", "id", "start", "n_tokens", "ids_crc32" if digest else "ids"])
    return run


def read(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of the shards at ``path``: ``(id, start, n_tokens, ids)`` with
    the ids as little-endian 32-bit integers; ``digest`` replaces ``ids`` by
    ``ids_crc32``. ``start`` counts the tokens of all documents before it: the
    tokens before it in its shard plus the sizes of the shards before, added up
    part by part and then within a part."""
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "number", "n_tokens")
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")) \
        .select("part", F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("parts"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("shards", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(parts, "part") \
        .select("part", "number", (F.col("parts") + F.col("shards")).alias("first"))
    rows = shards.select("part", "number", "null_ids", "payload").mapInArrow(
        documents_of(digest),
        f"part int, number int, id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")
    return rows.join(first, ["part", "number"]).withColumn("start", F.col("first") + F.col("start")) \
        .select("id", "start", "n_tokens", "ids_crc32" if digest else "ids")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the shards to the shared folder and return what reading them back
    gives: ``(<id>, start, n_tokens, ids_crc32)``, one row per document."""
    scratch = Scratch(docs.sparkSession, "tokens")
    write(docs, f"{scratch.path}/shards", tokenizer, id_col, text_col)
    return read(docs.sparkSession, f"{scratch.path}/shards", digest=True).withColumnRenamed("id", id_col)

