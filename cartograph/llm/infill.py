"""Fill-in-the-middle: texts cut in three at unit boundaries and reordered.

A text is cut into prefix, middle and suffix between its units (lines or
sentences), and written as ``<P>prefix<S>suffix<M>middle`` (psm),
``<S>suffix<P>prefix<M>middle`` (spm) or left as it is (plain).

Boundaries are found with a wavelet matrix over the character classes of a
batch of texts, laid end to end as their UTF-8 bytes: line end, the three sentence
ends, a byte that continues a character, and any other. Three bit-planes keep
the classes; with the ones before every 512 bits of a plane, ``rank`` counts
a class before any place. A unit ends after a byte of some classes, so the
boundaries before a place are the sum of those classes' ranks, and the
characters before it are the bytes less the rank of the continuing ones. The
k-th boundary is one ``select`` where one class ends units (lines), and a
bisection on the summed ranks where several do (sentences). Every step is
taken for all texts of the batch at once.

Spark hands texts over as Arrow batches (bounded in rows and bytes, a longer
text alone); only the cuts come back, and the output is put together by string
functions. A lost executor costs the batches it had.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
OTHER, CONTINUES, LINE, STOP, ASKS, SHOUTS = range(6)
#: Classes whose bytes end a unit.
UNITS = {"lines": (LINE,), "sentences": (LINE, STOP, ASKS, SHOUTS)}
PLANES = 3
#: Bits between two stored counts of a plane.
STEP = 512


def class_table() -> np.ndarray:
    """Class of every byte."""
    table = np.zeros(256, np.uint8)
    table[0x80:0xC0] = CONTINUES
    for char, kind in (("\n", LINE), (".", STOP), ("?", ASKS), ("!", SHOUTS)):
        table[ord(char)] = kind
    return table


CLASS = class_table()


class ClassMatrix:
    """Wavelet matrix over the classes of ``data`` (bytes as uint8)."""

    def __init__(self, data: np.ndarray):
        self.n, self.bits, self.before, self.zeros = len(data), [], [], []
        at = CLASS[data]
        for plane in reversed(range(PLANES)):
            ones = (at >> plane & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            # whole steps, and one byte more so that place n may be asked
            packed = np.concatenate((packed, np.zeros(STEP // 8 - len(packed) % (STEP // 8), np.uint8)))
            count = np.bitwise_count(packed).reshape(-1, STEP // 8).sum(axis=1, dtype=np.int64)
            self.bits.append(packed)
            self.before.append(np.concatenate(([0], np.cumsum(count))))
            self.zeros.append(self.n - int(self.before[-1][-1]))
            at = np.concatenate((at[~ones], at[ones]))

    def _ones(self, p: int, i: np.ndarray) -> np.ndarray:
        """Ones of plane ``p`` before the places ``i``."""
        word = self.bits[p].reshape(-1, STEP // 8).view("<u8")
        block, rest = np.divmod(i, STEP)
        # bits of each of the block's words that lie before the place
        inside = np.clip(rest[:, None] - np.arange(0, STEP, 64), 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, ~np.uint64(0), (np.uint64(1) << (inside & np.uint64(63))) - np.uint64(1))
        return self.before[p][block] + np.bitwise_count(word[block] & mask).sum(axis=1, dtype=np.int64)

    def _follow(self, kind: int, i: np.ndarray) -> np.ndarray:
        """Places after the last plane of class ``kind``'s bytes before ``i``,
        counted from the start of the last order."""
        for p in range(PLANES):
            ones = self._ones(p, i)
            i = self.zeros[p] + ones if kind >> PLANES - 1 - p & 1 else i - ones
        return i

    def rank(self, kind: int, i) -> np.ndarray:
        """Bytes of class ``kind`` before the places ``i``."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        return self._follow(kind, i) - self._follow(kind, np.zeros(1, np.int64))

    def select(self, kind: int, k) -> np.ndarray:
        """Places of the ``k``-th bytes (from 0) of class ``kind``; they must exist."""
        i = self._follow(kind, np.zeros(1, np.int64)) + np.atleast_1d(np.asarray(k, np.int64))
        for p in reversed(range(PLANES)):
            bit = kind >> PLANES - 1 - p & 1
            i = self._place(p, bit, i - self.zeros[p] if bit else i)
        return i

    def _place(self, p: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the ``k``-th ``bit``s of plane ``p``."""
        ones = self.before[p]
        count = ones if bit else np.arange(len(ones)) * STEP - ones
        block = np.searchsorted(count, k, side="right") - 1
        own = np.unpackbits(self.bits[p].reshape(-1, STEP // 8)[block], axis=1, bitorder="little")
        nth = np.cumsum(own == bit, axis=1, dtype=np.int16)
        return block * STEP + (nth <= (k - count[block])[:, None]).sum(axis=1)

    def boundaries(self, kinds: tuple[int, ...], i) -> np.ndarray:
        """Unit ends before the places ``i``: the ranks of ``kinds`` combined."""
        return sum(self.rank(kind, i) for kind in kinds)

    def characters(self, i) -> np.ndarray:
        """Characters that start before the places ``i``."""
        return np.atleast_1d(np.asarray(i, np.int64)) - self.rank(CONTINUES, i)

    def after_unit(self, kinds: tuple[int, ...], k, low, high) -> np.ndarray:
        """Place after the ``k``-th unit end (from 1) of the whole, known to
        lie in ``(low, high]``."""
        k = np.asarray(k, np.int64)
        if len(kinds) == 1:
            return self.select(kinds[0], k - 1) + 1
        low, high = np.array(low, np.int64), np.array(high, np.int64)
        while (high - low > 1).any():  # boundaries before low < k <= boundaries before high
            mid = (low + high) >> 1
            enough = self.boundaries(kinds, mid) >= k
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        return high


def cuts(data: np.ndarray, ends: np.ndarray, one: np.ndarray, two: np.ndarray, kinds: tuple[int, ...]):
    """Units, and characters of prefix and middle, of texts laid end to end.

    The prefix ends after ``min(one % (n + 1), two % (n + 1))`` of the ``n``
    units, the middle after the greater."""
    m = ClassMatrix(data)
    starts = np.concatenate(([0], ends[:-1]))
    known, upto = m.boundaries(kinds, starts), m.boundaries(kinds, ends)
    # the rest after the last unit end is a unit as well
    last = np.isin(CLASS[data[np.maximum(ends - 1, 0)]], kinds) if len(data) else np.zeros(len(ends), bool)
    whole = upto - known
    n = whole + ((ends > starts) & ~last)
    a, b = one % (n + 1), two % (n + 1)
    places = []
    for k in (np.minimum(a, b), np.maximum(a, b)):
        place = np.where(k > 0, ends, starts)
        inner = np.flatnonzero((k > 0) & (k <= whole))
        if len(inner):
            place[inner] = m.after_unit(kinds, known[inner] + k[inner], starts[inner], ends[inner])
        places.append(m.characters(place))
    begin = m.characters(starts)
    return n, places[0] - begin, places[1] - places[0]


#: Bytes of one class matrix; a longer text has one of its own.
MATRIX = 4 << 20


def cuts_column(text: Column, one: Column, two: Column, unit: str) -> Column:
    kinds = UNITS[unit]

    @F.arrow_udf("struct<n:bigint,prefix:bigint,middle:bigint>")
    def find(raw: pa.Array, one: pa.Array, two: pa.Array) -> pa.Array:
        raw = raw.cast(pa.large_binary())
        offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
        data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
        a, b = one.to_numpy(zero_copy_only=False), two.to_numpy(zero_copy_only=False)
        found, i = [], 0
        while i < len(raw):
            j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + MATRIX, side="right")) - 1)
            own = slice(i, j)
            found.append(cuts(data[offsets[i]:offsets[j]], offsets[i + 1:j + 1] - offsets[i], a[own], b[own], kinds))
            i = j
        parts = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in parts], ["n", "prefix", "middle"])
    return find(text, one, two)


def transform(docs: DataFrame, unit: str = "lines", seed: int = 7, plain_percent: int = 0, spm_percent: int = 50,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``(<id>, n, form, prefix_chars, middle_chars, output)``.

    ``n`` counts the units (``lines``: ``[^\\n]*\\n|[^\\n]+``; ``sentences``: the
    same with ``.``, ``?`` and ``!`` as ends besides the line end). The first
    four 8-digit groups of the SHA-256 of ``<seed>:<id>`` give the two cuts,
    whether the text stays plain and which form it takes. A text that is empty
    or holds one of the markers is plain; the lengths, in characters, are null
    then. A null text counts as empty, a null id as the empty string. Repeated
    rows are rows like any other (and equal); an empty table gives no rows.
    Other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(F.col("digest"), 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    x = docs.select(F.col(id_col).alias("id"), text.alias("text"), digest.alias("digest"))
    x = x.select("id", "text", *[v.alias(f"h{i + 1}") for i, v in enumerate(h)])
    x = x.withColumn("cut", cuts_column(F.col("text"), F.col("h1"), F.col("h2"), unit))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.col("text") == "") | marked | (F.col("h3") % 100 >= 100 - plain_percent)
    x = x.withColumn("form", F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm"))
    cut = lambda at, n: F.substring(F.col("text"), at.cast("int"), n.cast("int"))
    one, two = F.col("cut.prefix"), F.col("cut.middle")
    prefix, middle = cut(F.lit(1), one), cut(one + 1, two)
    suffix = cut(one + two + 1, F.length("text"))
    output = F.when(F.col("form") == "plain", F.col("text")) \
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)) \
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    shown = lambda c: F.when(F.col("form") != "plain", c)
    return x.select(F.col("id").alias(id_col), F.col("cut.n").alias("n"), "form", shown(one).alias("prefix_chars"),
                    shown(two).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that :func:`transform` was given, from its output and form
    (null texts come back empty). Only a plain text can hold a marker twice, so
    the markers cut the output into its parts."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    whole = lambda *order: F.transform(F.array(parts), lambda p: F.concat(*[F.get(p, F.lit(i)) for i in order]))[0]
    return F.when(form == "plain", output).when(form == "psm", whole(1, 3, 2)).otherwise(whole(2, 3, 1))


def oracle(docs: str = "documents", seed: int = 7) -> str:
    """DuckDB SQL for the rows of the query over the lines of table ``docs``."""
    h = ", ".join(f"CAST('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}"
                  for i in range(4))
    return f"""
WITH x AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, {h} FROM {docs}),
k AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a,
             greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= 100 THEN 'plain'
                  WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
                   ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
