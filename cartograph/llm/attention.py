"""Quality classifier by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each passage is encoded: the
frequencies of its bytes and a few word statistics, then a learned layer. Only
whole documents are labelled; gated attention learns which passages tell
quality, and the score is that of the attention-weighted mean of the passages:

    h = tanh(x W),  a = softmax over the bag of w . (tanh(h V) * sigmoid(h U)),
    score = sigmoid(c . sum(a h) + b)

The model is fitted on a bounded sample of labelled documents
(``MOST_FIT``, in order of a hash of their id and text, with ``MOST_PASSAGES``
passages of each); every text is scored whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 128
EXTRA = 5
WIDTH = 256 + EXTRA
HIDDEN, GATE = 24, 16
#: Most labelled documents that the model is fitted on, and most passages of one
#: of them, evenly spread over its text. Scores are of all passages.
MOST_FIT = 4000
MOST_PASSAGES = 64
ROUNDS = 150
RATE = 0.02
DECAY = 1e-4
SEED = 17


def encode(text: str | None) -> np.ndarray:
    """One row per passage: square roots of the byte shares, mean word length,
    share of distinct words, of words equal to the one before, of capitals
    among letters, and filling. A text without words is one row of zeros."""
    words = text.split() if text else []
    if not words:
        return np.zeros((1, WIDTH), np.float32)
    out = np.empty((-(-len(words) // PASSAGE), WIDTH), np.float32)
    for k in range(len(out)):
        p = words[k * PASSAGE:(k + 1) * PASSAGE]
        joined = " ".join(p)
        raw = np.frombuffer(joined.encode("utf-8", "replace"), np.uint8)
        count = np.bincount(raw, minlength=256)
        capitals, small = count[65:91].sum(), count[97:123].sum()
        out[k, :256] = np.sqrt(count / len(raw))
        out[k, 256:] = (min(len(joined) / len(p), 40) / 10, len(set(p)) / len(p),
                        sum(map(str.__eq__, p[1:], p)) / len(p), capitals / max(1, capitals + small), len(p) / PASSAGE)
    return out


@dataclass
class Model:
    """Weights; ``mean`` and ``scale`` standardise the encoded passages."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    v: np.ndarray
    u: np.ndarray
    a: np.ndarray
    c: np.ndarray
    b: np.ndarray

    def score(self, x: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of bags of passages; ``starts`` is the first row of each."""
        return forward(self, (x - self.mean) * self.scale, starts)[0]


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def forward(m: Model, x: np.ndarray, starts: np.ndarray):
    h = np.tanh(x @ m.w)
    tv, su = np.tanh(h @ m.v), sigmoid(h @ m.u)
    logit = (tv * su) @ m.a
    sizes = np.diff(np.append(starts, len(x)))
    weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
    weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
    z = np.add.reduceat(weight[:, None] * h, starts, axis=0)
    return sigmoid(z @ m.c + m.b[0]), h, tv, su, weight, z, sizes


def fit(x: np.ndarray, starts: np.ndarray, label: np.ndarray, rounds: int = ROUNDS) -> Model:
    """Adam on the cross-entropy of the document labels, all bags at once."""
    rng = np.random.default_rng(SEED)
    mean, scale = x.mean(0), 1 / (x.std(0) + 0.02)
    x = ((x - mean) * scale).astype(np.float32)
    init = lambda *s: (rng.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    m = Model(mean, scale, init(WIDTH, HIDDEN), init(HIDDEN, GATE), init(HIDDEN, GATE), init(GATE), init(HIDDEN),
              np.zeros(1, np.float32))
    names = ("w", "v", "u", "a", "c", "b")
    one, two = {n: 0.0 for n in names}, {n: 0.0 for n in names}
    for t in range(1, rounds + 1):
        s, h, tv, su, weight, z, sizes = forward(m, x, starts)
        err = (s - label) / len(label)
        dz = np.repeat(err[:, None] * m.c, sizes, axis=0)
        dw = (dz * h).sum(1)  # by the weights, then through their softmax
        dlogit = weight * (dw - np.repeat(np.add.reduceat(weight * dw, starts), sizes))
        dtv, dsu = dlogit[:, None] * m.a * su * (1 - tv ** 2), dlogit[:, None] * m.a * tv * su * (1 - su)
        dh = weight[:, None] * dz + dtv @ m.v.T + dsu @ m.u.T
        grad = {"w": x.T @ (dh * (1 - h ** 2)), "v": h.T @ dtv, "u": h.T @ dsu, "a": (tv * su).T @ dlogit,
                "c": z.T @ err, "b": np.array([err.sum()])}
        for n in names:
            g = grad[n] + DECAY * getattr(m, n)
            one[n], two[n] = 0.9 * one[n] + 0.1 * g, 0.999 * two[n] + 0.001 * g * g
            step = RATE * (one[n] / (1 - 0.9 ** t)) / (np.sqrt(two[n] / (1 - 0.999 ** t)) + 1e-8)
            setattr(m, n, (getattr(m, n) - step).astype(np.float32))
    return m


def encoded_column(text: Column, most: int) -> Column:
    """A text's passages as the bytes of their float32 rows; of more than
    ``most``, that many at even distances."""
    @F.arrow_udf("binary")
    def passages(raw: pa.Array) -> pa.Array:
        out = []
        for t in raw:
            x = encode(t.as_py())
            out.append(x[np.arange(min(most, len(x))) * len(x) // min(most, len(x))].tobytes())
        return pa.array(out, pa.binary())
    return passages(text)


def sample(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT, passages: int = MOST_PASSAGES) -> DataFrame:
    """``(id, label, t, x)``: at most ``most`` labelled documents with at most
    ``passages`` encoded passages each, in order of a hash of the id and then of
    the text ``t``. Rows that repeat an id and text count once, so the bound
    holds however often an id repeats; passages are encoded on the executors
    before anything is shuffled, so a row is bounded as well."""
    chosen = labels.where(F.col("label").isin(0, 1)).select("id", F.col("label").cast("int").alias("label")) \
        .distinct().orderBy(F.xxhash64("id"), "id", "label").limit(most)
    rows = docs.join(F.broadcast(chosen), "id")  # ``most`` rows at most are broadcast
    return rows.select("id", "label", F.xxhash64("text").alias("t"), encoded_column(F.col("text"), passages).alias("x")) \
        .dropDuplicates(["id", "label", "t"]).orderBy(F.xxhash64("id"), "id", "t", "label").limit(most)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_FIT) -> Model | None:
    """Model of ``docs(id, text)`` by ``labels(id, label)``, fitted on
    :func:`sample`. None if there are no such documents."""
    got = sample(docs, labels, most).collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.id, r.x, r.label))
    bags = [np.frombuffer(r.x, np.float32).reshape(-1, WIDTH) for r in got]
    starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
    return fit(np.concatenate(bags), starts, np.array([r.label for r in got], np.float32))


def score_column(model: Model | None, text: Column) -> Column:
    """Score (0 to 1) of a whole text; 0.5 where nothing was labelled."""
    @F.arrow_udf("double")
    def mil_score(raw: pa.Array) -> pa.Array:
        if model is None:
            return pa.array([0.5] * len(raw), pa.float64())
        out, bags, rows = [], [], 0
        for i, t in enumerate(raw):
            bags.append(encode(t.as_py()))
            rows += len(bags[-1])
            if rows > 4096 or i == len(raw) - 1:  # bounds the memory of a batch of long texts
                starts = np.cumsum([0] + [len(b) for b in bags[:-1]])
                out += model.score(np.concatenate(bags), starts).astype(float).tolist()
                bags, rows = [], 0
        return pa.array(out, pa.float64())
    return mil_score(text)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: crc32 of the id as text leaves 2
    modulo 4. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            label_col: str = "quality", threshold: float = 0.7) -> DataFrame:
    """One row per document: ``(<id>, held_out, score, predicted)``.

    Learns from the labelled documents that are not held out. A null text
    counts as empty and is scored like one. Documents without a label, with a
    null id and repeated rows are scored like any other; a null label teaches
    nothing. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    model = train(own, known.where(~held_out(F.col("id"))))
    scored = own.withColumn("score", score_column(model, F.col("text")))
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score",
                         F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
