"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, as_bytes, hash_order, in_train, text_runs

# Rows the fit may use: a documented bound; all else covers every row.
MAX_POSITIVE, MAX_UNLABELLED = 3000, 5000
STEPS, RATE, L2 = 400, 0.02, 1e-4

# Classes of bytes, by what a reader sees; every other byte of a multi-byte
# character is the last class.
_CLASSES = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\x0b\x0c\r", b"\n",
            b".", b",", b"!?", b"\"'`;:-_", b"|<>{}[]()", b"#$%&*+=@^~/\\", bytes(range(0, 9)) + b"\x7f",
            bytes(range(0xC0, 0x100)), bytes(range(0x80, 0xC0))]
N_CLASSES = len(_CLASSES)
_CLASS_OF = np.full(256, N_CLASSES - 3, np.int64)
for _i, _bytes in enumerate(_CLASSES):
    _CLASS_OF[np.frombuffer(_bytes, np.uint8)] = _i
N_SHAPES = N_CLASSES ** 3
N_STATS = 9
N_FEATURES = N_SHAPES + N_STATS


def _stats(text: bytes) -> list[float]:
    """Length and repetition figures of one text."""
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    n = len(words)
    if not n:
        return [0.0] * N_STATS
    size = sum(map(len, words)) / n
    return [np.log1p(n) / 8, size / 10, len(set(words)) / n, n ** 0.5 * len(set(words)) / n / 20,
            len(set(lines)) / max(1, len(lines)), np.log1p(len(lines)) / 5, min(n / max(1, len(lines)), 200) / 100,
            sum(map(eq, words, words[1:])) / n, 1.0]


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of byte-class trigrams, and the figures of
    ``_stats``, for whole texts. A text without words has zeros only."""
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), size)
    kind = _CLASS_OF[raw]
    out = np.zeros((len(texts), N_FEATURES), np.float32)
    if len(raw) > 2:
        shape = (kind[:-2] * N_CLASSES + kind[1:-1]) * N_CLASSES + kind[2:]
        inside = doc[:-2] == doc[2:]
        count = np.bincount(doc[:-2][inside] * N_SHAPES + shape[inside], minlength=len(texts) * N_SHAPES)
        count = count.reshape(len(texts), N_SHAPES)
        out[:, :N_SHAPES] = np.sqrt(count / np.maximum(1, count.sum(axis=1, keepdims=True)))
    out[:, N_SHAPES:] = [_stats(t) for t in texts]
    return out


class Model:
    """Linear scorer of ``features``; ``score`` estimates P(quality = 1)."""

    def __init__(self, center: np.ndarray, scale: np.ndarray, weight: np.ndarray, bias: float):
        self.weight = (weight / scale).astype(np.float32)
        self.bias = float(bias - (center / scale) @ weight)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weight + self.bias, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, center: np.ndarray, scale: np.ndarray) -> Model:
    """Minimise the non-negative unbiased risk of a linear scorer under the
    logistic loss: ``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``. While
    the second term is negative, the step goes up that term alone. Features are
    taken less ``center`` and by ``scale``; both arrays of them are overwritten.

    Without positives, or without unlabelled rows, every score is the prior."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    flat = np.log(prior / (1 - prior))
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), np.zeros(N_FEATURES), flat)
    p, u = positive, unlabelled
    for x in (p, u):
        x -= center.astype(np.float32)
        x /= scale.astype(np.float32)
    w, m, v = (np.zeros(N_FEATURES + 1) for _ in range(3))
    w[-1] = flat

    def sigmoid(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    for step in range(1, STEPS + 1):
        sp, su = sigmoid(p @ w[:-1].astype(np.float32) + w[-1]), sigmoid(u @ w[:-1].astype(np.float32) + w[-1])
        minus = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
        gp = -prior * (1 - sp) / len(p) - prior * sp / len(p)  # of prior * (R_p(+) - R_p(-))
        gu = su / len(u)
        if minus < 0:
            gp, gu = prior * sp / len(p), -gu
        gp, gu = gp.astype(np.float32), gu.astype(np.float32)
        grad = np.append(gp @ p + gu @ u, gp.sum() + gu.sum()).astype(np.float64)
        grad[:-1] += L2 * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Model(center, scale, w[:-1], w[-1])


def _sample(df: DataFrame) -> np.ndarray:
    """Features of the rows of a bounded table (column ``text``)."""
    def run(batches: Iterator[pa.RecordBatch]):
        for _, texts in text_runs(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in features(texts).astype(np.float16)])], ["x"])
    rows = df.select("text").mapInArrow(run, "x binary").collect()
    if not rows:
        return np.zeros((0, N_FEATURES), np.float32)
    return np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32)


def _moments(text: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the features of all rows (column ``text``)."""
    def run(batches: Iterator[pa.RecordBatch]):
        out = np.zeros(2 * N_FEATURES + 1)
        for _, texts in text_runs(batches):
            x = features(texts).astype(np.float64)
            out += np.concatenate([x.sum(axis=0), (x * x).sum(axis=0), [len(x)]])
        yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

    parts = text.select("text").mapInArrow(run, "s array<double>")
    total = np.zeros(2 * N_FEATURES + 1)
    for r in parts.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect():
        total[r["k"]] = r["s"]
    mean, square = total[:-1].reshape(2, -1) / max(1.0, total[-1])
    return mean, np.sqrt(np.maximum(0, square - mean * mean))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on at most ``max_positive`` trusted positives (label 1) and
    ``max_unlabelled`` documents as unlabelled text, both in the hash order of
    their ids, held-out ids left out; the features' centre and scale are those
    of all documents not held out. The class prior is the share of label 1
    among all labelled training rows (add-one smoothed). Rows with null ids,
    null labels or labels other than 0 and 1 are not used; a repeated label row
    counts once, and of a repeated id's documents the smallest text."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_train(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")))
    n, n_one = known.agg(F.count("*"), F.sum("y")).first()
    text = docs.where(F.col(id_col).isNotNull() & in_train(F.col(id_col))).select(
        F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))
    chosen = known.where("y = 1").orderBy(hash_order(F.col("id")), "id").limit(max_positive).select("id")
    ids = text.select("id").distinct().orderBy(hash_order(F.col("id")), "id").limit(max_unlabelled)
    one = F.min("text").alias("text")  # of a repeated id the smallest text
    positive = _sample(text.join(F.broadcast(chosen), "id").groupBy("id").agg(one))  # at most max_positive rows
    unlabelled = _sample(text.join(F.broadcast(ids), "id").groupBy("id").agg(one))  # at most max_unlabelled rows
    center, deviation = _moments(text)
    return fit(positive, unlabelled, ((n_one or 0) + 1) / (n + 2), center, deviation + 0.02)


def score_quality(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
                  keep: bool = False) -> DataFrame:
    """(id_col, score) per input row, or with ``keep`` all its columns and
    ``score``, of whole texts; null and empty texts get the score of a text
    without words. Repeated rows and null ids pass through; without ``keep``
    extra columns are ignored; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # N_FEATURES numbers

    def make():
        return lambda texts: [pa.array(held.value.score(features(texts)).astype(np.float64))]

    rows = docs if keep else docs.select(id_col, text_col)
    out = annotate(rows, text_col, [("score", T.DoubleType())], make)
    return out if keep else out.select(id_col, "score")
