"""Toxicity: averaged subword embeddings under a linear softmax."""

from __future__ import annotations

import zlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, as_bytes, hash_order, in_train

# Labelled rows per class that the fit may use: a documented bound.
MAX_PER_CLASS = 2000
BUCKETS = 1 << 18
GRAMS = (3, 4, 5)
DIM = 8
# Passes over the texts, more on few of them for at least so many minibatches.
EPOCHS, UPDATES, BATCH, RATE = 6, 300, 64, 0.3
# Words per window, every half window; averages are over this many subwords at least.
WINDOW, LEAST_SUBWORDS = 12, 40
CACHE_WORDS = 200_000
SEED = 11


def core_of(word: bytes) -> str:
    """A word without its case and the ASCII signs around it."""
    return word.decode("utf-8", "replace").lower().strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def subwords(core: str) -> list[int]:
    """Buckets of a core's character n-grams, its ends marked, and of the core
    itself."""
    if not core:
        return []
    marked = f"<{core}>"
    if marked.isascii():  # then characters are bytes
        raw = marked.encode()
        grams = {raw[i:i + n] for n in GRAMS for i in range(len(raw) - n + 1)}
        grams.add(raw)
    else:
        grams = {marked[i:i + n].encode() for n in GRAMS for i in range(len(marked) - n + 1)}
        grams.add(marked.encode())
    return [b % BUCKETS for b in map(zlib.crc32, grams)]


class _Cache(dict):
    """What a function gives for each word; emptied when it has grown."""

    def __init__(self, of, limit: int):
        super().__init__()
        self.of, self.limit = of, limit

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.of(word)
        return value


def _words(text: bytes) -> list[bytes]:
    """A text's words; one said several times in a row counts once."""
    words = text.split()
    return [w for w, before in zip(words, [None, *words], strict=False) if w != before]


def bag(text: bytes, cache: _Cache) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of a whole text's subwords."""
    found = [b for w in _words(text) for b in cache[w]]
    buckets, n = np.unique(np.array(found, np.int64), return_counts=True)
    return buckets, n / max(1, len(found))


class Model:
    """Scores whole texts. ``gain`` holds, per bucket, what its vector adds to
    the logit difference of the softmax's two classes. A text's score is
    calibrated from the logit of all its subwords' average, the largest one of
    its windows of ``WINDOW`` words, and their number."""

    def __init__(self, gain: np.ndarray, center=0.0, scale=1.0, weight=(0.0, 0.0, 0.0), bias: float = 0.0):
        self.gain = gain.astype(np.float32)
        self.center, self.scale, self.weight, self.bias = center, scale, np.array(weight), float(bias)

    @cached_property
    def gains(self) -> list[float]:
        """``gain`` as a list, as single look-ups are faster there."""
        return self.gain.tolist()

    @cached_property
    def cores(self) -> _Cache:
        """Words that differ in case and signs only share what is found here."""
        return _Cache(self.core, CACHE_WORDS)

    def word(self, word: bytes) -> complex:
        return self.cores[core_of(word)]

    def core(self, core: str) -> complex:
        """Gain of a core's subwords (real part) and their number (imaginary)."""
        found = subwords(core)
        return complex(sum(map(self.gains.__getitem__, found)), len(found))

    def logits(self, texts: list[bytes], cache: _Cache) -> np.ndarray:
        """(texts, 3): average logit, largest window's logit, log of windows."""
        words = [_words(t) for t in texts]
        n = np.array([len(w) for w in words], np.int64)
        sums = np.zeros(n.sum() + 1, complex)
        sums[1:] = np.cumsum(np.fromiter((cache[w] for ws in words for w in ws), complex, n.sum()))
        end = np.cumsum(n)
        out = np.zeros((len(texts), 3))
        for i, (a, b) in enumerate(zip(end - n, end, strict=True)):
            start = np.arange(a, max(a + 1, b - WINDOW // 2), WINDOW // 2)
            part = sums[np.minimum(start + WINDOW, b)] - sums[start]
            whole = sums[b] - sums[a]
            out[i] = (whole.real / max(1, whole.imag), (part.real / np.maximum(LEAST_SUBWORDS, part.imag)).max(),
                      np.log(len(start)))
        return out

    def scores(self, texts: list[bytes], cache: _Cache) -> np.ndarray:
        z = (self.logits(texts, cache) - self.center) / self.scale @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def embed(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """Train embeddings and softmax jointly (Adagrad, minibatches of texts, the
    classes weighted alike); gives the gain of every bucket."""
    rng = np.random.default_rng(SEED)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) * 1e-3  # what is never trained stays silent
    soft = rng.uniform(-1, 1, (2, DIM)) / DIM
    bias = np.zeros(2)
    seen_e, seen_w, seen_b = np.full(emb.shape, 1e-12), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    for _ in range(max(EPOCHS, -(-UPDATES * BATCH // len(y)))):
        order = rng.permutation(len(y))
        for at in range(0, len(order), BATCH):
            rows = [i for i in order[at:at + BATCH] if len(bags[i][0])]
            if not rows:
                continue
            idx, share = (np.concatenate([bags[i][k] for i in rows]) for k in (0, 1))
            n = np.array([len(bags[i][0]) for i in rows])
            mean = np.add.reduceat(emb[idx] * share[:, None], np.cumsum(n) - n, axis=0)
            z = mean @ soft.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            p *= weight[rows][:, None] / len(rows)
            one, back = np.unique(idx, return_inverse=True)
            part = np.repeat(p @ soft, n, axis=0) * share[:, None]
            ge = np.stack([np.bincount(back, part[:, k], len(one)) for k in range(DIM)], axis=1)
            gw, gb = p.T @ mean, p.sum(axis=0)
            for value, seen, grad, where in ((emb, seen_e, ge, one), (soft, seen_w, gw, slice(None)), (bias, seen_b, gb, slice(None))):
                seen[where] += grad * grad
                value[where] -= RATE * grad / np.sqrt(seen[where])
    return emb @ (soft[1] - soft[0])


def calibrate(gain: np.ndarray, texts: list[bytes], y: np.ndarray, prior: float) -> Model:
    """Logistic regression of the label on a text's logits (Newton steps),
    weighted to the true share of the classes."""
    model = Model(gain)
    z = model.logits(texts, _Cache(model.word, CACHE_WORDS))
    center, scale = z.mean(axis=0), z.std(axis=0) + 1e-9
    x = np.hstack([(z - center) / scale, np.ones((len(z), 1))])
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([0.1, 0.1, 0.1, 1e-6])
        step = np.linalg.solve((x * (share * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (share * (y - p)) - ridge @ w)
        w += step * min(1.0, 4 / (np.abs(step).max() + 1e-12))
    return Model(gain, center, scale, w[:3], w[3])


def fit(texts: list[bytes], y: np.ndarray, prior: float) -> Model:
    """Embeddings from three texts of four, calibration from the fourth. With
    less than both classes in either part, every score is the smoothed share."""
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    aside = np.array([zlib.crc32(t) % 4 == 0 for t in texts], bool)
    if len({*zip(y.tolist(), aside.tolist(), strict=True)}) < 4:
        return Model(np.zeros(BUCKETS), bias=np.log(prior / (1 - prior)))
    cache = _Cache(lambda word: subwords(core_of(word)), CACHE_WORDS)
    gain = embed([bag(t, cache) for t, a in zip(texts, aside, strict=True) if not a], y[~aside])
    return calibrate(gain, [t for t, a in zip(texts, aside, strict=True) if a], y[aside], prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on at most ``max_per_class`` labelled texts of each class, in the
    hash order of their ids, held-out ids left out. Rows with null ids, null
    labels or labels other than 0 and 1 are not used; of a repeated id the
    largest label and the smallest text count."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & in_train(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("y")))
    n, n_one = known.agg(F.count("*"), F.sum("y")).first()
    order = hash_order(F.col("id"))
    chosen = (known.where("y = 1").orderBy(order, "id").limit(max_per_class)
              .unionByName(known.where("y = 0").orderBy(order, "id").limit(max_per_class)))
    text = docs.select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"))

    rows = (text.join(F.broadcast(chosen), "id")  # at most 2 * max_per_class rows, one an id
            .groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y")).select("text", "y")
            .orderBy("text", "y").collect())
    return fit([bytes(r["text"]) for r in rows], np.array([r["y"] for r in rows], np.int64), ((n_one or 0) + 1) / (n + 2))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, score) per input row, of whole texts; a null, empty or wordless
    text gets the score of an empty bag. Repeated rows and null ids pass
    through; extra columns are ignored; an empty table gives no rows."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        cache = _Cache(held.value.word, CACHE_WORDS)
        return lambda texts: [pa.array(held.value.scores(texts, cache))]

    return (annotate(docs.select(id_col, text_col), text_col, [("score", T.DoubleType())], make)
            .select(id_col, "score"))
