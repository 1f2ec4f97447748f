"""Mixing sources to target weights by soft domain membership."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulae.session import reuse

from .common import annotate, as_bytes, hash_order, text_runs

# Labelled rows that the classifier's fit may use: a documented bound.
MAX_LABELLED = 4000
BUCKETS = 4096
STEPS, RATE, L2 = 150, 0.05, 1e-4
# Weights of the rates' change beside the gap, one after the other: the last keeps
# a target out of reach from ending in a few documents used a thousand times.
# Passes over the documents at most, and the slope left, as a part of the target's.
EPSILONS, MAX_ROUNDS, TOLERANCE = (1e-2, 1e-3, 1e-4, 1e-6), 200, 1e-9
SEED = 17


def features(texts: list[bytes]) -> np.ndarray:
    """Square roots of the shares of hashed byte trigrams of whole texts."""
    raw = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    out = np.zeros((len(texts), BUCKETS), np.float32)
    if len(raw) > 2:
        gram = ((raw[:-2] * 31 + raw[1:-1]) * 131 + raw[2:]) * 0x9E3779B1 >> 12 & BUCKETS - 1
        inside = doc[:-2] == doc[2:]
        n = np.bincount(doc[:-2][inside] * BUCKETS + gram[inside], minlength=out.size).reshape(out.shape)
        out[:] = np.sqrt(n / np.maximum(1, n.sum(axis=1, keepdims=True)))
    return out


class Classifier:
    """Softmax over domains, from ``features``."""

    def __init__(self, domains: list[str], weight: np.ndarray, bias: np.ndarray):
        self.domains, self.weight, self.bias = domains, weight.astype(np.float32), bias

    def posteriors(self, texts: list[bytes]) -> np.ndarray:
        z = features(texts) @ self.weight + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit(texts: list[bytes], domain: np.ndarray, domains: list[str]) -> Classifier:
    """Multinomial logistic regression (Adam, all rows per step). Without rows,
    all domains are alike."""
    k = len(domains)
    w, m, v = (np.zeros((BUCKETS + 1, k)) for _ in range(3))
    if len(texts):
        x = np.concatenate([features(texts[i:i + 256]) for i in range(0, len(texts), 256)])
        y = np.eye(k)[domain]
        w[-1] = np.log((y.sum(axis=0) + 0.5) / (len(y) + 0.5 * k))
        for step in range(1, STEPS + 1):
            z = x @ w[:-1].astype(np.float32) + w[-1]
            p = np.exp(z - z.max(axis=1, keepdims=True))
            d = (p / p.sum(axis=1, keepdims=True) - y) / len(y)
            g = np.vstack([x.T @ d.astype(np.float32), d.sum(axis=0)]) + L2 * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= RATE * 10 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return Classifier(domains, w[:-1], w[-1])


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], id_col: str = "doc_id", text_col: str = "text",
          domain_col: str = "lang", max_labelled: int = MAX_LABELLED) -> Classifier:
    """Fit on at most ``max_labelled`` rows, in the hash order of their ids: the
    documents that the table ``labelled`` holds, with their ``domain_col`` as
    trusted label. Rows with null ids, or of a domain not listed, are not used."""
    ids = (labelled.select(F.col(id_col).alias("id")).where("id is not null").distinct()
           .orderBy(hash_order(F.col("id")), "id").limit(max_labelled))
    rows = (docs.where(F.col(domain_col).isin(*domains))
            .select(F.col(id_col).alias("id"), as_bytes(F.col(text_col)).alias("text"), F.col(domain_col).alias("domain"))
            .join(F.broadcast(ids), "id").orderBy("id", "text").limit(max_labelled).collect())
    return fit([bytes(r["text"]) for r in rows], np.array([domains.index(r["domain"]) for r in rows], np.int64), domains)


def rates(p: np.ndarray, price: np.ndarray, floor: float) -> np.ndarray:
    """Document rates at the domains' prices: each starts at 1, goes down by its
    memberships' part of them, and is put back to ``floor`` below it."""
    return np.maximum(floor, max(1.0, floor) - p @ price)


def _figures(n: np.ndarray, p: np.ndarray, price: np.ndarray, floor: float) -> np.ndarray:
    """What one pass sums up at given prices: the domains' tokens, sum(n p p')
    of the documents above the floor, and the dual's part of the documents."""
    r = rates(p, price, floor)
    free = max(1.0, floor) - p @ price
    above = free > floor
    dual = np.where(above, r * r / 2, floor * free - floor * floor / 2)
    return np.concatenate([(r * n) @ p, ((p * (n * above)[:, None]).T @ p).ravel(), [dual @ n]])


def newton(figures, gram: np.ndarray, goal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prices, domains' tokens) that minimise gap' inverse(gram) gap, and with
    the last of ``EPSILONS`` as weight the rates' change, sum(n (r - 1)^2):
    damped Newton steps on the dual, which has one variable a domain.
    ``figures(price)`` is one pass. Raises when ``MAX_ROUNDS`` passes do not
    settle it."""
    k = len(goal)
    value, axes = np.linalg.eigh(gram)
    held = value > 1e-10 * max(value.max(), 1e-300)
    white = axes[:, held] / np.sqrt(value[held])  # domains that no document has part in stay out
    x, rounds = np.zeros(white.shape[1]), 0
    slope_goal = TOLERANCE * max(1e-300, np.linalg.norm(white.T @ goal))

    def at(x):
        nonlocal rounds
        if (rounds := rounds + 1) > MAX_ROUNDS:
            raise RuntimeError(f"the mixture's rates did not settle in {MAX_ROUNDS} passes")
        f = figures(white @ x)
        return f[:k], white.T @ f[k:-1].reshape(k, k) @ white, f[-1] + goal @ (white @ x)

    now, curve, dual = at(x)
    for epsilon in EPSILONS:
        slope = epsilon * x - white.T @ (now - goal)
        while np.linalg.norm(slope) > slope_goal:
            step = -np.linalg.solve(curve + epsilon * np.eye(len(x)), slope)
            size, height = 1.0, dual + epsilon * x @ x / 2
            while True:
                y = x + size * step
                there = at(y)
                after = epsilon * y - white.T @ (there[0] - goal)
                gain = there[2] + epsilon * y @ y / 2 - height
                if gain <= 1e-4 * size * (slope @ step) or np.linalg.norm(after) < 0.5 * np.linalg.norm(slope):
                    break
                size /= 4
            x, (now, curve, dual), slope = y, there, after
    return white @ x, now


def solve(members: DataFrame, target: np.ndarray, floor: float = 0.0, total: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prices, expected totals, remaining gap) of least squares: rates r >=
    ``floor`` whose expected domain tokens sum(r n p) come closest to ``target``
    * ``total`` in the norm of the inverse of sum(n p p'), their change from
    the start weighed in lightly (``EPSILONS``). ``members`` has a document's ``n`` tokens and
    posteriors ``p``.

    Each round is one pass of Spark (``newton``). Only sums over the documents
    reach the driver. ``total`` is all tokens, or with a positive floor the
    least one that all floors leave room for."""
    k = len(target)

    def figures(price: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]):
            out = np.zeros(k + k * k + 1)
            for b in batches:
                if b.num_rows:
                    p = np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(-1, k)
                    out += _figures(b.column(0).to_numpy().astype(float), p, price, floor)
            yield pa.RecordBatch.from_arrays([pa.array([out.tolist()], pa.list_(pa.float64()))], ["s"])

        parts = members.select("n", "p").mapInArrow(run, "s array<double>")
        added = parts.select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s")).collect()
        out = np.zeros(k + k * k + 1)
        for r in added:
            out[r["k"]] = r["s"]
        return out

    start = np.zeros(k)
    now = figures(start)[:k]
    if total is None:
        total = now.sum() if floor <= 0 else float(np.max(now[target > 0] / target[target > 0], initial=0.0))
    # Far below any floor's price all documents are above it: the whole sum(n p p').
    gram = figures(np.full(k, -2 * max(1.0, floor)))[k:-1].reshape(k, k)
    price, now = newton(figures, gram, target * total)
    return price, now, now - target * total


def mix(df: DataFrame, classifier: Classifier, weights: dict[str, float], floor: float = 0.0, total: float | None = None,
        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``n_tokens``, ``posteriors`` (in the order of
    the classifier's domains), ``rate``, ``copies`` and ``unmet``.

    ``rate`` is how often a document is to be used, on average: the expected
    tokens of the domains, in which a document has part by its posteriors, then
    match the ``weights`` (scaled to sum 1; a domain not named weighs 0) as
    closely as rates of at least ``floor`` can. ``copies`` is ``rate`` rounded
    up or down at random, by a hash of the id, so that it is right on average.
    ``unmet`` is the same in all rows: by how much each domain's share of the
    expected tokens still differs from its weight.

    Null, empty and wordless texts have no tokens and the rate that their
    posteriors give. Repeated rows count each; null ids share one hash. Input
    columns with the names of the new ones are replaced; an empty table gives
    no rows.
    """
    if not sum(weights.values()) > 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    new = ("n_tokens", "posteriors", "rate", "copies", "unmet")
    df = df.drop(*new)
    target = np.array([weights.get(d, 0.0) for d in classifier.domains])
    target = target / target.sum()
    held = df.sparkSession.sparkContext.broadcast(classifier)  # BUCKETS * domains numbers

    def member(batches: Iterator[pa.RecordBatch]):
        for _, texts in text_runs(batches):
            p = held.value.posteriors(texts).astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array([len(t.split()) for t in texts], pa.int64()),
                                              pa.array([x.tobytes() for x in p])], ["n", "p"])

    members = reuse(df.select(as_bytes(F.col(text_col)).alias("text")).mapInArrow(member, "n long, p binary"))
    price, now, _ = solve(members, target, floor, total)
    unmet = now / now.sum() - target if now.sum() > 0 else np.zeros(len(target))

    def make():
        def of(texts: list[bytes]) -> list[pa.Array]:
            p = held.value.posteriors(texts).astype(np.float64)
            return [pa.array([len(t.split()) for t in texts], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64())),
                    pa.array(rates(p, price, floor))]
        return of

    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(SEED)), F.lit(1 << 40)) / (1 << 40)
    kinds = (T.LongType(), T.ArrayType(T.DoubleType()), T.DoubleType())
    return (annotate(df, text_col, list(zip(new[:3], kinds, strict=True)), make)
            .withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))
            .withColumn("unmet", F.array(*[F.lit(float(x)) for x in unmet])))
