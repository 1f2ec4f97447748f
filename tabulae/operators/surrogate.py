"""Local surrogate explanations (LIME-style) as one distributed job.

For every row to explain:

1. quartile bins of each feature come from the training table (three
   percentile landmarks per feature; bounded, broadcast as literals);
2. ``n_perturb`` samples per row are generated by ``explode(sequence)``:
   each feature draws a quartile bin with the training bin frequencies and a
   value inside the bin (truncated normal with the bin's mean and std), all
   from ``xxhash64`` of (row, sample, feature, seed) -- reproducible under
   task retries; sample 0 is the row itself;
3. the surrogate inputs are binary: "feature in the row's own bin";
   samples are scored in batch by the model and weighted by the kernel
   sqrt(exp(-d^2 / w^2)) with w = 0.75 sqrt(d_features);
4. the weighted ridge (alpha = 1, intercept) needs only the sums
   Sw, Sw z, Sw zz', Sw y, Sw z y per row -- one ``groupBy(row)`` with
   partial aggregation -- and a (d x d) solve per row in an Arrow UDF
   (numpy batched solve).

Output: long ``(keys, feature, weight)`` plus ``intercept`` and
``score`` (surrogate prediction at the row).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kernel width factor, ridge penalty, quartile probabilities.
KERNEL_WIDTH_FACTOR = 0.75
RIDGE_ALPHA = 1.0
QUARTILES = [0.25, 0.5, 0.75]


def _u(*parts: Column, seed: int) -> Column:
    """U(0,1) from the low 53 bits of a 64-bit hash of the parts, never null."""
    h = F.xxhash64(*parts, F.lit(seed))
    return (h.bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0 ** -53)


def bin_statistics(train: DataFrame, features: Sequence[str]) -> dict:
    """Quartile cut points and per-bin frequency / mean / std / min / max
    (one percentile sketch job and one grouped aggregate, bounded output)."""
    cuts_row = train.agg(*[F.percentile_approx(F.col(f).cast("double"), QUARTILES, 10000).alias(f)
                           for f in features]).first()
    cuts = {f: sorted(set(float(v) for v in cuts_row[f])) for f in features}
    binned = train.select(*[_bin_of(F.col(f).cast("double"), cuts[f]).alias(f"_b_{f}") for f in features],
                          *[F.col(f).cast("double").alias(f) for f in features])
    stats = {}
    for f in features:
        rows = binned.groupBy(f"_b_{f}").agg(
            F.count(F.lit(1)).alias("n"), F.avg(f).alias("mean"), F.stddev_pop(f).alias("std"),
            F.min(f).alias("lo"), F.max(f).alias("hi")).collect()
        stats[f] = {int(r[0]): (r["n"], r["mean"], r["std"] or 0.0, r["lo"], r["hi"]) for r in rows}
    return {"cuts": cuts, "stats": stats}


def _bin_of(x: Column, cuts: list[float]) -> Column:
    b = F.lit(0)
    for c in cuts:
        b = b + (x > F.lit(c)).cast("int")
    return b


def _normal(u1: Column, u2: Column) -> Column:
    """N(0,1) from two uniforms; u1 > 0, so its logarithm is never null."""
    return F.sqrt(F.lit(-2.0) * F.coalesce(F.log(u1), F.lit(0.0))) * F.cos(F.lit(2 * math.pi) * u2)


def _draw_bin(st: dict, u_bin: Column) -> Column:
    """The quartile bin that a uniform falls in."""
    bins = sorted(st)
    total = float(sum(st[b][0] for b in bins))
    acc = 0.0
    cum = []
    for b in bins:
        acc += st[b][0] / total
        cum.append((b, acc))
    bin_col = F.lit(bins[-1])
    for b, c in reversed(cum[:-1]):
        bin_col = F.when(u_bin < F.lit(c), F.lit(b)).otherwise(bin_col)
    return bin_col


def _draw_value(st: dict, bin_col: Column, z: Column) -> Column:
    """The value of a normal inside its bin, between the bin's extremes."""
    bins = sorted(st)

    def of(k: int) -> Column:
        out = F.lit(st[bins[-1]][k])
        for b in reversed(bins[:-1]):
            out = F.when(bin_col == F.lit(b), F.lit(st[b][k])).otherwise(out)
        return out

    return F.least(F.greatest(of(1) + of(2) * z, of(3)), of(4))


# Up to this many features are chosen one by one.
FORWARD_MAX = 6


def ridge_on(a: np.ndarray, b: np.ndarray, used: np.ndarray, alpha: float) -> np.ndarray:
    """Ridge weights of each row's ``used`` features from its centred normal
    equations (the rest get 0)."""
    both = used[:, :, None] & used[:, None, :]
    eye = np.eye(a.shape[1])
    m = np.where(both, a, 0.0) + eye * np.where(used, alpha, 1.0)[:, None, :]
    return np.linalg.solve(m, np.where(used, b, 0.0)[..., None])[..., 0]


def select_features(a: np.ndarray, b: np.ndarray, k: int, forward: bool) -> np.ndarray:
    """Which ``k`` features each row's surrogate uses; ties go to the first."""
    n, d = b.shape
    if k >= d:
        return np.ones((n, d), bool)
    tiny = 1e-9 * (1 + np.einsum("nii->n", a).max(initial=0))
    rows = np.arange(n)
    if not forward:
        order = np.argsort(-np.abs(ridge_on(a, b, np.ones((n, d), bool), 0.01)), axis=1, kind="stable")
        used = np.zeros((n, d), bool)
        used[rows[:, None], order[:, :k]] = True
        return used
    used = np.zeros((n, d), bool)
    for _ in range(k):
        gain = np.full((n, d), -np.inf)  # squared error explained with the feature added
        for j in range(d):
            tried = used.copy()
            tried[:, j] = True
            w = ridge_on(a, b, tried, tiny)
            explained = 2 * (w * b).sum(axis=1) - np.einsum("ni,nij,nj->n", w, a, w)
            gain[:, j] = np.where(used[:, j], -np.inf, explained)
        used[rows, gain.argmax(axis=1)] = True
    return used


def lime_explain(rows: DataFrame, train: DataFrame, features: Sequence[str], scorer,
                 key_cols: Sequence[str], n_perturb: int = 500, seed: int = 42,
                 stats: dict | None = None, num_features: int = 10, selection: str = "auto") -> DataFrame:
    """Long (keys, feature, weight, intercept, score): per row, a weighted ridge
    surrogate on its ``num_features`` most useful features (all, if it has no more;
    the others have no row).

    ``selection``: ``forward`` (the feature that lowers the squared error most, one
    after the other), ``weights`` (largest weights of a fit on all), or ``auto``
    (forward up to ``FORWARD_MAX`` features, else weights). Both work on the
    rows' normal equations, all rows of an Arrow batch at once; the perturbed rows are
    not read again."""
    d = len(features)
    if selection not in ("auto", "forward", "weights"):
        raise ValueError(f"unknown selection {selection!r}")
    forward = selection == "forward" or (selection == "auto" and num_features <= FORWARD_MAX)
    st = stats or bin_statistics(train, features)
    cuts, bstats = st["cuts"], st["stats"]
    base = rows.select(*key_cols, *[F.col(f).cast("double").alias(f) for f in features])
    base = base.select("*", *[_bin_of(F.col(f), cuts[f]).alias(f"_ib_{i}") for i, f in enumerate(features)])
    ex = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_perturb - 1))).alias("_s"))
    # One select per step: an expression that the next step reads several times is a
    # column by then, so it is computed once a row, and each step's generated method
    # is short enough for the JVM to compile.
    keys, ds = list(key_cols), range(d)
    ib = [f"_ib_{i}" for i in ds]
    u = [_u(*[F.col(k) for k in keys], F.col("_s"), F.lit(i), F.lit(part), seed=seed).alias(f"_u{part}_{i}")
         for i in ds for part in range(3)]
    drawn = ex.select(*keys, *features, "_s", *ib, *u)
    drawn = drawn.select(
        *keys, *features, "_s", *ib, *[_draw_bin(bstats[f], F.col(f"_u0_{i}")).alias(f"_b{i}") for i, f in enumerate(features)],
        *[_normal(F.col(f"_u1_{i}"), F.col(f"_u2_{i}")).alias(f"_n{i}") for i in ds])
    first = F.col("_s") == 0
    pert = drawn.select(
        *keys, "_s",
        *[F.when(first, F.col(f)).otherwise(_draw_value(bstats[f], F.col(f"_b{i}"), F.col(f"_n{i}"))).alias(f)
          for i, f in enumerate(features)],
        *[F.when(first, F.lit(1.0)).otherwise((F.col(f"_b{i}") == F.col(f"_ib_{i}")).cast("double")).alias(f"_z{i}")
          for i in ds])
    if hasattr(scorer, "proba"):
        scored = pert.withColumn("_y", scorer.proba())
    else:
        scored = scorer.score(pert, "_y")
    width = KERNEL_WIDTH_FACTOR * math.sqrt(d)
    # The squared distance of binary inputs is how many are 0: a kernel weight for each.
    kernel = F.array(*[F.sqrt(F.exp(F.lit(-float(k)) / F.lit(width * width))) for k in range(d + 1)])
    w = F.element_at(kernel, (F.lit(d + 1.0) - sum((F.col(f"_z{i}") for i in ds), F.lit(0.0))).cast("int"))
    weighed = scored.select(*keys, "_y", *[f"_z{i}" for i in ds], w.alias("_w"))
    weighed = weighed.select("*", *[(F.col("_w") * F.col(f"_z{i}")).alias(f"_wz{i}") for i in ds])
    sums = [F.sum("_w").alias("_sw"), F.sum(F.col("_w") * F.col("_y")).alias("_sy")]
    sums += [F.sum(f"_wz{i}").alias(f"_sz{i}") for i in ds]
    sums += [F.sum(F.col(f"_wz{i}") * F.col("_y")).alias(f"_szy{i}") for i in ds]
    sums += [F.sum(F.col(f"_wz{i}") * F.col(f"_z{j}")).alias(f"_szz{i}_{j}") for i in ds for j in range(i + 1, d)]
    agg = weighed.groupBy(*keys).agg(*sums)
    packed = F.array(F.col("_sw"), F.col("_sy"), *[F.col(f"_sz{i}") for i in ds], *[F.col(f"_szy{i}") for i in ds],
                     *[F.col(f"_szz{i}_{j}" if i < j else f"_sz{i}")  # the square of a binary input is the input
                       for i in ds for j in range(i, d)])

    @F.pandas_udf("array<double>")
    def solve(s: pd.Series) -> pd.Series:
        m = np.stack(s.to_numpy())
        sw, sy = m[:, 0], m[:, 1]
        sz, szy = m[:, 2:2 + d], m[:, 2 + d:2 + 2 * d]
        szz = np.zeros((len(m), d, d))
        k = 2 + 2 * d
        for i in range(d):
            for j in range(i, d):
                szz[:, i, j] = szz[:, j, i] = m[:, k]
                k += 1
        mz = sz / sw[:, None]
        my = sy / sw
        a = szz - np.einsum("ni,nj->nij", sz, sz) / sw[:, None, None]
        b = szy - sz * my[:, None]
        used = select_features(a, b, num_features, forward)
        beta = np.where(used, ridge_on(a, b, used, RIDGE_ALPHA), 0.0)
        icpt = my - np.einsum("ni,ni->n", mz, beta)
        return pd.Series(list(np.concatenate([beta, icpt[:, None], used], axis=1)))

    coef = agg.select(*key_cols, solve(packed).alias("_c"))
    names = F.array(*[F.lit(f) for f in features])
    out = coef.select(*key_cols, F.element_at("_c", d + 1).alias("intercept"),
                      F.aggregate(F.slice("_c", 1, d), F.element_at("_c", d + 1), lambda a, x: a + x).alias("score"),
                      F.col("_c"), F.posexplode_outer(F.slice("_c", 1, d)).alias("_i", "weight"))
    out = out.where(F.element_at("_c", F.col("_i") + d + 2) == 1.0)
    return out.select(*key_cols, F.element_at(names, F.col("_i") + 1).alias("feature"), "weight",
                      "intercept", "score")


def lime_importance(expl: DataFrame, features: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """Mean |weight| of each of ``features`` over all explained rows, sorted; a row that
    left a feature out counts as 0."""
    n_rows = expl.select(*key_cols).distinct().agg(F.count("*").alias("_n"))
    sums = expl.groupBy("feature").agg(F.sum(F.abs("weight")).alias("_s"))
    every = expl.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    imp = every.join(sums, "feature", "left").withColumn("_k", F.lit(1)).join(
        F.broadcast(n_rows.withColumn("_k", F.lit(1))), "_k")  # one row
    return imp.select("feature", F.coalesce(F.col("_s") / F.col("_n"), F.lit(0.0)).alias("importance")).orderBy(
        F.col("importance").desc(), "feature")


def lime_maps(expl: DataFrame, key_cols: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """feature -> signed weight map per row (features by index, not substring);
    with ``features``, those that a row left out are there with 0."""
    maps = expl.groupBy(*key_cols).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("feature", "weight")))).alias("explanation"))
    if features is None:
        return maps
    every = F.array(*[F.lit(f) for f in sorted(features)])
    return maps.withColumn("explanation", F.map_from_arrays(every, F.transform(
        every, lambda f: F.coalesce(F.try_element_at("explanation", f), F.lit(0.0)))))
