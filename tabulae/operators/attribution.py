"""Feature attributions as table jobs: Shapley values, interaction indices,
local surrogates and the tables behind the reference's plots.

Coalition values. For a row x, a background sample B and a coalition S,
``v(S) = mean_b f(x_S, b_rest)``. Every attribution index used here --
exact Shapley, permutation sampling, kernel least squares, SII, k-SII,
STII, FSI -- is a *fixed linear map of the vector v*, because the
coalition design is shared by all rows. So an index is a coefficient
matrix computed once on the driver (size terms x coalitions, bounded by
the number of features), and the distributed work is:

* column-expression scorers (``LinearScorer``): one projection per row --
  ``transform`` over the coalition masks, ``aggregate`` over the background
  array (attached as a one-row broadcast of at most ``n_background``
  rows), then matrix x vector with higher-order functions. No shuffle.
* model scorers (Spark ML): rows x coalitions x background are exploded,
  scored in batch, and averaged by ``groupBy(key, coalition)`` (partial
  aggregation before the shuffle).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reuse

# ---------------------------------------------------------------------------
# coalition designs (driver side, size bounded by the feature count)

# Above these feature counts the driver does not enumerate all coalitions (2^d)
# or all feature orders (d!): the caller states how many to take.
EXACT_MAX_FEATURES, MAX_ALL_ORDERS = 12, 8


@dataclass
class Design:
    """``value[term] = sum_j matrix[term, j] * v(masks[j])``."""

    d: int
    masks: list[int]
    terms: list[tuple[int, ...]]
    matrix: np.ndarray

    def restrict(self, order: int) -> Design:
        keep = [k for k, t in enumerate(self.terms) if len(t) == order]
        return Design(self.d, self.masks, [self.terms[k] for k in keep], self.matrix[keep])


def _all_masks(d: int) -> list[int]:
    return list(range(1 << d))


def _bits(m: int) -> int:
    return bin(m).count("1")


def shapley_design(d: int) -> Design:
    """Exact Shapley values by enumeration of all 2^d coalitions."""
    masks = _all_masks(d)
    mat = np.zeros((d, len(masks)))
    for j, m in enumerate(masks):
        s = _bits(m)
        for i in range(d):
            if m >> i & 1:
                mat[i, j] += math.factorial(s - 1) * math.factorial(d - s) / math.factorial(d)
            else:
                mat[i, j] -= math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d)
    return Design(d, masks, [(i,) for i in range(d)], mat)


def _require_orders(d: int) -> None:
    if d > MAX_ALL_ORDERS:
        raise ValueError(f"{d} features: all feature orders are for {MAX_ALL_ORDERS} at most; state n_samples")


def permutation_design(d: int, n_perm: int | None = None, seed: int = 42) -> Design:
    """Average marginal contributions along feature orders: all d! orders
    when ``n_perm`` is None (exact Shapley), else ``n_perm`` seeded orders
    (each with its reverse, antithetic sampling)."""
    if n_perm is None:
        _require_orders(d)
        perms = list(itertools.permutations(range(d)))
    else:
        rng = np.random.default_rng(seed)
        perms = []
        for _ in range((n_perm + 1) // 2):
            p = tuple(int(x) for x in rng.permutation(d))
            perms += [p, p[::-1]]
        perms = perms[:n_perm]
    used: dict[int, int] = {}
    rows: list[tuple[int, int, float]] = []
    for p in perms:
        m = 0
        for i in p:
            before, m = m, m | (1 << i)
            for mm, sign in ((m, 1.0), (before, -1.0)):
                used.setdefault(mm, len(used))
                rows.append((i, used[mm], sign))
    masks = sorted(used, key=used.get)
    mat = np.zeros((d, len(masks)))
    for i, j, sign in rows:
        mat[i, j] += sign / len(perms)
    return Design(d, masks, [(i,) for i in range(d)], mat)


def _kernel_weight(d: int, s: int) -> float:
    """Shapley kernel weight of a coalition of size s (0 < s < d)."""
    return (d - 1) / (math.comb(d, s) * s * (d - s))


def _require_budget(d: int, name: str) -> None:
    if d > EXACT_MAX_FEATURES:
        raise ValueError(f"{d} features: enumerating everything is for {EXACT_MAX_FEATURES} at most; "
                         f"state {name}")


def _kernel_sample(d: int, budget: int, seed: int) -> dict[int, float]:
    """At most ``budget`` proper coalitions with their regression weights.
    Sizes s and d-s are taken whole, with the true kernel weight, from the
    smallest s on as long as they fit; the rest of the budget is drawn with
    replacement in complementary pairs, each draw carrying an equal part of
    the kernel mass of the sizes left."""
    weights: dict[int, float] = {}
    s = 1
    while 2 * s <= d:
        sizes = {s, d - s}
        if len(weights) + sum(math.comb(d, k) for k in sizes) > budget:
            break
        for k in sizes:
            for c in itertools.combinations(range(d), k):
                weights[sum(1 << i for i in c)] = _kernel_weight(d, k)
        s += 1
    draws = (budget - len(weights)) // 2
    left = np.arange(s, d - s + 1)
    if not len(left) or draws < 1:
        return weights
    mass = np.array([_kernel_weight(d, int(k)) * math.comb(d, int(k)) for k in left])
    rng = np.random.default_rng(seed)
    part = mass.sum() / (2 * draws)
    for k in rng.choice(left, size=draws, p=mass / mass.sum()):
        m = sum(1 << int(i) for i in rng.choice(d, size=int(k), replace=False))
        for mask in (m, (1 << d) - 1 ^ m):
            weights[mask] = weights.get(mask, 0.0) + part
    return weights


def kernel_design(d: int, n_samples: int | None = None, seed: int = 42,
                  max_order: int = 1) -> Design:
    """Weighted least squares on coalitions with the Shapley kernel, the
    empty and full coalitions fitted exactly (KKT constraints).

    ``max_order=1``: kernel SHAP; ``max_order=2``: faithful Shapley
    interactions (FSI). Exact when all 2^d coalitions are used
    (``n_samples`` None, up to ``EXACT_MAX_FEATURES`` features); otherwise
    at most ``n_samples`` coalitions, the empty and full ones included, as
    ``_kernel_sample`` takes them.
    """
    full = (1 << d) - 1
    if n_samples is None:
        _require_budget(d, "n_samples")
        n_samples = 1 << d
    sampled = _kernel_sample(d, min(n_samples, 1 << d) - 2, seed) | {0: 0.0, full: 0.0}
    masks = sorted(sampled)
    weights = np.array([sampled[m] for m in masks])
    terms: list[tuple[int, ...]] = [()]
    for k in range(1, max_order + 1):
        terms += list(itertools.combinations(range(d), k))
    Z = np.array([[1.0 if all(m >> i & 1 for i in t) else 0.0 for t in terms] for m in masks])
    ZtW = Z.T * weights
    pick = [masks.index(0), masks.index(full)]
    C = Z[pick]
    E = np.zeros((2, len(masks)))
    E[0, pick[0]] = E[1, pick[1]] = 1.0
    kkt = np.block([[2 * ZtW @ Z, C.T], [C, np.zeros((2, 2))]])
    rhs = np.vstack([2 * ZtW, E])
    mat = np.linalg.lstsq(kkt, rhs, rcond=None)[0][: len(terms)]
    return Design(d, masks, terms[1:], mat[1:])


def _pair_weight(d: int, s: int, index: str) -> float:
    """Weight of a pair's joint effect on a coalition of ``s`` others."""
    if index in ("STII", "STI"):
        return 2.0 / d / math.comb(d - 1, s)
    return 1.0 / ((d - 1) * math.comb(d - 2, s))


def _stratified_sample(d: int, budget: int, seed: int) -> dict[int, float]:
    """Coalitions with the number of coalitions that each stands for. Sizes s
    and d - s are taken whole, from the empty and full ones on, while they fit; each
    size left gets its part of the others, by kernel mass and one at least, drawn
    without repetition in complementary pairs that stand for the whole size."""
    whole: dict[int, float] = {}
    s = 0
    while 2 * s <= d:
        sizes = {s, d - s}
        if len(whole) + sum(math.comb(d, k) for k in sizes) > budget:
            break
        for k in sizes:
            whole |= {sum(1 << i for i in c): 1.0 for c in itertools.combinations(range(d), k)}
        s += 1
    left = [k for k in range(s, d // 2 + 1)]  # a pair of sizes each: k and d - k
    if s < 2:
        raise ValueError(f"a budget of {budget} coalitions does not cover the {2 * d + 2} smallest and largest of {d} features")
    if not left:
        return whole
    mass = np.array([_kernel_weight(d, k) * math.comb(d, k) for k in left])
    draws = np.maximum(1, np.floor((budget - len(whole)) / 2 * mass / mass.sum())).astype(int)
    rng, sampled, full = np.random.default_rng(seed), {}, (1 << d) - 1
    for k, n in zip(left, draws.tolist(), strict=True):
        pairs = math.comb(d, k) // (2 if 2 * k == d else 1)
        n = min(n, pairs)
        if pairs <= 4 * n:
            every = [m for c in itertools.combinations(range(d), k) if 2 * k < d or c[0] == 0 for m in [sum(1 << i for i in c)]]
            drawn = {every[i] for i in rng.choice(pairs, n, replace=False)}
        else:
            drawn = set()
            while len(drawn) < n:
                m = sum(1 << int(i) for i in rng.choice(d, size=k, replace=False))
                drawn.add(m if 2 * k < d or m & 1 else full ^ m)
        sampled |= {mask: pairs / n for m in drawn for mask in (m, full ^ m)}
    return whole | sampled


def sampled_interaction_design(d: int, index: str, budget: int, seed: int = 42) -> Design:
    """SII, k-SII or STII of all pairs from about ``budget`` coalitions shared
    by them. Every coalition adds to every pair by its weight there times the
    number of coalitions that it stands for (``_stratified_sample``). What a
    weighted least-squares model of single features and pairs explains is
    taken out first, and its index, which is known, added again: so the estimate is
    exact for games of pairs at any budget, and for all games when no size is
    left to sample."""
    stands_for = _stratified_sample(d, budget, seed)
    masks = sorted(stands_for)
    member = np.array([[m >> i & 1 for i in range(d)] for m in masks], bool)
    count, size = np.array([stands_for[m] for m in masks]), member.sum(axis=1)
    pairs = list(itertools.combinations(range(d), 2))
    a, b = np.array(pairs).T
    in_both = member[:, a].astype(int) + member[:, b]
    by_rest = np.array([_pair_weight(d, s, index) for s in range(d - 1)])
    sign = np.where(in_both == 1, -1.0, 1.0)
    pair_mat = (sign * by_rest[size[:, None] - in_both] * count[:, None]).T
    if index in ("STII", "STI"):
        single = np.zeros((d, len(masks)))
        for i in range(d):
            single[i, masks.index(1 << i)], single[i, masks.index(0)] = 1.0, -1.0
    else:
        joins = np.array([1.0 / (d * math.comb(d - 1, s)) for s in range(d)])
        gain = np.where(member, joins[np.maximum(size - 1, 0)][:, None], -joins[np.minimum(size, d - 1)][:, None])
        single = (gain * count[:, None]).T
        if index == "K-SII":
            for k, (i, j) in enumerate(pairs):
                single[i] -= 0.5 * pair_mat[k]
                single[j] -= 0.5 * pair_mat[k]
    estimate = np.vstack([single, pair_mat])
    if len(masks) < 1 << d:
        z = np.hstack([np.ones((len(masks), 1)), member, member[:, a] & member[:, b]]).astype(float)
        inner = (size > 0) & (size < d)
        kernel = np.array([_kernel_weight(d, s) if 0 < s < d else 0.0 for s in range(d + 1)])[size] * count
        kernel[~inner] = 1e3 * kernel.max()  # the ends count most
        root = np.sqrt(kernel / kernel.max())
        fit = np.linalg.lstsq(z * root[:, None], np.diag(root), rcond=None)[0]
        known = fit[1:].copy()  # index of the model: its coefficients
        if index == "SII":
            for k, (i, j) in enumerate(pairs):
                known[i] += 0.5 * fit[1 + d + k]
                known[j] += 0.5 * fit[1 + d + k]
        estimate = known + estimate - (estimate @ z) @ fit
    return Design(d, masks, [*[(i,) for i in range(d)], *pairs], estimate)


def interaction_design(d: int, index: str = "k-SII", budget: int | None = None, seed: int = 42) -> Design:
    """Order-1 and order-2 terms of SII, k-SII, STII or FSI: exact from all
    2^d coalitions up to ``EXACT_MAX_FEATURES`` features, or estimated from
    ``budget`` coalitions (see ``sampled_interaction_design``)."""
    index = index.upper()
    if index not in ("SII", "K-SII", "STII", "STI", "FSI"):
        raise ValueError(f"unknown index {index}")
    if index == "FSI":
        return kernel_design(d, budget, seed, max_order=2)
    if budget is not None and (d > EXACT_MAX_FEATURES or budget < 1 << d):
        return sampled_interaction_design(d, index, budget, seed)
    _require_budget(d, "budget")
    masks = _all_masks(d)
    full = (1 << d) - 1
    pairs = list(itertools.combinations(range(d), 2))
    pair_mat = np.zeros((len(pairs), len(masks)))
    for k, (i, j) in enumerate(pairs):
        rest = full ^ (1 << i) ^ (1 << j)
        for S in masks:
            if S & ~rest:
                continue
            s = _bits(S)
            w = _pair_weight(d, s, index)
            for T, sign in ((S | 1 << i | 1 << j, 1), (S | 1 << i, -1), (S | 1 << j, -1), (S, 1)):
                pair_mat[k, T] += sign * w
    if index in ("STII", "STI"):
        single = np.zeros((d, len(masks)))
        for i in range(d):
            single[i, 1 << i] += 1.0
            single[i, 0] -= 1.0
    else:
        single = shapley_design(d).matrix.copy()
        if index == "K-SII":
            for k, (i, j) in enumerate(pairs):
                single[i] -= 0.5 * pair_mat[k]
                single[j] -= 0.5 * pair_mat[k]
    terms = [(i,) for i in range(d)] + pairs
    return Design(d, masks, terms, np.vstack([single, pair_mat]))


# ---------------------------------------------------------------------------
# distributed coalition values

def background_array(background: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row holding the background sample as array<struct> (bounded by
    the sample size, so it is broadcast)."""
    return background.agg(F.collect_list(F.struct(*[F.col(f).cast("double").alias(f"b{i}")
                                                   for i, f in enumerate(features)])).alias("_bg"))


def _attach_one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    k = "_one_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one.withColumn(k, F.lit(1))), k).drop(k)


def coalition_values(df: DataFrame, features: Sequence[str], scorer, background: DataFrame,
                     masks: Sequence[int], key_cols: Sequence[str]) -> DataFrame:
    """``key_cols`` + features + ``v``: array of v(S) aligned with ``masks``."""
    if hasattr(scorer, "proba"):
        return _coalition_values_expr(df, features, scorer, background, masks, key_cols)
    return _coalition_values_model(df, features, scorer, background, masks, key_cols)


def _coalition_values_expr(df, features, scorer, background, masks, key_cols):
    x = {f: F.col(f).cast("double") for f in features}
    staged = _attach_one_row(df.select(*key_cols, *features), background_array(background, features))

    def value(m: Column) -> Column:
        def step(acc: Column, b: Column) -> Column:
            vals = {f: F.when(F.shiftright(m, i).bitwiseAND(1) == 1, x[f]).otherwise(b[f"b{i}"])
                    for i, f in enumerate(features)}
            return acc + scorer.proba(vals)
        return F.aggregate(F.col("_bg"), F.lit(0.0), step) / F.size(F.col("_bg"))

    mask_arr = F.array(*[F.lit(int(m)) for m in masks])
    return staged.select(*key_cols, *features, F.transform(mask_arr, value).alias("v"))


def _coalition_values_model(df, features, scorer, background, masks, key_cols):
    staged = _attach_one_row(df.select(*key_cols, *features), background_array(background, features))
    ex = staged.select(*key_cols, *[F.col(f).alias(f"_x_{f}") for f in features],
                       F.posexplode(F.array(*[F.lit(int(m)) for m in masks])).alias("_mi", "_m"),
                       F.col("_bg"))
    ex = ex.select("*", F.inline(F.col("_bg"))).drop("_bg")
    masked = ex.select(*key_cols, "_mi", *[
        F.when(F.shiftright(F.col("_m"), i).bitwiseAND(1) == 1, F.col(f"_x_{f}"))
        .otherwise(F.col(f"b{i}")).alias(f) for i, f in enumerate(features)])
    scored = scorer.score(masked, "_p")
    per = scored.groupBy(*key_cols, "_mi").agg(F.avg("_p").alias("_v"))
    arr = per.groupBy(*key_cols).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_mi", "_v"))), lambda s: s["_v"]).alias("v"))
    return df.select(*key_cols, *features).join(arr, list(key_cols))


def apply_design(vals: DataFrame, design: Design, features: Sequence[str], key_cols: Sequence[str],
                 value_name: str = "value") -> DataFrame:
    """Long table (keys, feature_i, feature_j, order, value) of the index
    terms: one matrix-vector product per row (higher-order functions)."""
    mat = F.array(*[F.array(*[F.lit(float(c)) for c in row]) for row in design.matrix])
    n = len(design.masks)

    def term_value(t: Column) -> Column:
        row = F.element_at(mat, t + 1)
        return F.aggregate(F.sequence(F.lit(1), F.lit(n)), F.lit(0.0),
                           lambda acc, j: acc + F.element_at(row, j) * F.element_at(F.col("v"), j))

    n_terms = len(design.terms)
    # _outer: an inner generator makes Catalyst infer size(...) > 0 and
    # evaluate the whole term vector twice.
    out = vals.select(*key_cols, F.posexplode_outer(F.transform(F.sequence(F.lit(0), F.lit(n_terms - 1)),
                                                          term_value)).alias("_t", value_name))
    names_i = F.array(*[F.lit(features[t[0]]) for t in design.terms])
    names_j = F.array(*[F.lit(features[t[1]]) if len(t) > 1 else F.lit(None).cast("string")
                        for t in design.terms])
    orders = F.array(*[F.lit(len(t)) for t in design.terms])
    return out.select(*key_cols,
                      F.element_at(names_i, F.col("_t") + 1).alias("feature_i"),
                      F.element_at(names_j, F.col("_t") + 1).alias("feature_j"),
                      F.element_at(orders, F.col("_t") + 1).cast("long").alias("order"),
                      value_name)


# Above this many matrix cells a design is no longer written into the plan; and
# rows x coalitions x background rows that a task scores at once.
LITERAL_CELLS, MAX_SCORED = 1 << 14, 1 << 22
MAX_BACKGROUND = 1000


def _rows_of_background(background: DataFrame, features: Sequence[str]) -> np.ndarray:
    rows = background.select(*[F.col(f).cast("double") for f in features]).limit(MAX_BACKGROUND + 1).collect()
    if not 0 < len(rows) <= MAX_BACKGROUND:
        raise ValueError(f"a background has 1 to {MAX_BACKGROUND} rows; sample it first")
    return np.array(rows, dtype=float)


def design_in_batches(df: DataFrame, features: Sequence[str], scorer, background: DataFrame, design: Design,
                      key_cols: Sequence[str], value_name: str = "value") -> DataFrame:
    """``coalition_values`` and ``apply_design`` for designs too large for the
    plan, with v of the empty and the full coalition as ``base`` and ``fx`` (both
    must be in the design). The design is broadcast (its size is the budget's, not
    the data's). A linear scorer's coalition values are matrix products inside
    Arrow batches, with no shuffle; other scorers score exploded rows in batch."""
    if design.d > 62:
        raise ValueError("coalitions are kept as 64-bit masks: 62 features at most")
    masks, feats, keys = design.masks, list(features), list(key_cols)
    ends = (masks.index(0), masks.index((1 << design.d) - 1))
    linear = hasattr(scorer, "coefs") and hasattr(scorer, "margin")
    names = [[feats[t[0]], feats[t[1]] if len(t) > 1 else None, len(t)] for t in design.terms]
    shared = df.sparkSession.sparkContext.broadcast({
        "matrix": design.matrix.T.copy(), "in": np.array([[m >> i & 1 for i in range(design.d)] for m in masks], float),
        "bg": _rows_of_background(background, feats) if linear else None})
    if linear:
        weight = np.array([float(scorer.coefs.get(f, 0.0)) for f in feats])
        intercept, decimals = float(scorer.intercept), scorer.decimals
        rows = df.select(*keys, *[F.col(f).cast("double").alias(f) for f in feats])
    else:
        rows = coalition_values(df, feats, scorer, background, masks, keys).select(*keys, "v")

    def values(pdf) -> np.ndarray:
        if not linear:
            return np.stack(pdf["v"].to_numpy())
        known, bg = shared.value["in"], shared.value["bg"]
        rest = (1 - known) @ (bg * weight).T + intercept
        x, out = (pdf[feats].to_numpy() * weight) @ known.T, np.zeros((len(pdf), len(known)))
        step = max(1, MAX_SCORED // rest.size)
        for i in range(0, len(pdf), step):
            with np.errstate(over="ignore"):
                p = 1.0 / (1.0 + np.exp(-(x[i:i + step, :, None] + rest)))
            out[i:i + step] = (p if decimals is None else np.round(p, decimals)).mean(axis=2)
        return out

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], "feature_i string, feature_j string, `order` long",
                        f"{value_name} double, base double, fx double"])
    feature_i, feature_j, order = (np.array(c, dtype=object) for c in zip(*names))

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                part = pdf.iloc[i:i + 256]
                v = values(part)
                n, m = len(part), len(names)
                out = {k: np.repeat(part[k].to_numpy(), m) for k in keys}
                out |= {"feature_i": np.tile(feature_i, n), "feature_j": np.tile(feature_j, n), "order": np.tile(order, n).astype(int),
                        value_name: (v @ shared.value["matrix"]).reshape(-1),
                        "base": np.repeat(v[:, ends[0]], m), "fx": np.repeat(v[:, ends[1]], m)}
                yield pd.DataFrame(out)

    return rows.mapInPandas(run, schema)


def shapley_values(df: DataFrame, features: Sequence[str], scorer, background: DataFrame,
                   key_cols: Sequence[str], method: str = "exact", n_samples: int | None = None,
                   seed: int = 42) -> DataFrame:
    """Long (keys, feature, phi, base, fx): Sigma phi + base = fx.

    method: ``exact`` (all coalitions, up to ``EXACT_MAX_FEATURES``
    features), ``kernel`` (least squares on ``n_samples`` coalitions) or
    ``permutation`` (``n_samples`` feature orders). More features than that
    (``MAX_ALL_ORDERS`` for orders) need ``n_samples``; ``exact`` with
    ``n_samples`` is ``kernel``.
    """
    d = len(features)
    if method == "permutation":
        design = permutation_design(d, n_samples, seed)
    elif method == "kernel" or n_samples is not None:
        design = kernel_design(d, n_samples, seed)
    else:
        _require_budget(d, "n_samples")
        design = shapley_design(d)
    masks = list(design.masks)
    extra = [m for m in (0, (1 << d) - 1) if m not in masks]
    design_full = Design(d, masks + extra, design.terms,
                         np.hstack([design.matrix, np.zeros((len(design.terms), len(extra)))]))
    if design_full.matrix.size > LITERAL_CELLS:
        return design_in_batches(df, features, scorer, background, design_full, key_cols, "phi").select(
            *key_cols, F.col("feature_i").alias("feature"), "phi", "base", "fx")
    vals = coalition_values(df, features, scorer, background, design_full.masks, key_cols)
    i0 = design_full.masks.index(0) + 1
    i1 = design_full.masks.index((1 << d) - 1) + 1
    vals = vals.withColumn("base", F.element_at("v", i0)).withColumn("fx", F.element_at("v", i1))
    long = apply_design(vals, design_full, features, [*key_cols, "base", "fx"], "phi")
    return long.select(*key_cols, F.col("feature_i").alias("feature"), "phi", "base", "fx")


def interaction_values(df: DataFrame, features: Sequence[str], scorer, background: DataFrame,
                       key_cols: Sequence[str], index: str = "k-SII", budget: int | None = None,
                       seed: int = 42) -> DataFrame:
    """Long (keys, feature_i, feature_j, order, value) for order 1 and 2;
    ``budget``: see ``interaction_design``."""
    design = interaction_design(len(features), index, budget, seed)
    if design.matrix.size > LITERAL_CELLS:
        return design_in_batches(df, features, scorer, background, design, key_cols).drop("base", "fx")
    vals = coalition_values(df, features, scorer, background, design.masks, key_cols)
    return apply_design(vals, design, features, key_cols)


def linear_shap(df: DataFrame, scorer, background: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Closed form for a linear margin: phi_i = w_i (x_i - mean_bg x_i)."""
    feats = scorer.features
    means = background.agg(*[F.avg(F.col(f).cast("double")).alias(f"_mu_{f}") for f in feats])
    j = _attach_one_row(df.select(*key_cols, *feats), means)
    stacked = F.stack(F.lit(len(feats)), *[
        x for f in feats for x in (F.lit(f), F.lit(float(scorer.coefs[f])) * (F.col(f) - F.col(f"_mu_{f}")))])
    return j.select(*key_cols, stacked.alias("feature", "phi"))


# ---------------------------------------------------------------------------
# tables behind reports and plots

def shap_importance(phi: DataFrame, feature: str = "feature", value: str = "phi") -> DataFrame:
    """(feature, importance = mean |phi|, rank) sorted desc, ties by name."""
    imp = phi.groupBy(feature).agg(F.avg(F.abs(F.col(value))).alias("importance"))
    return imp.withColumn("rank", F.row_number().over(
        Window.orderBy(F.col("importance").desc(), F.col(feature))).cast("long"))


def importance_bars(importance: DataFrame, k: int = 20) -> DataFrame:
    return importance.where(F.col("rank") <= k)


def class_shapley_values(df: DataFrame, features: Sequence[str], scorer, background: DataFrame,
                         key_cols: Sequence[str]) -> DataFrame:
    """Long (keys, class, feature, phi, base, fx): exact Shapley values of every
    class's probability under a softmax scorer, Sigma phi + base = fx per class.

    One scoring gives the coalition values of all classes: rows x coalitions x
    background rows are scored in Arrow batches of at most ``MAX_SCORED`` cells,
    with no shuffle; the background (at most ``MAX_BACKGROUND`` rows) and the
    design are broadcast. A null feature gives null values."""
    feats, keys, classes = list(features), list(key_cols), list(scorer.classes)
    design = shapley_design(len(feats))
    known = np.array([[m >> i & 1 for i in range(design.d)] for m in design.masks], float)
    weight = np.array([[float(w) for w in scorer.coefs[f]] for f in feats])
    bias = np.array([float(x) for x in scorer.intercepts] if scorer.intercepts else [0.0] * len(classes))
    bg = _rows_of_background(background, feats)
    rest = np.einsum("cd,bd,dk->cbk", 1 - known, bg, weight) + bias
    shared = df.sparkSession.sparkContext.broadcast((known, weight, rest, design.matrix))
    ends = (design.masks.index(0), design.masks.index((1 << design.d) - 1))
    decimals, step = scorer.decimals, max(1, MAX_SCORED // max(1, rest.size))
    named = df.select(*keys)
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields],
                        "class string, feature string, phi double, base double, fx double"])

    def run(batches):
        known, weight, rest, matrix = shared.value
        for pdf in batches:
            for i in range(0, len(pdf), step):
                part = pdf.iloc[i:i + step]
                x = part[feats].to_numpy(dtype=float)
                z = np.einsum("nd,cd,dk->nck", x, known, weight)[:, :, None, :] + rest
                e = np.exp(z - z.max(axis=3, keepdims=True))
                p = e / e.sum(axis=3, keepdims=True)
                v = (p if decimals is None else np.round(p, decimals)).mean(axis=2)
                phi = np.einsum("tc,nck->nkt", matrix, v)
                n, k, t = phi.shape
                out = {c: np.repeat(part[c].to_numpy(), k * t) for c in keys}
                out |= {"class": np.tile(np.repeat(np.array(classes, dtype=object), t), n), "feature": np.tile(np.array(feats, dtype=object), n * k),
                        "phi": phi.reshape(-1), "base": np.repeat(v[:, ends[0]].reshape(-1), t), "fx": np.repeat(v[:, ends[1]].reshape(-1), t)}
                out = pd.DataFrame(out)
                yield out.astype({c: object for c in ("phi", "base", "fx")}).where(out.notna(), None) if np.isnan(x).any() else out

    return df.select(*keys, *[F.col(f).cast("double").alias(f) for f in feats]).mapInPandas(run, schema)


def explanation_maps(phi: DataFrame, key_cols: Sequence[str], feature: str = "feature",
                     value: str = "phi", target: str | None = None) -> DataFrame:
    """One feature -> value map per row (entries sorted by feature). Of values per
    class, those of the class ``target``, or without one of the row's most probable
    class (ties: the first by name), with the ``class``."""
    keys = list(key_cols)
    if "class" in phi.columns:
        keys.append("class")
        if target is not None:
            phi = phi.where(F.col("class") == target)
    maps = phi.groupBy(*keys).agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct(F.col(feature), F.col(value))))).alias("explanation"),
        *([F.max("fx").alias("_fx")] if len(keys) > len(key_cols) else []))
    if len(keys) == len(key_cols):
        return maps
    if target is not None:
        return maps.drop("_fx")
    best = F.min_by(F.struct("class", "explanation"), F.struct(-F.coalesce("_fx", F.lit(-1.0)), F.col("class")))
    return maps.groupBy(*key_cols).agg(best.alias("_b")).select(*key_cols, "_b.class", "_b.explanation")


def summary_points(phi: DataFrame, x_long: DataFrame, importance: DataFrame,
                   key_cols: Sequence[str]) -> DataFrame:
    """(keys, feature, value, phi, rank): points of the summary plot."""
    j = phi.join(x_long, [*key_cols, "feature"]).join(importance.select("feature", "rank"), "feature")
    return j.select(*key_cols, "feature", "value", "phi", "rank")


def dependence_points(phi: DataFrame, x_long: DataFrame, feature: str, key_cols: Sequence[str],
                      interaction: str | None = "auto") -> DataFrame:
    """(keys, value, phi, color_feature, color_value) for one feature; the
    colour feature is the one whose values correlate most (abs) with the
    feature's phi (``auto``) or the one given."""
    if not x_long.where(F.col("feature") == feature).limit(1).collect():  # stops at the first hit
        raise ValueError(f"Unknown feature: {feature}")
    ph = phi.where(F.col("feature") == feature).select(*key_cols, "phi")
    xs = x_long.where(F.col("feature") == feature).select(*key_cols, "value")
    base = ph.join(xs, list(key_cols))
    others = x_long.where(F.col("feature") != feature).select(
        *key_cols, F.col("feature").alias("color_feature"), F.col("value").alias("color_value"))
    j = base.join(others, list(key_cols))
    if interaction == "auto":
        score = j.groupBy("color_feature").agg(F.abs(F.corr("phi", "color_value")).alias("_c"))
        best = score.orderBy(F.col("_c").desc_nulls_last(), F.col("color_feature")).limit(1)
        j = j.join(best.select("color_feature"), "color_feature", "left_semi")
    elif interaction is not None:
        j = j.where(F.col("color_feature") == interaction)
    return j.select(*key_cols, "value", "phi", "color_feature", "color_value")


def waterfall(phi: DataFrame, key_cols: Sequence[str], max_display: int = 10) -> DataFrame:
    """Per row: base -> contributions by |phi| desc -> fx; with more than
    ``max_display`` features, the smallest beyond ``max_display - 1`` are summed
    into ``other``. ``start``/``end``
    are the running totals drawn by the plot."""
    w = Window.partitionBy(*key_cols).orderBy(F.abs(F.col("phi")).desc(), F.col("feature"))
    ranked = phi.withColumn("_pos", F.row_number().over(w))
    ranked = ranked.withColumn("_d", F.count("*").over(Window.partitionBy(*key_cols)))
    keep = F.when(F.col("_d") > max_display, max_display - 1).otherwise(F.col("_d"))
    labelled = ranked.withColumn("feature", F.when(F.col("_pos") <= keep, F.col("feature")).otherwise("other")) \
        .withColumn("_pos", F.least(F.col("_pos"), keep + 1))
    steps = labelled.groupBy(*key_cols, "feature", "_pos").agg(
        F.sum("phi").alias("phi"), F.first("base").alias("base"))
    cw = Window.partitionBy(*key_cols).orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    out = steps.withColumn("end", F.col("base") + F.sum("phi").over(cw))
    return out.select(*key_cols, F.col("_pos").cast("long").alias("position"), "feature", "phi",
                      (F.col("end") - F.col("phi")).alias("start"), "end")


def base_value(scored_background: DataFrame, score: str = "p", classes: Sequence[str] | None = None) -> DataFrame:
    """Mean score of the background; with ``classes`` that of each class, from an
    array of probabilities in their order."""
    if classes is not None:
        names = F.array(*[F.lit(c) for c in classes])
        per = scored_background.select(F.posexplode_outer(score).alias("_k", "_p")).groupBy("_k").agg(F.avg("_p").alias("base_value"))
        return per.where("_k is not null").select(F.get(names, F.col("_k")).alias("class"), "base_value")
    return scored_background.agg(F.avg(score).alias("base_value"))


def deviation_interactions(df: DataFrame, features: Sequence[str], key_cols: Sequence[str]) -> DataFrame:
    """Fallback interactions: (x_i - mean_i)(x_j - mean_j) for all i < j."""
    means = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"_mu_{f}") for f in features])
    j = _attach_one_row(df.select(*key_cols, *features), means)
    pairs = list(itertools.combinations(features, 2))
    stacked = F.stack(F.lit(len(pairs)), *[
        x for a, b in pairs for x in (F.lit(a), F.lit(b),
                                      (F.col(a) - F.col(f"_mu_{a}")) * (F.col(b) - F.col(f"_mu_{b}")))])
    return j.select(*key_cols, stacked.alias("feature_i", "feature_j", "value")).withColumn(
        "order", F.lit(2).cast("long"))


def interaction_strength(inter: DataFrame, top_k: int = 10) -> DataFrame:
    """Mean |value| per term, sorted desc with its order; top ``top_k``."""
    s = inter.groupBy("feature_i", "feature_j", "order").agg(
        F.avg(F.abs("value")).alias("interaction_strength"))
    return s.orderBy(F.col("interaction_strength").desc(), "feature_i", F.col("feature_j").asc_nulls_first()) \
        .limit(top_k)


def interaction_edges(inter: DataFrame, top_k: int = 10) -> DataFrame:
    """Pair edges of the network plot: width = 5 * strength / max strength."""
    top = interaction_strength(inter, top_k).where(F.col("order") == 2)
    mx = top.agg(F.max("interaction_strength").alias("_mx"))
    return _attach_one_row(top, mx).select(
        "feature_i", "feature_j", "interaction_strength",
        (F.lit(5.0) * F.col("interaction_strength") / F.col("_mx")).alias("width"))


def interaction_matrix(inter: DataFrame, top_k: int = 20) -> DataFrame:
    """Symmetric pair-strength matrix restricted to the ``top_k`` features
    with the largest row sums; long (a, b, strength), a != b. The strengths, one row
    a pair, are written once: they are read six times, the rows' values once."""
    pairs = reuse(inter.where(F.col("order") == 2).groupBy("feature_i", "feature_j").agg(
        F.avg(F.abs("value")).alias("strength")))
    both = pairs.select(F.col("feature_i").alias("a"), F.col("feature_j").alias("b"), "strength").unionByName(
        pairs.select(F.col("feature_j").alias("a"), F.col("feature_i").alias("b"), "strength"))
    sums = both.groupBy("a").agg(F.sum("strength").alias("_rs"))
    top = sums.orderBy(F.col("_rs").desc(), "a").limit(top_k).select("a")
    return (both.join(top, "a", "left_semi")
            .join(top.select(F.col("a").alias("b")), "b", "left_semi")
            .select("a", "b", "strength"))


def instance_interactions(inter: DataFrame, key_cols: Sequence[str], top_k: int = 5) -> DataFrame:
    """Top ``top_k`` terms per row by |value|."""
    w = Window.partitionBy(*key_cols).orderBy(F.abs(F.col("value")).desc(), "feature_i",
                                              F.col("feature_j").asc_nulls_first())
    return inter.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
