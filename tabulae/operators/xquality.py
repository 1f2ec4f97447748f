"""Explanation-quality metrics: stability, consistency, fidelity, agreement,
complexity, and comparison of importance tables.

Inputs are long tables: importance runs ``(run, feature, importance)`` and
explanations ``(keys..., feature, value)``. Work is grouped by row or by
run pair; the only pairwise step is over *features* inside a run pair
(Kendall's tau-b), bounded by the feature count, never by the row count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .prep import hash_sample

# The cosine/relative-distance epsilon and default thresholds.
DIST_EPS = 1e-10
COMPLEXITY_THRESHOLD = 0.01


def _one_row(df: DataFrame, one: DataFrame) -> DataFrame:
    k = "_xq_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one.withColumn(k, F.lit(1))), k).drop(k)


def align_runs(runs: DataFrame) -> DataFrame:
    """(run, feature, value) on the first run's features; missing -> 0.
    Features that only appear in later runs are ignored."""
    first = runs.agg(F.min("run").alias("_first"), F.array_sort(F.collect_set("run")).alias("_runs"))
    base = _one_row(runs, first)
    feats = base.where(F.col("run") == F.col("_first")).select("feature").distinct()
    per_feat = runs.groupBy("feature").agg(F.map_from_entries(F.collect_list(
        F.struct("run", F.col("importance").cast("double")))).alias("_m"))
    grid = _one_row(feats.join(per_feat, "feature", "left"), first.select("_runs"))
    ex = grid.select("feature", "_m", F.explode("_runs").alias("run"))
    return ex.select("run", "feature", F.coalesce(F.try_element_at("_m", F.col("run")), F.lit(0.0)).alias("value"))


def _mid_ranks(aligned: DataFrame) -> DataFrame:
    w = Window.partitionBy("run").orderBy("value")
    ties = Window.partitionBy("run", "value")
    return aligned.withColumn("rank", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)


def importance_stability(runs: DataFrame, method: str = "spearman") -> DataFrame:
    """Mean pairwise correlation between runs (spearman, kendall, pearson).

    One row: ``value`` (1.0 with fewer than two runs), number of run pairs,
    and how many pairs had an undefined (constant-vector) correlation; those
    are skipped in the mean.
    """
    al = align_runs(runs)
    col = "rank" if method == "spearman" else "value"
    if method == "spearman":
        al = _mid_ranks(al)
    a = al.select(F.col("run").alias("run_a"), "feature", F.col(col).alias("x"))
    b = al.select(F.col("run").alias("run_b"), "feature", F.col(col).alias("y"))
    j = a.join(b, "feature").where(F.col("run_a") < F.col("run_b"))
    if method == "kendall":
        j2 = j.select("run_a", "run_b", F.col("feature").alias("f2"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        pairs = j.join(j2, ["run_a", "run_b"]).where(F.col("feature") < F.col("f2"))
        sx = F.signum(F.col("x") - F.col("x2"))
        sy = F.signum(F.col("y") - F.col("y2"))
        per = pairs.groupBy("run_a", "run_b").agg(
            (F.sum(sx * sy) / F.sqrt(F.sum(sx * sx) * F.sum(sy * sy))).alias("corr"))
        per = per.withColumn("corr", F.when(F.isnan("corr"), None).otherwise(F.col("corr")))
    else:
        per = j.groupBy("run_a", "run_b").agg(F.corr("x", "y").alias("corr"))
        per = per.withColumn("corr", F.when(F.isnan("corr"), None).otherwise(F.col("corr")))
    n_runs = runs.agg(F.count_distinct("run").alias("_n"))
    agg = per.agg(F.avg("corr").alias("_mean"), F.count(F.lit(1)).alias("n_pairs"),
                  F.sum(F.col("corr").isNull().cast("long")).alias("n_undefined"))
    out = _one_row(n_runs, agg)
    return out.select(F.lit(method).alias("method"),
                      F.when(F.col("_n") < 2, F.lit(1.0)).otherwise(F.col("_mean")).alias("value"),
                      F.coalesce("n_pairs", F.lit(0)).cast("long").alias("n_pairs"),
                      F.coalesce("n_undefined", F.lit(0)).cast("long").alias("n_undefined"))


def explanation_consistency(exp1: DataFrame, exp2: DataFrame, key_cols: Sequence[str],
                            metric: str = "cosine") -> DataFrame:
    """Per row over the union of features (missing -> 0): cosine ->
    max(0, mean similarity), zero vectors similarity 0; euclidean /
    manhattan -> max(0, 1 - mean / (max + 1e-10))."""
    a = exp1.select(*key_cols, "feature", F.col("value").alias("a"))
    b = exp2.select(*key_cols, "feature", F.col("value").alias("b"))
    j = a.join(b, [*key_cols, "feature"], "full_outer").fillna(0.0, subset=["a", "b"])
    if metric == "cosine":
        per = j.groupBy(*key_cols).agg(F.sum(F.col("a") * F.col("b")).alias("dot"),
                                       F.sum(F.col("a") * F.col("a")).alias("na"),
                                       F.sum(F.col("b") * F.col("b")).alias("nb"))
        sim = F.when((F.col("na") > 0) & (F.col("nb") > 0),
                     F.col("dot") / (F.sqrt("na") * F.sqrt("nb"))).otherwise(F.lit(0.0))
        return per.agg(F.greatest(F.lit(0.0), F.avg(sim)).alias("consistency")).select(
            F.lit(metric).alias("metric"), "consistency")
    diff = F.col("a") - F.col("b")
    dist = F.sqrt(F.sum(diff * diff)) if metric == "euclidean" else F.sum(F.abs(diff))
    per = j.groupBy(*key_cols).agg(dist.alias("dist"))
    return per.agg(F.greatest(F.lit(0.0), F.lit(1.0) - F.avg("dist") / (F.max("dist") + F.lit(DIST_EPS)))
                   .alias("consistency")).select(F.lit(metric).alias("metric"), "consistency")


def top_features(exp: DataFrame, key_cols: Sequence[str], top_k: int) -> DataFrame:
    """(keys, top): the ``top_k`` features by |value| per row (ties by name)."""
    w = Window.partitionBy(*key_cols).orderBy(F.abs(F.col("value")).desc(), F.col("feature"))
    return (exp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
            .groupBy(*key_cols).agg(F.collect_set("feature").alias("top")))


def explanation_fidelity(rows: DataFrame, exp: DataFrame, key_cols: Sequence[str],
                         features: Sequence[str], scorer, top_k: int = 5,
                         baseline: float = 0.0) -> DataFrame:
    """Mean |p(x) - p(x with its top-k features set to ``baseline``)|,
    one batch rescoring of all rows (0 in scaled space = the train mean)."""
    top = top_features(exp, key_cols, top_k)
    j = rows.select(*key_cols, *features).join(top, list(key_cols), "left")
    masked = {f: F.when(F.array_contains(F.coalesce("top", F.array().cast("array<string>")), F.lit(f)),
                        F.lit(float(baseline))).otherwise(F.col(f)) for f in features}
    if hasattr(scorer, "proba"):
        scored = j.select(*key_cols, scorer.proba().alias("_p0"), scorer.proba(masked).alias("_p1"))
    else:
        orig = scorer.score(j.select(*key_cols, *features), "_p0")
        pert = scorer.score(j.select(*key_cols, *[masked[f].alias(f) for f in features]), "_p1")
        scored = orig.select(*key_cols, "_p0").join(pert.select(*key_cols, "_p1"), list(key_cols))
    return scored.agg(F.coalesce(F.avg(F.abs(F.col("_p0") - F.col("_p1"))), F.lit(0.0)).alias("fidelity"))


def feature_agreement(imp1: DataFrame, imp2: DataFrame, top_k: int = 10) -> DataFrame:
    """Jaccard similarity of the two top-k feature sets; 0 when both empty."""
    def top(imp: DataFrame, name: str) -> DataFrame:
        w = Window.orderBy(F.col("importance").desc(), F.col("feature"))
        return (imp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top_k)
                .select("feature", F.lit(1).alias(name)))
    j = top(imp1, "in1").join(top(imp2, "in2"), "feature", "full_outer")
    return j.agg(F.when(F.count(F.lit(1)) > 0,
                        F.sum((F.col("in1").isNotNull() & F.col("in2").isNotNull()).cast("long"))
                        / F.count(F.lit(1))).otherwise(F.lit(0.0)).alias("agreement"))


def explanation_complexity(exp: DataFrame, key_cols: Sequence[str],
                           threshold: float = COMPLEXITY_THRESHOLD) -> DataFrame:
    """Mean number of features per row with |value| strictly above threshold."""
    per = exp.groupBy(*key_cols).agg(
        F.sum((F.abs(F.col("value")) > F.lit(threshold)).cast("long")).alias("_n"))
    return per.agg(F.coalesce(F.avg("_n"), F.lit(0.0)).alias("complexity"))


def importance_runs(phi: DataFrame, key_cols: Sequence[str], seeds: Sequence[int] = (42, 43, 44),
                    subset: int = 50, feature: str = "feature", value: str = "phi",
                    rows: DataFrame | None = None) -> DataFrame:
    """Run 0: mean |phi| over all rows; run k: over a hash sample of
    ``subset`` rows with seed ``seeds[k-1]`` (keys drawn from ``rows``)."""
    from .attribution import shap_importance
    keys = (rows if rows is not None else phi).select(*key_cols).distinct()
    runs = [shap_importance(phi, feature, value).select(F.lit(0).alias("run"), "feature", "importance")]
    for k, seed in enumerate(seeds, start=1):
        sub = hash_sample(keys, subset, key_cols, seed)
        part = phi.join(sub, list(key_cols), "left_semi")
        runs.append(shap_importance(part, feature, value).select(F.lit(k).alias("run"), "feature", "importance"))
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out


def compare_importances(imp_a: DataFrame, imp_b: DataFrame) -> DataFrame:
    """Outer join on feature, missing -> 0, each side divided by its own max."""
    j = (imp_a.select("feature", F.col("importance").alias("a"))
         .join(imp_b.select("feature", F.col("importance").alias("b")), "feature", "full_outer")
         .fillna(0.0, subset=["a", "b"]))
    mx = j.agg(F.max("a").alias("_ma"), F.max("b").alias("_mb"))
    out = _one_row(j, mx)

    def norm(c: str, m: str) -> Column:
        return F.when(F.col(m) != 0, F.col(c) / F.col(m)).otherwise(F.lit(0.0))
    return out.select("feature", F.col("a").alias("importance_a"), F.col("b").alias("importance_b"),
                      norm("a", "_ma").alias("normalized_a"), norm("b", "_mb").alias("normalized_b"))


def all_interpretability_metrics(runs: DataFrame, shap_exp: DataFrame, local_exp: DataFrame,
                                 rows: DataFrame, key_cols: Sequence[str], features: Sequence[str],
                                 scorer) -> DataFrame:
    """Long (metric, value): stability x2, consistency, agreement @5/@10
    (first two runs), fidelity and complexity for both explanation sets."""
    parts = [
        importance_stability(runs, "spearman").select(F.lit("importance_stability_spearman").alias("metric"), "value"),
        importance_stability(runs, "kendall").select(F.lit("importance_stability_kendall").alias("metric"), "value"),
        explanation_consistency(shap_exp, local_exp, key_cols).select(
            F.lit("shap_lime_consistency").alias("metric"), F.col("consistency").alias("value")),
    ]
    r0 = runs.where(F.col("run") == 0)
    r1 = runs.where(F.col("run") == 1)
    for k in (5, 10):
        parts.append(feature_agreement(r0, r1, k).select(F.lit(f"feature_agreement_top{k}").alias("metric"),
                                                         F.col("agreement").alias("value")))
    for name, e in (("shap", shap_exp), ("lime", local_exp)):
        parts.append(explanation_fidelity(rows, e, key_cols, features, scorer, 5).select(
            F.lit(f"{name}_fidelity").alias("metric"), F.col("fidelity").alias("value")))
        parts.append(explanation_complexity(e, key_cols).select(
            F.lit(f"{name}_complexity").alias("metric"), F.col("complexity").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
