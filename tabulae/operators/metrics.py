"""Evaluation metrics over scored tables, for any grouping (split, fold, run, model).

Input is a *scored* DataFrame: a 0/1 ``label`` column, a probability
column ``p`` and optionally hard predictions. Every metric is one or two
aggregation jobs; curve metrics (ROC-AUC, average precision, PR curve)
first collapse rows to distinct scores per group, then take exact running
sums with the bucketed primitive, so no group is ever sorted in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.running import running_sums
from ..session import reuse

# Metric names and their report order.
LABEL_METRICS = ["accuracy", "precision", "recall", "f1"]
SCORE_METRICS = ["pr_auc", "roc_auc", "brier_score"]
DEFAULT_METRICS = LABEL_METRICS + SCORE_METRICS
F1_EPS = 1e-12


def _safe_div(num: Column, den: Column) -> Column:
    return F.when(den != 0, num / den).otherwise(F.lit(0.0))


def threshold_labels(p: str | Column = "p", threshold: float = 0.5) -> Column:
    """Hard labels when the model gives none: ``p >= threshold``."""
    col = F.col(p) if isinstance(p, str) else p
    return (col >= F.lit(threshold)).cast("int")


def confusion_counts(df: DataFrame, label: str = "label", pred: str = "pred",
                     groups: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, tn per group (positive class 1), one aggregation."""
    y = F.col(label) == 1
    yh = F.col(pred) == 1
    return df.groupBy(*groups).agg(
        F.sum((y & yh).cast("long")).alias("tp"),
        F.sum((~y & yh).cast("long")).alias("fp"),
        F.sum((y & ~yh).cast("long")).alias("fn"),
        F.sum((~y & ~yh).cast("long")).alias("tn"),
    )


def label_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                  groups: Sequence[str] = ()) -> DataFrame:
    """accuracy, precision, recall, F1 on class 1; 0 where undefined."""
    c = confusion_counts(df, label, pred, groups)
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    prec = _safe_div(tp, tp + fp)
    rec = _safe_div(tp, tp + fn)
    return c.select(
        *groups, "tp", "fp", "fn", "tn",
        _safe_div(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        prec.alias("precision"),
        rec.alias("recall"),
        _safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def weighted_label_metrics(df: DataFrame, label: str = "label", pred: str = "pred",
                           groups: Sequence[str] = ()) -> DataFrame:
    """Support-weighted precision / recall / F1 over all classes (multiclass)."""
    conf = df.groupBy(*groups, label, pred).agg(F.count(F.lit(1)).alias("n"))
    by_true = conf.groupBy(*groups, F.col(label).alias("cls")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col(label) == F.col(pred), F.col("n")).otherwise(0)).alias("tp"))
    by_pred = conf.groupBy(*groups, F.col(pred).alias("cls")).agg(F.sum("n").alias("predicted"))
    per = (by_true.join(by_pred, [*groups, "cls"], "full_outer")
           .fillna(0, subset=["support", "tp", "predicted"]))
    tp, sup, prd = (F.col(x).cast("double") for x in ("tp", "support", "predicted"))
    p_c = _safe_div(tp, prd)
    r_c = _safe_div(tp, sup)
    f_c = _safe_div(2 * tp, sup + prd)
    total = F.sum(sup)
    return per.groupBy(*groups).agg(
        (F.sum(tp) / total).alias("accuracy"),
        (F.sum(p_c * sup) / total).alias("precision_weighted"),
        (F.sum(r_c * sup) / total).alias("recall_weighted"),
        (F.sum(f_c * sup) / total).alias("f1_weighted"),
    )


def score_counts(df: DataFrame, label: str = "label", score: str = "p",
                 groups: Sequence[str] = ()) -> DataFrame:
    """One row per (group, distinct score) with positive/negative counts."""
    y = F.col(label) == 1
    return df.groupBy(*groups, score).agg(
        F.sum(y.cast("long")).alias("pos"),
        F.sum((~y).cast("long")).alias("neg"),
    )


def binary_curve(df: DataFrame, label: str = "label", score: str = "p",
                 groups: Sequence[str] = (), counts: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """Per (group, threshold): counts at ``score >= threshold`` and the
    running totals needed by ROC-AUC, average precision and the PR curve.

    The score histogram (one row per group and distinct score) is the only
    thing read more than once, so it is checkpointed; the scored table is
    scanned a single time. ``counts`` passes a histogram already built, of
    which the columns ``carry`` are kept.
    """
    h = counts if counts is not None else reuse(score_counts(df, label, score, groups))
    cum = running_sums(h, score, ["pos", "neg"], groups, totals_prefix="tot_")
    tp = F.col("tot_pos") - F.col("cum_pos") + F.col("pos")
    fp = F.col("tot_neg") - F.col("cum_neg") + F.col("neg")
    return cum.select(
        *groups, F.col(score).alias("threshold"), "pos", "neg", "cum_pos", "cum_neg",
        "tot_pos", "tot_neg", *carry, tp.alias("tp"), fp.alias("fp"),
        (tp / (tp + fp)).alias("precision"),
        F.when(F.col("tot_pos") > 0, tp / F.col("tot_pos")).otherwise(F.lit(1.0)).alias("recall"),
    )


def curve_metrics(curve: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC (ties count half) and average precision (step sum) per group."""
    P = F.max("tot_pos").cast("double")
    N = F.max("tot_neg").cast("double")
    auc = F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))) / (P * N)
    ap = F.sum(F.col("pos") * F.col("precision")) / P
    return curve.groupBy(*groups).agg(
        F.when((P > 0) & (N > 0), auc).alias("roc_auc"),
        F.when(P > 0, ap).alias("pr_auc"),
    )


def roc_auc(df: DataFrame, label: str = "label", score: str = "p",
            groups: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(binary_curve(df, label, score, groups), groups).select(*groups, "roc_auc")


def pr_auc(df: DataFrame, label: str = "label", score: str = "p",
           groups: Sequence[str] = ()) -> DataFrame:
    return curve_metrics(binary_curve(df, label, score, groups), groups).select(*groups, "pr_auc")


def brier_score(df: DataFrame, label: str = "label", score: str = "p",
                groups: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*groups).agg(
        F.avg(F.pow(F.col(score) - F.col(label).cast("double"), 2)).alias("brier_score"))


def pr_curve(df: DataFrame, label: str = "label", score: str = "p",
             groups: Sequence[str] = ()) -> DataFrame:
    """(threshold, precision, recall) over all distinct scores; the end
    point (precision 1, recall 0) has a null threshold."""
    curve = binary_curve(df, label, score, groups).select(*groups, "threshold", "precision", "recall")
    ends = curve.select(*groups).distinct().select(
        *groups, F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return curve.unionByName(ends)


def precision_at_recall_from_curve(curve: DataFrame, target: float = 0.8,
                                   groups: Sequence[str] = (), compat: bool = False) -> DataFrame:
    hit = curve.where(F.col("recall") >= F.lit(target))
    pick = F.min_by if compat else F.max_by
    got = hit.groupBy(*groups).agg(pick("precision", "threshold").alias("precision_at_recall"))
    if not groups:
        # One row even when no threshold reaches the target.
        return got.groupBy().agg(
            F.coalesce(F.max("precision_at_recall"), F.lit(0.0)).alias("precision_at_recall"))
    keys = curve.select(*groups).distinct()
    return keys.join(got, list(groups), "left").fillna(0.0, subset=["precision_at_recall"])


def precision_at_recall(df: DataFrame, target: float = 0.8, label: str = "label",
                        score: str = "p", groups: Sequence[str] = (),
                        compat: bool = False) -> DataFrame:
    """Precision at the highest threshold whose recall reaches ``target``
    (``compat=True``: the lowest threshold, as the reference does); 0 if none."""
    return precision_at_recall_from_curve(binary_curve(df, label, score, groups), target, groups, compat)


def f1_max(df: DataFrame, label: str = "label", score: str = "p",
           groups: Sequence[str] = ()) -> DataFrame:
    """max 2PR/(P+R+1e-12) over the PR curve (end point included: F1 0)."""
    curve = binary_curve(df, label, score, groups)
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(F1_EPS))
    return curve.groupBy(*groups).agg(F.greatest(F.max(f1), F.lit(0.0)).alias("f1_max"))


def evaluate_by(df: DataFrame, groups: Sequence[str] = (), label: str = "label",
                score: str = "p", pred: str | None = None, threshold: float = 0.5,
                metrics: Sequence[str] = DEFAULT_METRICS,
                extra: Sequence[str] = ()) -> DataFrame:
    """All requested metrics per group as a long table (groups, metric, value).

    One pass over the scored table builds a histogram per (group, score) with
    positive / negative counts, all and those predicted positive (map-side
    combined, checkpointed). One pass over the curve of that histogram then gives
    every metric in a single aggregate per group. ``extra`` may hold
    ``precision_at_recall`` and ``f1_max``.
    """
    yhat = (F.col(pred) if pred else threshold_labels(score, threshold)) == 1
    y = F.col(label) == 1
    hist = reuse(df.groupBy(*groups, F.col(score).alias(score)).agg(
        F.sum(y.cast("long")).alias("pos"), F.sum((~y).cast("long")).alias("neg"),
        F.coalesce(F.sum((y & yhat).cast("long")), F.lit(0)).alias("pos_hat"),
        F.coalesce(F.sum((~y & yhat).cast("long")), F.lit(0)).alias("neg_hat")))
    hats = ["pos_hat", "neg_hat"]
    if extra or any(m in ("pr_auc", "roc_auc") for m in metrics):
        curve = binary_curve(df, label, score, groups, counts=hist, carry=hats).withColumnRenamed("threshold", "_s")
    else:
        curve = hist.withColumnRenamed(score, "_s")
    tp, fp = F.sum("pos_hat").cast("double"), F.sum("neg_hat").cast("double")
    P, N = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    precision, recall = F.col("precision"), F.col("recall")
    reached = recall >= 0.8
    s = F.col("_s").cast("double")
    of = {
        "accuracy": lambda: _safe_div(tp + N - fp, P + N), "precision": lambda: _safe_div(tp, tp + fp),
        "recall": lambda: _safe_div(tp, P), "f1": lambda: _safe_div(2 * tp, tp + fp + P),
        "roc_auc": lambda: F.when((P > 0) & (N > 0), F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg"))) / (P * N)),
        "pr_auc": lambda: F.when(P > 0, F.sum(F.col("pos") * precision) / P),
        "brier_score": lambda: F.sum(F.col("pos") * (s - 1) * (s - 1) + F.col("neg") * s * s) / (P + N),
        "f1_max": lambda: F.greatest(F.max(2 * precision * recall / (precision + recall + F.lit(F1_EPS))), F.lit(0.0)),
        "precision_at_recall": lambda: F.coalesce(F.max_by(F.when(reached, precision), F.when(reached, F.col("_s"))), F.lit(0.0)),
    }
    names = [m for m in DEFAULT_METRICS if m in metrics] + [m for m in ("f1_max", "precision_at_recall") if m in extra]
    wide = curve.groupBy(*groups).agg(*[of[m]().alias(f"_m_{m}") for m in names])
    stacked = F.stack(F.lit(len(names)), *[x for m in names for x in (F.lit(m), F.col(f"_m_{m}").cast("double"))])
    return wide.select(*groups, stacked.alias("metric", "value"))


def roc_auc_ovr_weighted(df: DataFrame, label: str, proba: str, n_classes: int,
                         groups: Sequence[str] = ()) -> DataFrame:
    """Multiclass one-vs-rest ROC-AUC weighted by class prevalence.

    ``label`` holds class indices 0..K-1 and ``proba`` an array of K
    probabilities. Rows are exploded to (class, p_class) and the binary
    curve runs grouped by class.
    """
    ex = df.select(*groups, label, F.posexplode_outer(F.col(proba)).alias("cls", "p_cls"))
    ex = ex.withColumn("y_cls", (F.col(label) == F.col("cls")).cast("int"))
    curve = binary_curve(ex, "y_cls", "p_cls", [*groups, "cls"])
    per = curve.groupBy(*groups, "cls").agg(
        F.max("tot_pos").alias("support"),
        F.when((F.max("tot_pos") > 0) & (F.max("tot_neg") > 0),
               F.sum(F.col("pos") * (F.col("cum_neg") - 0.5 * F.col("neg")))
               / (F.max("tot_pos").cast("double") * F.max("tot_neg"))).alias("roc_auc"))
    return per.groupBy(*groups).agg(
        (F.sum(F.col("roc_auc") * F.col("support")) / F.sum("support")).alias("roc_auc_ovr_weighted"))


def aggregate_folds(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per metric: mean (nulls skipped), population std, min and max over folds."""
    return long.groupBy(*groups, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count("value").alias("n"))


def aggregate_runs(long: DataFrame, run: str = "run", groups: Sequence[str] = ()) -> DataFrame:
    """Per metric: mean and population std over repeats; values in run order."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(run), F.col("value")))),
                          lambda s: s["value"])
    return long.groupBy(*groups, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
        ordered.alias("runs"))


def kd_loss(df: DataFrame, teacher_logits: str, student_logits: str, label: str,
            alpha: float = 0.7, temperature: float = 2.0,
            groups: Sequence[str] = ()) -> DataFrame:
    """alpha*T^2*mean KL(softmax(t/T) || softmax(s/T)) + (1-alpha)*mean CE(s, y)."""
    T = float(temperature)

    def log_softmax(arr: Column, scale: float) -> Column:
        scaled = F.transform(arr, lambda x: x / F.lit(scale))
        m = F.array_max(scaled)
        lse = m + F.log(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
        return F.transform(scaled, lambda x: x - lse)

    lt = log_softmax(F.col(teacher_logits), T)
    ls = log_softmax(F.col(student_logits), T)
    kl = F.aggregate(F.arrays_zip(lt.alias("t"), ls.alias("s")), F.lit(0.0),
                     lambda acc, z: acc + F.exp(z["t"]) * (z["t"] - z["s"]))
    ce = -F.element_at(log_softmax(F.col(student_logits), 1.0), F.col(label).cast("int") + 1)
    return df.groupBy(*groups).agg(
        (F.lit(alpha * T * T) * F.avg(kl) + F.lit(1.0 - alpha) * F.avg(ce)).alias("kd_loss"),
        F.avg(kl).alias("kl"), F.avg(ce).alias("ce"))


def model_comparison(long: DataFrame, metrics: Sequence[str], model: str = "model") -> DataFrame:
    """Models x metrics wide table from a long (model, metric, value) table."""
    return long.groupBy(model).pivot("metric", list(metrics)).agg(F.first("value"))


def improvement(long: DataFrame, baseline: str, candidate: str, model: str = "model") -> DataFrame:
    """100 * (candidate - baseline) per metric."""
    b = long.where(F.col(model) == baseline).select("metric", F.col("value").alias("baseline"))
    c = long.where(F.col(model) == candidate).select("metric", F.col("value").alias("candidate"))
    j = b.join(c, "metric")
    return j.select("metric", "baseline", "candidate",
                    (F.lit(100.0) * (F.col("candidate") - F.col("baseline"))).alias("improvement"))


# Neighbouring ranges that an isotonic fit merges at a time, and blocks that it may
# end with: they are broadcast to apply it (16 bytes each).
ISOTONIC_FAN_IN, MAX_BLOCKS = 8, 1 << 20


@dataclass(frozen=True)
class IsotonicFit:
    """Non-decreasing map of scores: linear between ``boundaries``, constant
    outside."""

    boundaries: np.ndarray
    predictions: np.ndarray


def pool_violators(low: np.ndarray, high: np.ndarray, total: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    """Blocks (lowest score, highest, sum of labels, weight) in ascending order of
    scores, with neighbours pooled until the means rise strictly. Pooling what
    was pooled range by range gives the blocks of the whole, so blocks merge."""
    out: list[list[float]] = []
    for block in zip(low.tolist(), high.tolist(), total.tolist(), weight.tolist(), strict=True):
        block = list(block)
        while out and out[-1][2] * block[3] >= block[2] * out[-1][3]:
            first = out.pop()
            block = [first[0], block[1], first[2] + block[2], first[3] + block[3]]
        out.append(block)
    return [np.array(c) for c in zip(*out, strict=True)] if out else [np.zeros(0)] * 4


_BLOCK_COLUMNS = ["low", "high", "total", "weight"]


def isotonic_blocks(df: DataFrame, label: str = "label", score: str = "p", weight: str | None = None) -> DataFrame:
    """(low, high, total, weight): the blocks of the isotonic regression of
    ``label`` on ``score``, by pool-adjacent-violators.

    Rows collapse to one per distinct score (partial sums first, so a score that
    most rows share is one row). Scores are dealt by range; each range pools its
    own violators, and neighbouring ranges' blocks are merged and pooled again,
    ``ISOTONIC_FAN_IN`` at a time, until one list is left. Only blocks travel
    after the first pass, and nothing reaches the driver. Rows with a null label or
    weight, a null or NaN score or no positive weight take no part."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(score).cast("double").alias("low"), F.col(label).cast("double").alias("y"), w.alias("w"))
    rows = rows.where("low IS NOT NULL AND NOT isnan(low) AND y IS NOT NULL AND w > 0")
    hist = rows.groupBy("low").agg(F.sum(F.col("y") * F.col("w")).alias("total"), F.sum("w").alias("weight"))
    ranges = hist.repartitionByRange(F.col("low")).sortWithinPartitions("low")

    def pooled(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(dict(zip(_BLOCK_COLUMNS, pool_violators(*[pdf[c].to_numpy() for c in _BLOCK_COLUMNS]))))

    def local(batches):
        part, parts = TaskContext.get().partitionId(), [pdf for pdf in batches if len(pdf)]
        if parts:
            pdf = pd.concat(parts)
            yield pooled(pdf.assign(high=pdf["low"])).assign(range=part)

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pooled(pdf.sort_values("low")).assign(range=key[0])

    schema = "low double, high double, total double, weight double, range long"
    blocks = reuse(ranges.mapInPandas(local, schema))
    left = (blocks.agg(F.max("range")).first()[0] or 0) + 1
    while left > 1:
        blocks = (blocks.withColumn("range", F.expr(f"range div {ISOTONIC_FAN_IN}")).groupBy("range")
                  .applyInPandas(merged, schema))
        left = -(-left // ISOTONIC_FAN_IN)
    return blocks.drop("range")


def fit_isotonic(df: DataFrame, label: str = "label", score: str = "p", weight: str | None = None) -> IsotonicFit:
    """Isotonic p -> calibrated p from ``isotonic_blocks``: a block's mean holds from
    its lowest to its highest score. No usable rows are an error."""
    blocks = reuse(isotonic_blocks(df, label, score, weight))
    n = blocks.count()
    if not 0 < n <= MAX_BLOCKS:
        raise ValueError("no rows to calibrate on" if not n else f"{n} blocks: round the scores first")
    pdf = blocks.orderBy("low").toPandas()
    mean = (pdf["total"] / pdf["weight"]).to_numpy()
    ends = np.stack([pdf["low"], pdf["high"]], axis=1)
    keep = np.stack([np.ones(n, bool), ends[:, 0] < ends[:, 1]], axis=1)
    return IsotonicFit(ends[keep], np.repeat(mean[:, None], 2, axis=1)[keep])


def apply_isotonic(model: IsotonicFit, df: DataFrame, score: str = "p", out: str = "p_cal") -> DataFrame:
    """Adds ``out``: the calibrated score (null for a null or NaN score)."""
    shared = df.sparkSession.sparkContext.broadcast((model.boundaries, model.predictions))

    @F.pandas_udf("double")
    def calibrated(p: pd.Series) -> pd.Series:
        x, y = shared.value
        return pd.Series(np.where(p.isna(), np.nan, np.interp(p.to_numpy(dtype=float), x, y)))

    return df.withColumn(out, F.nanvl(calibrated(F.col(score).cast("double")), F.lit(None).cast("double")))


def calibrated_metrics(calibration: DataFrame, test: DataFrame, groups: Sequence[str] = (), label: str = "label",
                       score: str = "p", threshold: float = 0.5, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """``evaluate_by`` of ``test`` before and after the isotonic fit of
    ``calibration`` (key column ``calibrated``)."""
    after = apply_isotonic(fit_isotonic(calibration, label, score), test, score, "_calibrated")
    keep = [*groups, F.col(label).alias(label)]
    both = after.select(*keep, F.col(score).cast("double").alias(score), F.lit(False).alias("calibrated")).unionByName(
        after.select(*keep, F.col("_calibrated").alias(score), F.lit(True).alias("calibrated")))
    return evaluate_by(both, [*groups, "calibrated"], label, score, threshold=threshold, metrics=metrics)


def rank_within(df: DataFrame, order: Sequence[Column], groups: Sequence[str], name: str = "rn") -> DataFrame:
    """row_number inside small groups (features per run, terms per row)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
