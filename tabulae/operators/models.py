"""Model training and scoring on Spark ML.

One boosted-tree operator with presets stands in for the reference's four
boosted-tree wrappers; options without a Spark counterpart (L1/L2 terms,
gamma, leaf counts) are reported and ignored. Training data stays a
DataFrame; only the fitted model reaches the driver.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier,
                                       OneVsRest)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scorers import LinearScorer, SoftmaxScorer
from ..session import discard, reuse

# Boosted-tree defaults (100 trees, depth 6, rate 0.1, seed 42;
# the plain gradient-boosting preset uses depth 3) and named presets.
GBT_DEFAULTS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "seed": 42}
GBT_PRESETS = {
    "default": {},
    "plain": {"maxDepth": 3},
    "shallow": {"maxDepth": 3},
    "deep": {"maxDepth": 10, "maxIter": 200},
    "regularized": {"minInstancesPerNode": 5, "subsamplingRate": 0.8, "featureSubsetStrategy": "sqrt"},
    "fast": {"maxIter": 20, "maxDepth": 4},
}
_PARAM_ALIASES = {"n_estimators": "maxIter", "max_depth": "maxDepth", "learning_rate": "stepSize",
                  "subsample": "subsamplingRate", "random_state": "seed", "min_child_samples": "minInstancesPerNode"}
FEATURES_COL = "features"


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=FEATURES_COL, handleInvalid="keep")


def gbt_params(preset: str = "default", params: Mapping | None = None) -> dict:
    out = {**GBT_DEFAULTS, **GBT_PRESETS[preset]}
    for k, v in (params or {}).items():
        key = _PARAM_ALIASES.get(k, k)
        if GBTClassifier().hasParam(key):
            out[key] = v
        else:
            warnings.warn(f"boosted-tree option {k!r} has no Spark counterpart; ignored", stacklevel=2)
    return out


def train_boosted_trees(df: DataFrame, features: Sequence[str], label: str = "label",
                        preset: str = "default", params: Mapping | None = None,
                        n_classes: int = 2, validation_col: str | None = None) -> PipelineModel:
    """GBT (binary) or one-vs-rest GBT (multiclass) in a pipeline with the
    feature assembler. ``validation_col`` enables early stopping."""
    p = gbt_params(preset, params)
    gbt = GBTClassifier(featuresCol=FEATURES_COL, labelCol=label, **p)
    if validation_col:
        gbt = gbt.setValidationIndicatorCol(validation_col)
    est = gbt if n_classes == 2 else OneVsRest(classifier=gbt, featuresCol=FEATURES_COL, labelCol=label)
    return Pipeline(stages=[_assembler(features), est]).fit(df.withColumn(label, F.col(label).cast("double")))


def train_mlp(df: DataFrame, features: Sequence[str], label: str = "label",
              hidden: Sequence[int] = (64, 32), n_classes: int = 2, max_iter: int = 100,
              seed: int = 42, step_size: float = 0.03) -> PipelineModel:
    """Feed-forward network (sigmoid hidden units, softmax output)."""
    mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES_COL, labelCol=label,
                                         layers=[len(features), *hidden, n_classes],
                                         maxIter=max_iter, seed=seed, stepSize=step_size)
    return Pipeline(stages=[_assembler(features), mlp]).fit(df.withColumn(label, F.col(label).cast("double")))


def train_logistic(df: DataFrame, features: Sequence[str], label: str = "label",
                   weight: str | None = None, reg: float = 0.0, max_iter: int = 100) -> PipelineModel:
    lr = LogisticRegression(featuresCol=FEATURES_COL, labelCol=label, regParam=reg, maxIter=max_iter,
                            family="multinomial")
    if weight:
        lr = lr.setWeightCol(weight)
    return Pipeline(stages=[_assembler(features), lr]).fit(df.withColumn(label, F.col(label).cast("double")))


def train_discriminant(df: DataFrame, features: Sequence[str], label: str = "label", shrink: float = 0.0,
                       prior: str = "empirical", decimals: int | None = None) -> LinearScorer:
    """Diagonal linear discriminant of two classes, as a scorer: weights are the
    difference of the class means over the variance plus ``shrink``; ``prior`` is
    ``empirical`` (class shares) or ``equal``. One aggregate; both classes must be
    there. A feature that neither varies nor is shrunk weighs nothing."""
    x = {f: F.col(f).cast("double") for f in features}
    one = F.col(label) == 1
    got = df.where(F.col(label).isNotNull()).agg(
        F.sum(one.cast("long")).alias("n1"), F.sum((~one).cast("long")).alias("n0"),
        *[e for f in features for e in (F.avg(F.when(one, x[f])).alias(f"1_{f}"), F.avg(F.when(~one, x[f])).alias(f"0_{f}"),
                                        F.var_pop(x[f]).alias(f"v_{f}"))]).first()
    if not got["n1"] or not got["n0"]:
        raise ValueError("a discriminant needs rows of both classes")
    spread = {f: (got[f"v_{f}"] or 0.0) + shrink for f in features}
    w = {f: (got[f"1_{f}"] - got[f"0_{f}"]) / spread[f] if spread[f] > 0 else 0.0 for f in features}
    middle = sum(w[f] * (got[f"1_{f}"] + got[f"0_{f}"]) / 2 for f in features)
    share = math.log(got["n1"] / got["n0"]) if prior == "empirical" else 0.0
    return LinearScorer(w, share - middle, decimals, "discriminant")


def predict_proba(model: PipelineModel, df: DataFrame, n_classes: int = 2, out: str = "proba") -> DataFrame:
    """Adds ``out`` (array of class probabilities), ``p`` (class 1, or the largest
    with more classes) and ``pred``. One-vs-rest models score every row by each
    of their binary models; the probabilities of their classes are scaled to sum
    to one. Models without any give the hard label as score."""
    if isinstance(model, SoftmaxStudent):
        scored = df.withColumn(out, model.scorer().proba_array())
        return scored.withColumn("p", F.col(out)[1] if n_classes == 2 else F.array_max(out)).withColumn(
            "pred", (F.array_position(out, F.array_max(out)) - 1).cast("int"))
    last = model.stages[-1]
    if hasattr(last, "models"):
        scored = PipelineModel(model.stages[:-1]).transform(df)
        for k, binary in enumerate(last.models):
            binary = binary.copy()
            for name in ("probability", "rawPrediction", "prediction"):
                binary._set(**{f"{name}Col": f"_{name}{k}"})
            scored = binary.transform(scored).drop(f"_rawPrediction{k}", f"_prediction{k}")
        each = [vector_to_array(F.col(f"_probability{k}"))[1] for k in range(len(last.models))]
        total = sum(each[1:], each[0])
        arr = F.array(*[F.when(total > 0, p / total).otherwise(1.0 / len(each)) for p in each])
        scored = scored.select(*[F.col(f"`{c}`") for c in df.columns], arr.alias(out))
        top = F.array_max(out)
        return scored.withColumn("p", F.col(out)[1] if n_classes == 2 else top).withColumn(
            "pred", (F.array_position(out, top) - 1).cast("int"))
    scored = model.transform(df)
    if last.hasParam("probabilityCol") and "probability" in scored.columns:
        arr = vector_to_array(F.col(last.getProbabilityCol()))
        res = scored.withColumn(out, arr)
        res = res.withColumn("p", F.col(out)[1] if n_classes == 2 else F.array_max(out))
    else:
        res = scored.withColumn(out, F.lit(None).cast("array<double>")).withColumn(
            "p", F.col("prediction").cast("double"))
    keep = [c for c in df.columns] + [out, "p"]
    return res.select(*keep, F.col("prediction").cast("int").alias("pred"))


def native_importance(model: PipelineModel, features: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) sorted desc; models without importances give 1/d."""
    last = model.stages[-1]
    if hasattr(last, "featureImportances"):
        vals = last.featureImportances.toArray().tolist()
    elif hasattr(last, "models"):  # one-vs-rest: average over the binary models
        arrs = [m.featureImportances.toArray() for m in last.models]
        vals = (sum(arrs) / len(arrs)).tolist()
    else:
        vals = [1.0 / len(features)] * len(features)
    return sorted(zip(features, vals), key=lambda t: (-t[1], t[0]))


def distillation_rows(df: DataFrame, teacher_proba: str, label: str, n_classes: int = 2,
                      alpha: float = 0.7, temperature: float = 1.0) -> DataFrame:
    """Each row replicated per class c with weight alpha * q_t(c) + (1 - alpha) * [y = c],
    q_t = teacher probabilities sharpened/softened by 1/T (normalised).
    A weighted classifier fitted on these rows minimises the blended
    soft-target / hard-label cross entropy of ``distill`` for T = 1 (for other
    temperatures the student has to be softened too: use ``distill``)."""
    t = float(temperature)
    q = F.transform(F.col(teacher_proba), lambda x: F.pow(x, F.lit(1.0 / t)))
    tot = F.aggregate(q, F.lit(0.0), lambda a, x: a + x)
    ex = df.select("*", F.posexplode_outer(q).alias("_cls", "_q"), tot.alias("_tot"))
    w = F.lit(alpha) * F.col("_q") / F.col("_tot") + F.lit(1.0 - alpha) * (F.col(label) == F.col("_cls")).cast("double")
    return ex.select(*[c for c in df.columns if c != label], F.col("_cls").cast("double").alias(label),
                     w.alias("weight"))


@dataclass(frozen=True)
class SoftmaxStudent:
    """Linear softmax model: logits = x @ weights + bias (one column a class).
    ``history`` holds the objective after each pass over the data."""

    features: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    history: tuple[float, ...] = ()

    def scorer(self, decimals: int | None = None) -> SoftmaxScorer:
        return SoftmaxScorer([str(k) for k in range(len(self.bias))], dict(zip(self.features, self.weights)), self.bias, decimals)

    def logits(self) -> Column:
        return F.array(*self.scorer().logits())


def _soft(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(softmax, log-softmax) of the rows of ``z``."""
    log = z - z.max(axis=1, keepdims=True)
    log -= np.log(np.exp(log).sum(axis=1, keepdims=True))
    return np.exp(log), log


def distill(train: DataFrame, teacher, features: Sequence[str], label: str = "label", alpha: float = 0.7,
            temperature: float = 2.0, n_classes: int = 2, max_iter: int = 50, tol: float = 1e-9,
            ridge: float = 1e-6) -> SoftmaxStudent:
    """Linear softmax student of ``teacher`` (a pipeline model, or the name of a
    column of ``train`` with its class probabilities): the minimum of

        alpha T^2 mean KL(q_T || softmax(z / T)) + (1 - alpha) mean CE(y, softmax(z)),

    q_T being the teacher's probabilities softened by T, as ``metrics.kd_loss``
    computes it, plus ``ridge`` / 2 times the squared weights of standardised
    features. Features, teacher and label are written once; each Newton step is one pass
    over them in which every Arrow batch returns its sums of the objective,
    gradient and Hessian (classes x features squared, whatever the rows), with the
    step halved while the objective would rise. Rows with a null label, teacher or
    feature take no part; no rows are an error."""
    t, d, k = float(temperature), len(features), n_classes
    if isinstance(teacher, str):
        rows = train.withColumn("_teacher", F.col(teacher))
    else:
        rows = predict_proba(teacher, train.select(*features, label), k, out="_teacher")
    rows = rows.select(F.array(*[F.col(f).cast("double") for f in features]).alias("x"), "_teacher", F.col(label).cast("int").alias("y"))
    rows = reuse(rows.where(F.col("y").isNotNull() & F.col("_teacher").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
    stats = rows.select(F.posexplode("x")).groupBy("pos").agg(F.count("*").alias("n"), F.avg("col").alias("mean"),
                                                              F.stddev_pop("col").alias("std")).orderBy("pos").collect()
    if not stats:
        raise ValueError("no complete rows to distill from")
    n = stats[0]["n"]
    mean = np.array([s["mean"] for s in stats])
    std = np.array([s["std"] or 1.0 for s in stats])

    def sums(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Objective, gradient and Hessian at ``w`` ((features + 1) x classes)."""
        def run(batches):
            total, grad, hess = 0.0, np.zeros((d + 1, k)), np.zeros(((d + 1) * k,) * 2)
            for pdf in batches:
                x = np.hstack([(np.stack(pdf["x"].to_numpy()) - mean) / std, np.ones((len(pdf), 1))])
                q = np.log(np.stack(pdf["_teacher"].to_numpy()) + 1e-10) / t
                q, log_q = _soft(q)
                y = np.eye(k)[pdf["y"].to_numpy()]
                z = x @ w
                (p, log_p), (p_t, log_p_t) = _soft(z), _soft(z / t)
                total += alpha * t * t * (q * (log_q - log_p_t)).sum() - (1 - alpha) * (y * log_p).sum()
                grad += x.T @ (alpha * t * (p_t - q) + (1 - alpha) * (p - y))
                for a in range(k):
                    for b in range(a, k):
                        curve = sum(c * m[:, a] * ((a == b) - m[:, b]) for c, m in ((alpha, p_t), (1 - alpha, p)))
                        block = (x * curve[:, None]).T @ x
                        hess[a * (d + 1):(a + 1) * (d + 1), b * (d + 1):(b + 1) * (d + 1)] += block
                        if a != b:
                            hess[b * (d + 1):(b + 1) * (d + 1), a * (d + 1):(a + 1) * (d + 1)] += block.T
            yield pd.DataFrame({"total": [total], "grad": [grad.T.tobytes()], "hess": [hess.tobytes()]})

        total, grad, hess = 0.0, np.zeros((d + 1) * k), np.zeros(((d + 1) * k,) * 2)
        for part in rows.mapInPandas(run, "total double, grad binary, hess binary").toLocalIterator():
            total += part["total"]
            grad += np.frombuffer(part["grad"])
            hess += np.frombuffer(part["hess"]).reshape(hess.shape)
        flat = w.T.reshape(-1)
        shrink = np.tile(np.append(np.full(d, ridge), ridge * 1e-3), k)  # the bias hardly
        return (total / n + 0.5 * float((shrink * flat * flat).sum()), grad / n + shrink * flat, hess / n + np.diag(shrink))

    w = np.zeros((d + 1, k))
    loss, grad, hess = sums(w)
    history = [loss]
    for _ in range(max_iter):
        move, gain = np.linalg.solve(hess, grad), 0.0
        gain = float(grad @ move)
        if gain < tol:
            break
        step = 1.0
        while True:
            tried = w - step * move.reshape(k, d + 1).T
            new = sums(tried)
            if new[0] <= loss - 0.1 * step * gain or step < 1e-4:
                break
            step /= 2
        if new[0] > loss:
            break
        w, (loss, grad, hess) = tried, new
        history.append(loss)
    discard(rows)
    weights = w[:d] / std[:, None]
    bias = w[d] - (weights * mean[:, None]).sum(axis=0)
    return SoftmaxStudent(tuple(features), tuple(map(tuple, weights.tolist())), tuple(bias.tolist()), tuple(history))
