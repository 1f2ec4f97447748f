"""Scorers: the model-side protocol every evaluation/explanation op uses.

A scorer maps a DataFrame with feature columns to a probability column.
``LinearScorer`` is a fixed logistic model written as a column expression
(JVM-side, codegen'd). It is a design aid: it gives every downstream
operator an exact SQL oracle. Trained Spark ML models are wrapped by
``ModelScorer`` (``model.transform`` + ``vector_to_array``).
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


@dataclass(frozen=True)
class LinearScorer:
    """p = round(1 / (1 + exp(-(b + sum_i w_i x_i))), decimals)."""

    coefs: Mapping[str, float]
    intercept: float = 0.0
    decimals: int | None = 6
    name: str = "linear"

    @property
    def features(self) -> list[str]:
        return list(self.coefs)

    def margin(self, values: Mapping[str, Column] | None = None) -> Column:
        vals = values or {f: F.col(f) for f in self.coefs}
        z = F.lit(float(self.intercept))
        for f, w in self.coefs.items():
            z = z + F.lit(float(w)) * vals[f].cast("double")
        return z

    def proba(self, values: Mapping[str, Column] | None = None) -> Column:
        p = _sigmoid(self.margin(values))
        return F.round(p, self.decimals) if self.decimals is not None else p

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        return df.withColumn(out, self.proba())

    # --- SQL text of the same expressions, for DuckDB oracles -------------
    def margin_sql(self, values: Mapping[str, str] | None = None) -> str:
        vals = values or {f: f for f in self.coefs}
        terms = [repr(float(self.intercept))]
        terms += [f"{float(w)!r} * CAST({vals[f]} AS DOUBLE)" for f, w in self.coefs.items()]
        return "(" + " + ".join(terms) + ")"

    def proba_sql(self, values: Mapping[str, str] | None = None) -> str:
        p = f"(1.0 / (1.0 + exp(-{self.margin_sql(values)})))"
        return f"round({p}, {self.decimals})" if self.decimals is not None else p


@dataclass(frozen=True)
class SoftmaxScorer:
    """Multiclass fixed linear scorer: p_k = softmax_k(b_k + w_k . x)."""

    classes: Sequence[str]
    coefs: Mapping[str, Sequence[float]]          # feature -> weight per class
    intercepts: Sequence[float] = field(default_factory=tuple)
    decimals: int | None = 6

    def logits(self) -> list[Column]:
        out = []
        for k in range(len(self.classes)):
            z = F.lit(float(self.intercepts[k]) if self.intercepts else 0.0)
            for f, ws in self.coefs.items():
                z = z + F.lit(float(ws[k])) * F.col(f).cast("double")
            out.append(z)
        return out

    def proba_array(self) -> Column:
        zs = self.logits()
        m = F.greatest(*zs) if len(zs) > 1 else zs[0]
        es = [F.exp(z - m) for z in zs]
        tot = es[0]
        for e in es[1:]:
            tot = tot + e
        ps = [e / tot for e in es]
        if self.decimals is not None:
            ps = [F.round(p, self.decimals) for p in ps]
        return F.array(*ps)

    def logits_sql(self, values: Mapping[str, str] | None = None) -> list[str]:
        vals = values or {f: f for f in self.coefs}
        out = []
        for k in range(len(self.classes)):
            terms = [repr(float(self.intercepts[k]) if self.intercepts else 0.0)]
            terms += [f"{float(ws[k])!r} * CAST({vals[f]} AS DOUBLE)" for f, ws in self.coefs.items()]
            out.append("(" + " + ".join(terms) + ")")
        return out

    def proba_sql(self, values: Mapping[str, str] | None = None) -> list[str]:
        zs = self.logits_sql(values)
        m = f"greatest({', '.join(zs)})"
        es = [f"exp({z} - {m})" for z in zs]
        tot = " + ".join(es)
        ps = [f"({e}) / ({tot})" for e in es]
        if self.decimals is not None:
            ps = [f"round({p}, {self.decimals})" for p in ps]
        return ps


class ModelScorer:
    """Wrap a fitted Spark ML classification model as a scorer."""

    def __init__(self, model, features: Sequence[str], positive_index: int = 1,
                 features_col: str = "features"):
        self.model = model
        self.features = list(features)
        self.positive_index = positive_index
        self.features_col = features_col

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        from pyspark.ml.feature import VectorAssembler
        from pyspark.ml.functions import vector_to_array

        keep = df.columns
        asm = VectorAssembler(inputCols=self.features, outputCol=self.features_col,
                              handleInvalid="keep")
        scored = self.model.transform(asm.transform(df))
        prob = vector_to_array(F.col(self.model.getProbabilityCol()))
        return scored.select(*keep, prob[self.positive_index].alias(out))


def logit(p: float) -> float:
    return math.log(p / (1.0 - p))
