"""Standard normal inverse CDF as a JVM-side column expression.

Rational approximation with one refinement-free piecewise form (lower
tail, central region, upper tail); relative error about 1e-9.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the published rational approximation of the
# normal quantile (central numerator a, denominator b; tail numerator c,
# denominator d) and the tail breakpoint.
A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02,
     1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02,
     6.680131188771972e01, -1.328068155288572e01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00,
     -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00,
     3.754408661907416e00]
P_LOW = 0.02425


def _horner(coefs: list[float], x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_ppf(p: Column) -> Column:
    """Quantile of N(0, 1) for p in (0, 1)."""
    q_lo = F.sqrt(F.lit(-2.0) * F.log(p))
    lower = _horner(C, q_lo) / (_horner(D, q_lo) * q_lo + F.lit(1.0))
    q_hi = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    upper = -_horner(C, q_hi) / (_horner(D, q_hi) * q_hi + F.lit(1.0))
    q = p - F.lit(0.5)
    r = q * q
    central = _horner(A, r) * q / (_horner(B, r) * r + F.lit(1.0))
    return (F.when(p < F.lit(P_LOW), lower)
            .when(p > F.lit(1.0 - P_LOW), upper)
            .otherwise(central))
