"""Isotonic calibration by merged blocks."""
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import functions as F

from tabulae.operators import metrics as M


def brute(x, y, w):
    """Min-max formula on distinct scores."""
    h = pd.DataFrame({"x": x, "t": y * w, "w": w}).groupby("x").sum()
    t, c = np.cumsum(np.append(0, h.t)), np.cumsum(np.append(0, h.w))
    n = len(h)
    return dict(zip(h.index, [max(min((t[b + 1] - t[a]) / (c[b + 1] - c[a]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]))


@pytest.mark.parametrize("n,levels,ranges", [(400, 60, 40), (300, 300, 70), (50, 3, 8), (1, 1, 3)])
def test_blocks_are_those_of_the_whole(spark, n, levels, ranges, monkeypatch):
    rng = np.random.default_rng(n)
    x = rng.integers(0, levels, n) / levels
    y = (rng.random(n) < 0.2 + 0.6 * x + 0.2 * np.sin(9 * x)).astype(float)
    w = rng.integers(1, 4, n).astype(float)
    rows = [(float(a), float(b), float(c)) for a, b, c in zip(x, y, w)]
    rows += [(None, 1.0, 1.0), (0.5, None, 1.0), (float("nan"), 1.0, 1.0), (0.5, 1.0, None), (0.5, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "p double, label double, weight double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)  # several rounds of merging
    monkeypatch.setattr(M, "ISOTONIC_FAN_IN", 3)
    try:
        fit = M.fit_isotonic(df, weight="weight")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = brute(x, y, w)
    assert np.allclose(np.interp(list(want), fit.boundaries, fit.predictions), list(want.values()))
    assert (np.diff(fit.boundaries) > 0).all() and (np.diff(fit.predictions) >= 0).all()


def test_equals_sparks_fit_and_clips(spark):
    rng = np.random.default_rng(3)
    x = rng.random(300)
    df = spark.createDataFrame([(float(a), float(rng.random() < a * a)) for a in x], "p double, label double").repartition(5)
    fit = M.fit_isotonic(df)
    model = IsotonicRegression(featuresCol="p", labelCol="label").fit(df)
    at = spark.createDataFrame([(float(a),) for a in [-1.0, 2.0, *rng.random(200), *x[:20]]], "p double")
    ours = {r["p"]: r["p_cal"] for r in M.apply_isotonic(fit, at).collect()}
    theirs = {r["p"]: r["prediction"] for r in model.transform(at).collect()}
    assert all(ours[p] == pytest.approx(theirs[p], abs=1e-9) for p in theirs)
    assert ours[-1.0] == fit.predictions[0] and ours[2.0] == fit.predictions[-1]
    odd = spark.createDataFrame([(None,), (float("nan"),)], "p double")
    assert [r["p_cal"] for r in M.apply_isotonic(fit, odd).collect()] == [None, None]
    with pytest.raises(ValueError, match="no rows"):
        M.fit_isotonic(df.limit(0))


def test_calibrated_metrics_by_group(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i % 2), float(p), int(rng.random() < p ** 3)) for i, p in enumerate(rng.random(600))]
    df = spark.createDataFrame(rows, "g string, p double, label int")
    got = {(r["g"], r["calibrated"], r["metric"]): r["value"] for r in M.calibrated_metrics(df, df, ["g"]).collect()}
    assert len(got) == 2 * 2 * 7
    for g in "01":
        assert got[g, True, "brier_score"] < got[g, False, "brier_score"]
    plain = {(r["g"], r["metric"]): r["value"] for r in M.evaluate_by(df, ["g"]).collect()}
    assert all(got[g, False, m] == pytest.approx(v) for (g, m), v in plain.items())
    assert df.where(F.col("p").isNull()).count() == 0
