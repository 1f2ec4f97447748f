import pytest

from tabulae.operators import xquality as Q


def _runs(spark, rows):
    return spark.createDataFrame(rows, "run int, feature string, importance double")


def test_stability_single_run_is_one(spark):
    r = Q.importance_stability(_runs(spark, [(0, "a", 1.0), (0, "b", 2.0)]), "spearman").first()
    assert r.value == 1.0


def test_stability_aligns_to_first_run(spark):
    rows = [(0, "a", 3.0), (0, "b", 2.0), (0, "c", 1.0),
            (1, "a", 1.0), (1, "b", 2.0), (1, "d", 9.0)]  # c missing -> 0, d ignored
    runs = _runs(spark, rows)
    sp = Q.importance_stability(runs, "spearman").first().value
    kd = Q.importance_stability(runs, "kendall").first().value
    pe = Q.importance_stability(runs, "pearson").first().value
    # run0 = [3,2,1], run1 aligned = [1,2,0]
    assert sp == pytest.approx(0.5)
    assert kd == pytest.approx(1 / 3)
    import numpy as np
    assert pe == pytest.approx(np.corrcoef([3, 2, 1], [1, 2, 0])[0, 1])


def test_consistency_metrics(spark):
    e1 = spark.createDataFrame([(0, "a", 1.0), (0, "b", 0.0), (1, "a", 0.0)], "id long, feature string, value double")
    e2 = spark.createDataFrame([(0, "a", 1.0), (0, "c", 1.0), (1, "a", 0.0)], "id long, feature string, value double")
    cos = Q.explanation_consistency(e1, e2, ["id"], "cosine").first().consistency
    # row 0: [1,0,0] vs [1,0,1] -> 1/sqrt(2); row 1: zero vectors -> 0
    assert cos == pytest.approx((1 / 2 ** 0.5) / 2)
    eu = Q.explanation_consistency(e1, e2, ["id"], "euclidean").first().consistency
    assert eu == pytest.approx(1 - 0.5 / (1 + 1e-10))


def test_agreement_complexity_fidelity(spark):
    i1 = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "feature string, importance double")
    i2 = spark.createDataFrame([("a", 3.0), ("c", 2.0), ("b", 1.0)], "feature string, importance double")
    assert Q.feature_agreement(i1, i2, 2).first().agreement == pytest.approx(1 / 3)
    exp = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.005), (1, "a", 0.02), (1, "b", 0.02)],
                                "id long, feature string, value double")
    assert Q.explanation_complexity(exp, ["id"]).first().complexity == pytest.approx(1.5)
    from tabulae.functions.scorers import LinearScorer
    sc = LinearScorer({"a": 1.0, "b": 0.0}, decimals=None)
    rows = spark.createDataFrame([(0, 2.0, 1.0), (1, 0.0, 1.0)], "id long, a double, b double")
    fid = Q.explanation_fidelity(rows, exp, ["id"], ["a", "b"], sc, top_k=1).first().fidelity
    import math
    s = lambda z: 1 / (1 + math.exp(-z))
    assert fid == pytest.approx((abs(s(2) - s(0)) + 0.0) / 2)


def test_compare_importances_outer(spark):
    a = spark.createDataFrame([("x", 2.0), ("y", 1.0)], "feature string, importance double")
    b = spark.createDataFrame([("y", 4.0), ("z", 2.0)], "feature string, importance double")
    out = {r.feature: r for r in Q.compare_importances(a, b).collect()}
    assert out["x"].normalized_b == 0.0 and out["z"].importance_a == 0.0
    assert out["y"].normalized_a == pytest.approx(0.5) and out["y"].normalized_b == pytest.approx(1.0)
