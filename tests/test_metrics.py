import pytest

from tabulae.operators import metrics as M


def _scored(spark, labels, scores, preds=None):
    rows = [(i, int(y), float(s), int(p) if preds else int(s >= 0.5))
            for i, (y, s, p) in enumerate(zip(labels, scores, preds or scores))]
    return spark.createDataFrame(rows, "row_id long, label int, p double, pred int")


def test_auc_ap_with_ties(spark):
    df = _scored(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    r = M.curve_metrics(M.binary_curve(df)).first()
    assert r.roc_auc == pytest.approx(0.75)
    assert r.pr_auc == pytest.approx(0.8333333333)
    ties = _scored(spark, [0, 1, 0, 1], [0.5, 0.5, 0.2, 0.9])
    t = M.curve_metrics(M.binary_curve(ties)).first()
    # pairs: (0.9 > 0.5, 0.9 > 0.2, 0.5 = 0.5 -> half, 0.5 > 0.2) = 3.5 / 4
    assert t.roc_auc == pytest.approx(0.875)


def test_one_class_auc_is_null(spark):
    df = _scored(spark, [1, 1, 1], [0.1, 0.2, 0.3])
    r = M.curve_metrics(M.binary_curve(df)).first()
    assert r.roc_auc is None


def test_label_metrics_zero_division(spark):
    df = _scored(spark, [0, 1, 0], [0.1, 0.2, 0.3])  # no positive predictions
    r = M.label_metrics(df).first()
    assert r.precision == 0.0 and r.recall == 0.0 and r.f1 == 0.0
    assert r.accuracy == pytest.approx(2 / 3)


def test_precision_at_recall_fix_and_compat(spark):
    df = _scored(spark, [1, 0, 1, 0, 1], [0.9, 0.8, 0.7, 0.3, 0.2])
    curve = M.binary_curve(df)
    fixed = M.precision_at_recall_from_curve(curve, 0.6).first()[0]
    compat = M.precision_at_recall_from_curve(curve, 0.6, compat=True).first()[0]
    # highest threshold with recall >= 0.6 is 0.7: precision 2/3; lowest is 0.2: 3/5
    assert fixed == pytest.approx(2 / 3)
    assert compat == pytest.approx(3 / 5)
    none = M.precision_at_recall_from_curve(M.binary_curve(_scored(spark, [0, 0], [0.1, 0.2])), 0.8).first()[0]
    assert none == 0.0


def test_f1_max_and_brier(spark):
    df = _scored(spark, [1, 0, 1, 0], [0.9, 0.8, 0.7, 0.1])
    f1 = M.f1_max(df).first()[0]
    assert f1 == pytest.approx(0.8, abs=1e-9)
    b = M.brier_score(df).first()[0]
    assert b == pytest.approx((0.01 + 0.64 + 0.09 + 0.01) / 4)


def test_weighted_metrics(spark):
    rows = [(0, 0), (0, 0), (1, 1), (1, 0), (2, 2), (2, 1)]
    df = spark.createDataFrame(rows, "label int, pred int")
    r = M.weighted_label_metrics(df, "label", "pred").first()
    assert r.accuracy == pytest.approx(4 / 6)
    # per class precision: 2/3, 1/2, 1/1 ; support 2 each
    assert r.precision_weighted == pytest.approx((2 / 3 + 1 / 2 + 1) / 3)
    assert r.recall_weighted == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_isotonic_is_monotone(spark):
    df = _scored(spark, [0, 0, 1, 0, 1, 1, 1], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7])
    model = M.fit_isotonic(df)
    out = M.apply_isotonic(model, df).orderBy("p").select("p_cal").toPandas()["p_cal"].tolist()
    assert all(a <= b for a, b in zip(out, out[1:]))
    assert 0.0 <= min(out) and max(out) <= 1.0


def test_aggregate_runs_population_std(spark):
    long = spark.createDataFrame([(0, "auc", 0.5), (1, "auc", 0.7), (2, "auc", None)],
                                 "run int, metric string, value double")
    r = M.aggregate_runs(long).first()
    assert r["mean"] == pytest.approx(0.6) and r["std"] == pytest.approx(0.1)
    assert r["runs"][:2] == [0.5, 0.7]
