"""Distillation with teacher and student softened."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.operators import metrics as M
from tabulae.operators import models as MD

FEATS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [0, 50, 3]
    z = np.stack([np.zeros(400), 3 * x[:, 0] - x[:, 1] / 5 + 10, x[:, 0] ** 2 - 20 * (x[:, 2] - 3)], 1)
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    y = [int(rng.choice(3, p=q)) for q in p]
    return spark.createDataFrame([(*map(float, r), q.tolist(), t) for r, q, t in zip(x, p, y)],
                                 "a double, b double, c double, teacher array<double>, label int").repartition(4).cache()


def loss(rows, student, alpha, t):
    df = rows.withColumn("t", F.transform("teacher", lambda v: F.log(v + 1e-10))).withColumn("s", student.logits())
    return M.kd_loss(df, "t", "s", "label", alpha, t).first()["kd_loss"]


@pytest.mark.parametrize("alpha,t", [(0.7, 2.0), (1.0, 4.0), (0.3, 1.0), (0.0, 3.0)])
def test_student_minimises_the_loss(rows, alpha, t):
    student = MD.distill(rows, "teacher", FEATS, alpha=alpha, temperature=t, n_classes=3)
    h = student.history
    assert all(b <= a for a, b in zip(h, h[1:])) and len(h) < 20
    best = loss(rows, student, alpha, t)
    assert best == pytest.approx(h[-1], abs=1e-4)
    rng = np.random.default_rng(0)
    for _ in range(4):  # a minimum: any other student is worse
        w = np.array(student.weights) * (1 + rng.normal(0, 0.05, (3, 3)))
        other = MD.SoftmaxStudent(student.features, tuple(map(tuple, w.tolist())), student.bias)
        assert loss(rows, other, alpha, t) > best


def test_beats_the_student_of_a_softened_teacher_alone(rows):
    """What the weighted rows fit at T = 2 (only the teacher softened)."""
    student = MD.distill(rows, "teacher", FEATS, alpha=0.7, temperature=2.0, n_classes=3)
    weighted = MD.distillation_rows(rows, "teacher", "label", 3, 0.7, 2.0)
    old = MD.train_logistic(weighted, FEATS, "label", weight="weight").stages[-1]
    former = MD.SoftmaxStudent(tuple(FEATS), tuple(map(tuple, old.coefficientMatrix.toArray().T.tolist())),
                               tuple(old.interceptVector.toArray().tolist()))
    assert loss(rows, student, 0.7, 2.0) < loss(rows, former, 0.7, 2.0) - 0.01


def test_at_t_1_it_is_the_weighted_fit(rows):
    student = MD.distill(rows, "teacher", FEATS, alpha=0.6, temperature=1.0, n_classes=3)
    old = MD.train_logistic(MD.distillation_rows(rows, "teacher", "label", 3, 0.6, 1.0), FEATS, "label", weight="weight")
    a = {r["k"]: r["proba"] for r in MD.predict_proba(student, rows.withColumn("k", F.col("a")), 3).collect()}
    b = {r["k"]: r["proba"] for r in MD.predict_proba(old, rows.withColumn("k", F.col("a")), 3).collect()}
    assert max(abs(x - y) for k in a for x, y in zip(a[k], b[k])) < 2e-3


def test_odd_rows(spark, rows):
    odd = spark.createDataFrame([(None, 1.0, 1.0, [0.2, 0.3, 0.5], 1), (1.0, 1.0, 1.0, None, 1), (1.0, 1.0, 1.0, [1.0, 0.0, 0.0], None)], rows.schema)
    a = MD.distill(rows, "teacher", FEATS, n_classes=3)
    b = MD.distill(rows.unionByName(odd), "teacher", FEATS, n_classes=3)
    assert np.allclose(a.weights, b.weights, atol=1e-6)
    with pytest.raises(ValueError, match="complete"):
        MD.distill(odd, "teacher", FEATS, n_classes=3)
