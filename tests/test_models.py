import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.operators import metrics as M
from tabulae.operators import models as MD
from tabulae.operators import prep as P
from tabulae.operators import split as S

FEATS = [f"feature_{i}" for i in range(10)]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(42)
    x = rng.normal(size=(200, 10))
    y = (x[:, 0] + 0.5 * x[:, 1] - x[:, 2] > 0).astype(int)
    rows = [(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))]
    schema = "id long, " + ", ".join(f"{f} double" for f in FEATS) + ", label int"
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("split", F.when(F.col("id") < 150, "train").otherwise("test"))


def test_boosted_tree_contract(data):
    train = data.where("split = 'train'")
    model = MD.train_boosted_trees(train, FEATS, "label", preset="fast")
    out = MD.predict_proba(model, data.where("split = 'test'"))
    rows = out.collect()
    assert len(rows) == 50 and all(len(r.proba) == 2 for r in rows)
    assert all(abs(sum(r.proba) - 1) < 1e-9 for r in rows)
    acc = M.label_metrics(out).first().accuracy
    assert acc > 0.5
    imp = MD.native_importance(model, FEATS)
    assert [f for f, _ in imp][:1] and len(imp) == 10 and imp == sorted(imp, key=lambda t: (-t[1], t[0]))


def test_unknown_options_warn(data):
    with pytest.warns(UserWarning):
        MD.gbt_params("default", {"reg_lambda": 1.0, "n_estimators": 5})


def test_mlp_and_distillation(data):
    train = data.where("split = 'train'")
    test = data.where("split = 'test'")
    mlp = MD.train_mlp(train, FEATS, "label", hidden=(8,), max_iter=100)
    assert M.label_metrics(MD.predict_proba(mlp, test)).first().accuracy > 0.5
    teacher = MD.train_boosted_trees(train, FEATS, "label", preset="fast")
    student = MD.distill(train, teacher, FEATS, "label", alpha=0.7, temperature=2.0)
    assert M.label_metrics(MD.predict_proba(student, test)).first().accuracy >= 0.7


def test_distillation_row_weights_sum_to_one(spark):
    df = spark.createDataFrame([(0, [0.2, 0.8]), (1, [0.9, 0.1])], "label int, t array<double>")
    rows = MD.distillation_rows(df, "t", "label", alpha=0.7).groupBy().agg(F.sum("weight")).first()[0]
    assert rows == pytest.approx(2.0)


def test_mock_mixed_pipeline(spark):
    rng = np.random.default_rng(0)
    n = 1000
    work = rng.choice(["Private", "Self", "Gov", "Rare"], size=n, p=[0.6, 0.25, 0.145, 0.005])
    edu = rng.choice(["HS", "BSc", "MSc"], size=n)
    age = rng.integers(18, 70, size=n)
    gain = rng.exponential(1000, size=n)
    y = ((age > 40) & (edu != "HS")).astype(int)
    df = spark.createDataFrame(
        [(i, int(a), float(g), str(w), str(e), int(t)) for i, (a, g, w, e, t) in enumerate(zip(age, gain, work, edu, y))],
        "id long, age int, capital_gain double, workclass string, education string, income int")
    df = P.bucket_rare(df, ["workclass"])
    assert df.where("workclass = 'Rare'").count() == 0
    df = P.label_encode(df, ["workclass", "education"])
    df = S.stratified_split(df, "income", ["id"], 0.2, 42)
    feats = ["age", "capital_gain", "workclass", "education"]
    df = P.quantile_normal_scale(df, feats, F.col("split") == "train")
    model = MD.train_boosted_trees(df.where("split = 'train'"), feats, "income", preset="fast")
    scored = MD.predict_proba(model, df).withColumnRenamed("income", "label")
    res = {(r.split, r.metric): r.value for r in M.evaluate_by(scored, ["split"], pred="pred").collect()}
    assert res[("test", "accuracy")] > 0.8 and res[("test", "roc_auc")] > 0.8
