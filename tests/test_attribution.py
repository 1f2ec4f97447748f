import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.functions.scorers import LinearScorer
from tabulae.operators import attribution as X

FEATS = ["a", "b", "c"]


def _rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, *map(float, rng.normal(size=3))) for i in range(40)]
    return spark.createDataFrame(data, "id long, a double, b double, c double")


def _brute_shapley(f, x, bg, d):
    def v(S):
        vals = []
        for b in bg:
            z = [x[i] if i in S else b[i] for i in range(d)]
            vals.append(f(z))
        return float(np.mean(vals))
    phi = []
    for i in range(d):
        tot = 0.0
        others = [j for j in range(d) if j != i]
        for k in range(d):
            for S in itertools.combinations(others, k):
                w = math.factorial(len(S)) * math.factorial(d - len(S) - 1) / math.factorial(d)
                tot += w * (v(set(S) | {i}) - v(set(S)))
        phi.append(tot)
    return phi


def test_exact_shapley_matches_brute_force_and_efficiency(spark):
    sc = LinearScorer({"a": 1.0, "b": -2.0, "c": 0.5}, intercept=0.3, decimals=None)
    rows = _rows(spark)
    bg = rows.where("id < 5")
    phi = X.shapley_values(rows, FEATS, sc, bg, ["id"]).toPandas()
    pdf = rows.toPandas().set_index("id")
    bgl = bg.toPandas()[FEATS].to_numpy()
    f = lambda z: 1 / (1 + math.exp(-(0.3 + z[0] - 2 * z[1] + 0.5 * z[2])))
    for rid in (7, 21):
        got = phi[phi.id == rid].set_index("feature").loc[FEATS, "phi"].tolist()
        exp = _brute_shapley(f, pdf.loc[rid, FEATS].tolist(), bgl, 3)
        assert got == pytest.approx(exp, abs=1e-12)
    g = phi.groupby("id").agg(s=("phi", "sum"), base=("base", "first"), fx=("fx", "first"))
    assert np.allclose(g.s + g.base, g.fx)


def test_symmetry_and_dummy(spark):
    sc = LinearScorer({"a": 1.0, "b": 1.0, "c": 0.0}, decimals=None)
    df = spark.createDataFrame([(0, 2.0, 2.0, 5.0), (1, 0.0, 0.0, -1.0)], "id long, a double, b double, c double")
    phi = X.shapley_values(df, FEATS, sc, df.where("id = 1"), ["id"]).where("id = 0").toPandas()
    p = dict(zip(phi.feature, phi.phi))
    assert p["a"] == pytest.approx(p["b"]) and p["c"] == pytest.approx(0.0, abs=1e-15)


@pytest.mark.parametrize("method", ["permutation", "kernel"])
def test_methods_agree_with_exact(spark, method):
    sc = LinearScorer({"a": 1.0, "b": -2.0, "c": 0.5}, decimals=None)
    rows = _rows(spark)
    bg = rows.where("id < 4")
    a = X.shapley_values(rows, FEATS, sc, bg, ["id"]).toPandas().sort_values(["id", "feature"])
    b = X.shapley_values(rows, FEATS, sc, bg, ["id"], method=method).toPandas().sort_values(["id", "feature"])
    assert np.allclose(a.phi.values, b.phi.values, atol=1e-12)


def test_sampled_kernel_efficiency(spark):
    feats = [f"f{i}" for i in range(14)]
    sc = LinearScorer({f: 0.1 * (i + 1) for i, f in enumerate(feats)}, decimals=None)
    df = spark.createDataFrame([(i, *[float((i * 7 + j) % 5) for j in range(14)]) for i in range(6)],
                               "id long, " + ", ".join(f"{f} double" for f in feats))
    phi = X.shapley_values(df, feats, sc, df.where("id < 2"), ["id"], n_samples=200).toPandas()
    g = phi.groupby("id").agg(s=("phi", "sum"), base=("base", "first"), fx=("fx", "first"))
    assert np.allclose(g.s + g.base, g.fx, atol=1e-6)


def _game(d, seed):
    """Coalition values and exact Shapley values of a random game."""
    v = np.random.default_rng(seed).normal(size=1 << d)
    design = X.shapley_design(d)
    return v, design.matrix @ v[design.masks]


def test_sampled_kernel_converges_to_exact():
    d = 8
    v, exact = _game(d, 3)
    errors = []
    for n in (40, 120, 200, 256):
        runs = [X.kernel_design(d, n, seed) for seed in range(30)]
        assert all(len(r.masks) <= n for r in runs)
        errors.append(np.mean([np.abs(r.matrix @ v[r.masks] - exact).max() for r in runs]))
    assert errors[0] > errors[1] > errors[2] > errors[3]
    assert errors[3] < 1e-9


def test_many_features_need_a_stated_budget():
    for make in (X.kernel_design, X.permutation_design, X.interaction_design):
        with pytest.raises(ValueError):
            make(30)
    coefs = np.arange(1.0, 31.0)
    for design in (X.kernel_design(30, 2000), X.permutation_design(30, 20), X.interaction_design(30, "FSI", 3000)):
        v = np.array([coefs[[i for i in range(30) if m >> i & 1]].sum() for m in design.masks])
        found = (design.matrix @ v)[:30]
        assert np.allclose(found, coefs, atol=1e-5)


def test_ksii_efficiency_and_stii(spark):
    sc = LinearScorer({"a": 1.0, "b": -2.0, "c": 0.5}, decimals=None)
    rows = _rows(spark)
    bg = rows.where("id < 4")
    inter = X.interaction_values(rows, FEATS, sc, bg, ["id"], "k-SII").toPandas()
    phi = X.shapley_values(rows, FEATS, sc, bg, ["id"]).toPandas()
    tot = inter.groupby("id").value.sum()
    ref = phi.groupby("id").phi.sum()
    assert np.allclose(tot.sort_index().values, ref.sort_index().values)
    for idx in ("STII", "FSI", "SII"):
        out = X.interaction_values(rows, FEATS, sc, bg, ["id"], idx)
        assert out.count() == 40 * 6


def test_tables_behind_plots(spark):
    sc = LinearScorer({"a": 1.0, "b": -2.0, "c": 0.5}, decimals=None)
    rows = _rows(spark)
    phi = X.shapley_values(rows, FEATS, sc, rows.where("id < 4"), ["id"])
    imp = X.shap_importance(phi).orderBy("rank").toPandas()
    assert imp["rank"].tolist() == [1, 2, 3] and imp.importance.is_monotonic_decreasing
    wf = X.waterfall(phi, ["id"], max_display=2).where("id = 3").orderBy("position").toPandas()
    assert wf.feature.iloc[-1] == "other" and len(wf) == 2
    assert wf["end"].iloc[-1] == pytest.approx(phi.where("id = 3").first().fx)
    xl = rows.unpivot(["id"], FEATS, "feature", "value")
    with pytest.raises(ValueError):
        X.dependence_points(phi, xl, "nope", ["id"])
    dep = X.dependence_points(phi, xl, "a", ["id"])
    assert dep.select("color_feature").distinct().count() == 1


def test_tree_shap_additivity(spark):
    from tabulae.operators import models as MD
    from tabulae.operators.treeshap import tree_shap
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3))
    y = ((x[:, 0] + x[:, 1] * x[:, 2]) > 0).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, a double, b double, c double, label int")
    model = MD.train_boosted_trees(df, FEATS, "label", preset="fast")
    phi = tree_shap(model, df, FEATS, ["id"]).toPandas()
    p = MD.predict_proba(model, df).select("id", "p").toPandas().set_index("id").p
    g = phi.groupby("id").agg(s=("phi", "sum"), base=("base", "first"), fx=("fx", "first"))
    assert np.allclose(g.s + g.base, g.fx)
    logit = np.log(p / (1 - p))
    assert np.allclose(g.fx.sort_index().values, logit.sort_index().values, atol=1e-6)


def test_lime_surrogate_recovers_linear_direction(spark):
    from tabulae.operators.surrogate import lime_explain
    sc = LinearScorer({"a": 3.0, "b": -3.0, "c": 0.0}, decimals=None)
    rows = _rows(spark)
    out = lime_explain(rows, rows, FEATS, sc, ["id"], n_perturb=300).toPandas()
    assert out.groupby("id").size().eq(3).all()
    imp = out.assign(w=out.weight.abs()).groupby("feature").w.mean()
    assert imp["c"] < imp["a"] and imp["c"] < imp["b"]


def test_interaction_reports_five_features(spark):
    rng = np.random.default_rng(7)
    feats = [f"feature_{i}" for i in range(5)]
    rows = spark.createDataFrame([(i, *map(float, rng.normal(size=5))) for i in range(110)],
                                 "id long, " + ", ".join(f"{f} double" for f in feats))
    sc = LinearScorer({f: 0.3 * (i + 1) for i, f in enumerate(feats)}, decimals=None)
    inter = X.interaction_values(rows.where("id >= 100"), feats, sc, rows.where("id < 100").limit(20), ["id"])
    top = X.interaction_strength(inter, 5).collect()
    assert len(top) == 5 and all(a.interaction_strength >= b.interaction_strength for a, b in zip(top, top[1:]))
    inst = X.instance_interactions(inter, ["id"], 5).where("id = 105").collect()
    assert len(inst) == 5 and {r["rank"] for r in inst} == {1, 2, 3, 4, 5}
    dev = X.deviation_interactions(rows, feats, ["id"])
    assert dev.count() == 110 * 10


def test_values_of_every_class(spark):
    from tabulae.functions.scorers import LinearScorer, SoftmaxScorer
    df = spark.createDataFrame([(i, i * 0.3, 1.0 - i * 0.2) for i in range(6)] + [(6, None, 0.0)], "id long, a double, b double")
    bg = df.where("id < 3")
    two = SoftmaxScorer(["no", "yes"], {"a": [0.0, 1.5], "b": [0.0, -0.7]}, [0.0, 0.2], decimals=None)
    phi = X.class_shapley_values(df, ["a", "b"], two, bg, ["id"]).cache()
    one = X.shapley_values(df.where("id < 6"), ["a", "b"], LinearScorer({"a": 1.5, "b": -0.7}, 0.2, decimals=None), bg, ["id"])
    want = {(r.id, r.feature): (r.phi, r.base, r.fx) for r in one.collect()}
    for r in phi.where("id < 6").collect():  # the other class mirrors the binary scorer's
        sign, at = (1, 0.0) if r["class"] == "yes" else (-1, 1.0)
        p, base, fx = want[r.id, r.feature]
        assert abs(r.phi - sign * p) < 1e-9 and abs(r.base - at - sign * base) < 1e-9 and abs(r.fx - at - sign * fx) < 1e-9
    assert all(r.fx is None for r in phi.where("id = 6").collect())
    maps = {r.id: r for r in X.explanation_maps(phi, ["id"]).collect()}
    top = {r.id: r["class"] for r in phi.where("fx > 0.5").collect()}
    assert len(maps) == 7 and all(maps[i]["class"] == c and set(maps[i].explanation) == {"a", "b"} for i, c in top.items())
    assert {r["class"] for r in X.explanation_maps(phi, ["id"], target="no").collect()} == {"no"}
    base = {r["class"]: r.base_value for r in X.base_value(bg.select(two.proba_array().alias("p")), "p", two.classes).collect()}
    assert abs(base["yes"] - want[0, "a"][1]) < 1e-9 and abs(base["no"] + base["yes"] - 1) < 1e-9
    assert X.class_shapley_values(df.limit(0), ["a", "b"], two, bg, ["id"]).count() == 0


def test_matrix_computes_the_rows_values_once(spark):
    from pyspark import TaskContext
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        if TaskContext.get().attemptNumber() == 0:
            seen.add(1)
        return v

    rows = [(i, a, b, 2, 0.1 * i + len(a + b) * ord(a[0])) for i in range(30) for a, b in itertools.combinations(["x", "yy", "z"], 2)]
    inter = spark.createDataFrame(rows, "id long, feature_i string, feature_j string, order long, value double")
    out = X.interaction_matrix(inter.withColumn("value", counted("value")), 2)
    assert [(r.a, r.b) for r in out.orderBy("a").collect()] == [("yy", "z"), ("z", "yy")]
    assert seen.value == len(rows)
