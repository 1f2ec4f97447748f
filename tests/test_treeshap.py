"""Tree Shapley values against enumerating all coalitions, for any feature count."""
import math
import tracemalloc

import numpy as np
import pytest

from tabulae.operators import treeshap as TS
from tabulae.operators.attribution import shapley_design


def random_tree(rng, d, depth, categories=()):
    nodes = {}
    def grow(level, cover):
        k = len(nodes)
        nodes[k] = None
        if level == 0 or rng.random() < 0.15:
            nodes[k] = (float(rng.normal()), -1, -1, cover, -1, [], -1)
        else:
            part = float(rng.uniform(0.1, 0.9)) * cover
            f = int(rng.integers(d))
            n_cat = 5 if f in categories else -1
            split = [float(c) for c in rng.choice(5, 2, replace=False)] if n_cat > 0 else [float(rng.normal())]
            left, right = grow(level - 1, part), grow(level - 1, cover - part)
            nodes[k] = (0.0, left, right, cover, f, split, n_cat)
        return k
    grow(depth, 100.0)
    return {"weight": float(rng.uniform(0.1, 1)), "order": sorted(nodes), "nodes": nodes}


def expected(tree, x, mask, k=0):
    value, left, right, _, f, split, n_cat = tree["nodes"][k]
    if left < 0:
        return value
    if mask >> f & 1:
        goes_left = x[f] in split if n_cat >= 0 else x[f] <= split[0]
        return expected(tree, x, mask, left if goes_left else right)
    a, b = tree["nodes"][left][3], tree["nodes"][right][3]
    return (a * expected(tree, x, mask, left) + b * expected(tree, x, mask, right)) / (a + b)


@pytest.mark.parametrize("d,depth,categories", [(1, 3, ()), (3, 5, ()), (6, 4, (1, 4)), (8, 6, ())])
def test_equals_all_coalitions(d, depth, categories):
    rng = np.random.default_rng(d)
    trees = [random_tree(rng, d, depth, categories) for _ in range(4)]
    x = rng.normal(size=(9, d))
    for c in categories:
        x[:, c] = rng.integers(0, 5, 9)
    x[0, 0] = np.nan
    design = shapley_design(d)
    v = np.array([[sum(t["weight"] * expected(t, row, m) for t in trees) for m in design.masks] for row in x])
    phi, base, margin = TS.explain_batch(TS.leaf_paths(trees), x)
    assert np.allclose(phi, v @ design.matrix.T, atol=1e-9)
    assert np.allclose(base, v[:, 0]) and np.allclose(margin, v[:, -1])


def test_many_features_add_up_and_run_in_slices(monkeypatch):
    rng = np.random.default_rng(0)
    trees = [random_tree(rng, 40, 9) for _ in range(12)]
    x = rng.normal(size=(50, 40))
    phi, base, margin = TS.explain_batch(TS.leaf_paths(trees), x)
    assert np.allclose(phi.sum(axis=1) + base, margin)
    monkeypatch.setattr(TS, "MAX_CELLS", 1)
    assert np.allclose(TS.explain_batch(TS.leaf_paths(trees), x)[0], phi)


def test_a_batch_of_rows_takes_little_memory():
    rng = np.random.default_rng(3)
    paths = TS.leaf_paths([random_tree(rng, 20, 4) for _ in range(60)])
    x = rng.normal(size=(10000, 20))
    tracemalloc.start()
    try:
        TS.explain_batch(paths, x)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6  # the result is 1.6 MB


def test_batches_are_handed_over_in_slices(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), float(-i)) for i in range(30)], "id long, a double, b double").coalesce(1)
    trees = [TS.stump(0, 9.5, -1.0, 1.0, 10, 20), TS.stump(1, -4.5, 0.5, 2.0, 25, 5)]
    whole = sorted(map(tuple, TS.explain_trees(df, trees, ["a", "b"], ["id"]).collect()))
    monkeypatch.setattr(TS, "MAX_VALUES", 8)
    assert len(whole) == 60 and sorted(map(tuple, TS.explain_trees(df, trees, ["a", "b"], ["id"]).collect())) == whole


def test_leaf_only_tree_and_empty_table(spark):
    leaf = {"weight": 2.0, "order": [0], "nodes": {0: (1.5, -1, -1, 10.0, -1, [], -1)}}
    df = spark.createDataFrame([(1, 0.5), (2, None)], "id long, a double")
    rows = TS.explain_trees(df, [leaf, TS.stump(0, 0.0, -1.0, 1.0, 1, 3)], ["a"], ["id"]).collect()
    assert [(r["phi"], r["base"], r["fx"]) for r in rows] == [(0.5, 3.5, 4.0)] * 2  # missing goes right
    assert TS.explain_trees(df.limit(0), [leaf], ["a"], ["id"]).count() == 0


def test_thirty_features_of_a_trained_model(spark):
    from tabulae.operators import models as MD
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 30))
    y = (x[:, 0] + x[:, 5] * x[:, 20] > 0).astype(int)
    feats = [f"f{i}" for i in range(30)]
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y))],
                               "id long, " + ", ".join(f"{f} double" for f in feats) + ", label int")
    model = MD.train_boosted_trees(df, feats, "label", preset="fast")
    phi = TS.tree_shap(model, df, feats, ["id"]).toPandas()
    p = {r["id"]: r["p"] for r in MD.predict_proba(model, df).collect()}
    for i, g in phi.groupby("id"):
        assert len(g) == 30
        assert math.isclose(g.phi.sum() + g.base.iloc[0], math.log(p[i] / (1 - p[i])), abs_tol=1e-6)
    assert phi.groupby("feature").phi.apply(lambda s: s.abs().mean()).idxmax() == "f0"
