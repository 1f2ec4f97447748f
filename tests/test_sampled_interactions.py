"""Interaction indices from a budget of coalitions."""
import itertools

import numpy as np
import pytest

from tabulae.functions.scorers import LinearScorer
from tabulae.operators import attribution as X


def values(design, game):
    return np.array([game(m) for m in design.masks])


@pytest.mark.parametrize("index", ["SII", "k-SII", "STII"])
def test_no_size_left_to_sample_is_exact(index):
    rng = np.random.default_rng(1)
    table = rng.normal(size=1 << 6)
    exact = X.interaction_design(6, index)
    assert X.interaction_design(6, index, budget=64).masks == exact.masks
    sampled = X.sampled_interaction_design(6, index.upper(), 64)
    assert sampled.terms == exact.terms
    assert np.allclose(sampled.matrix @ values(sampled, lambda m: table[m]), exact.matrix @ values(exact, lambda m: table[m]))


@pytest.mark.parametrize("index", ["SII", "K-SII", "STII"])
def test_games_of_pairs_are_exact_at_any_budget(index):
    rng = np.random.default_rng(2)
    d = 14
    one, two = rng.normal(size=d), np.triu(rng.normal(size=(d, d)), 1)
    def game(m):
        x = np.array([m >> i & 1 for i in range(d)], float)
        return 0.7 + x @ one + x @ two @ x
    design = X.sampled_interaction_design(d, index, 300)
    assert len(design.masks) <= 300 + d
    got = design.matrix @ values(design, game)
    pairs = [two[i, j] for i, j in itertools.combinations(range(d), 2)]
    single = one + (0.5 * (two + two.T).sum(axis=1) if index == "SII" else 0)
    assert np.allclose(got, [*single, *pairs], atol=1e-6)


@pytest.mark.parametrize("index", ["K-SII", "STII"])
def test_error_falls_with_the_budget(index):
    d, rng = 10, np.random.default_rng(3)
    w = rng.normal(size=d)
    def game(m):  # smooth, of all orders
        return 1 / (1 + np.exp(-1.5 * sum(w[i] for i in range(d) if m >> i & 1)))
    exact = X.interaction_design(d, index)
    want = exact.matrix @ values(exact, game)
    def error(budget):
        return np.mean([np.abs((x := X.sampled_interaction_design(d, index, budget, seed)).matrix @ values(x, game) - want).mean()
                        for seed in range(6)])
    errors = [error(b) for b in (60, 200, 600, 1024)]
    assert errors[0] > errors[1] > errors[2] > errors[3] and errors[3] < 1e-9
    assert errors[2] < 0.15 * np.abs(want).mean()


def test_budget_must_cover_the_smallest_sizes():
    with pytest.raises(ValueError, match="does not cover"):
        X.interaction_design(30, "STII", budget=40)
    with pytest.raises(ValueError, match="budget"):
        X.interaction_design(30, "k-SII")
    with pytest.raises(ValueError, match="unknown index"):
        X.interaction_design(4, "other")


def test_batches_equal_the_plan(spark, monkeypatch):
    rng = np.random.default_rng(4)
    feats = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(30, 5)))],
                               "id long, " + ", ".join(f"{f} double" for f in feats))
    scorer = LinearScorer({f: 0.5 * (i - 2) for i, f in enumerate(feats)}, 0.1, decimals=None)
    bg = df.where("id < 7")

    class Other:  # a scorer without coefficients: explodes rows
        def score(self, rows, out):
            return scorer.score(rows, out)

    def both(make):
        sort = ["id", *[c for c in ("feature", "feature_i", "feature_j") if c in make(scorer).columns]]
        plan = make(scorer).toPandas().sort_values(sort, na_position="first")
        monkeypatch.setattr(X, "LITERAL_CELLS", 0)
        monkeypatch.setattr(X, "MAX_SCORED", 1000)
        out = [make(s).toPandas().sort_values(sort, na_position="first") for s in (scorer, Other())]
        monkeypatch.undo()
        for o in out:
            assert list(o.columns) == list(plan.columns) and len(o) == len(plan)
            for c in plan.columns:
                same = np.allclose(o[c], plan[c]) if plan[c].dtype == float else (o[c].fillna("") == plan[c].fillna("").values).all()
                assert same, c
    both(lambda s: X.interaction_values(df, feats, s, bg, ["id"], "k-SII"))
    both(lambda s: X.shapley_values(df, feats, s, bg, ["id"], method="kernel"))
    monkeypatch.setattr(X, "LITERAL_CELLS", 0)
    monkeypatch.setattr(X, "MAX_BACKGROUND", 3)
    with pytest.raises(ValueError, match="background"):
        X.interaction_values(df, feats, scorer, bg, ["id"], "k-SII")
