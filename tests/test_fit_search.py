"""Searches that train: fits fail alone, draws are fitted once, the best is refitted."""
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.operators import models as MD
from tabulae.operators import search as H


@pytest.fixture(scope="module")
def folded(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    y = (x[:, 0] + 0.3 * rng.normal(size=120) > 0).astype(int)
    return spark.createDataFrame([(i, float(a), float(b), int(t), i % 3) for i, ((a, b), t) in enumerate(zip(x, y))],
                                 "id long, a double, b double, label int, fold int")


def discriminant(rows, params):
    if params["shrink"] == "bad":
        raise RuntimeError("cannot fit\nthis")
    return MD.train_discriminant(rows, params["features"].split("+"), shrink=float(params["shrink"]))


def test_failures_stay_alone(spark, folded):
    grid = H.candidate_grid(spark, {"features": ["b", "a+b", "a"], "shrink": ["0.0", "bad"]})
    one_class = folded.withColumn("label", F.lit(1))
    got = H.fit_search({"good": folded, "empty": folded.limit(0), "lost": lambda: spark.table("no_such_table"), "one class": one_class},
                       grid, discriminant, lambda m, rows: m.score(rows), refit="roc_auc", parallelism=3)
    errors = {(r["dataset"], r["trial"], r["fold"]): r["error"] for r in got.errors.collect()}
    assert errors["empty", None, None].startswith("ValueError: a search needs two folds")
    assert errors["lost", None, None].startswith("AnalysisException")
    assert {k for k in errors if k[0] == "good"} == {("good", t, f) for t in (1, 3, 5) for f in range(3)}
    assert errors["good", 1, 0] == "RuntimeError: cannot fit"
    assert sum(k[0] == "one class" for k in errors) == 18
    assert list(got.models) == ["good"]
    scores = got.scores.toPandas()
    assert len(scores) == 3 * 3 * 4 and set(scores.dataset) == {"good"}
    summary = got.summary.where("metric = 'roc_auc'").toPandas().set_index("trial")
    means = scores[scores.metric == "roc_auc"].groupby("trial").value.mean()
    assert np.allclose(summary["mean"].sort_index(), means.sort_index())
    best = got.best.collect()
    assert len(best) == 1 and best[0]["trial"] == means.idxmax() and "a" in best[0]["best_params"]["features"]
    refit = discriminant(folded, best[0]["best_params"])  # all rows, not one fold's
    assert got.models["good"].coefs == pytest.approx(refit.coefs)


def test_fold_scores_are_of_rows_not_trained_on(spark, folded):
    seen, lock = [], threading.Lock()

    def fit(rows, params):
        ids = {r["id"] for r in rows.select("id").collect()}
        return ids

    def score(ids, rows):
        with lock:
            seen.append((frozenset(ids), frozenset(r["id"] for r in rows.select("id").collect())))
        return rows.withColumn("p", F.lit(0.5))

    grid = H.candidate_grid(spark, {"x": [1, 2]})
    drawn = H.random_candidates(grid, 7, seed=1, replacement=True)  # 7 draws of 2 candidates
    got = H.fit_search({"d": folded}, drawn, fit, score, metrics=["brier_score", "pr_auc"])
    assert len(seen) == 2 * 3 and all(not a & b and len(a | b) == 120 for a, b in seen)
    assert {tuple(r) for r in got.scores.where("metric = 'brier_score'").select("trial", "value").collect()} == {(0, 0.25), (1, 0.25)}
    assert got.best.first()["trial"] == 0  # a tie goes to the lower trial
    assert len(got.models["d"]) == 120


def test_lower_is_better_and_bounds(spark, folded, monkeypatch):
    grid = H.candidate_grid(spark, {"p": [0.9, 0.5]})
    got = H.fit_search({"d": folded}, grid, lambda rows, params: float(params["p"]), lambda p, rows: rows.withColumn("p", F.lit(p)),
                       refit="brier_score", metrics=["brier_score"])
    assert got.best.first()["trial"] == 1
    with pytest.raises(ValueError, match="no datasets"):
        H.fit_search({}, grid, None, None)
    monkeypatch.setattr(H, "MAX_FITS", 1)
    with pytest.raises(ValueError, match="candidates"):
        H.fit_search({"d": folded}, grid, None, None)


def test_discriminant_is_the_closed_form(folded):
    pdf = folded.toPandas()
    one, zero = pdf[pdf.label == 1], pdf[pdf.label == 0]
    s = MD.train_discriminant(folded, ["a", "b"], shrink=0.5, prior="equal")
    for f in "ab":
        assert s.coefs[f] == pytest.approx((one[f].mean() - zero[f].mean()) / (pdf[f].var(ddof=0) + 0.5))
    assert s.intercept == pytest.approx(-sum(s.coefs[f] * (one[f].mean() + zero[f].mean()) / 2 for f in "ab"))
    with pytest.raises(ValueError, match="both classes"):
        MD.train_discriminant(folded.where("label = 1"), ["a"])


def test_a_task_holds_few_candidates(spark, folded, monkeypatch):
    grid = H.candidate_grid(spark, {"shrink": ["0.0", None, "0.5"], "k": [1, 2]})
    draws = grid.unionByName(grid.where("trial = 4"))  # a candidate given twice counts twice
    got = H._pair(folded, draws)
    rows = got.select("id", "trial", F.map_entries("params").alias("params"))
    assert sorted(map(str, rows.collect())) == sorted(map(str, folded.crossJoin(draws).select(*rows.columns[:2], F.map_entries("params").alias("params")).collect()))
    per_task = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.countDistinct("trial").alias("n")).collect()]
    assert max(per_task) == 1
    monkeypatch.setattr(H, "MAX_BRANCHES", 2)
    assert H._pair(folded, draws).groupBy("trial").count().collect().__len__() == 6
    none = H._pair(folded, grid.limit(0))
    assert none.count() == 0 and dict(none.dtypes)["params"] == "map<string,string>"
