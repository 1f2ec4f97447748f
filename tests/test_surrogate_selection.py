"""Feature selection of local surrogates, and one-vs-rest probabilities."""
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulae.functions.scorers import LinearScorer
from tabulae.operators import models as MD
from tabulae.operators import surrogate as SG


def equations(rng, n=25, d=5, rows=60):
    x = rng.integers(0, 2, (n, rows, d)).astype(float)
    y = (x * rng.normal(size=(n, 1, d))).sum(axis=2) + 0.1 * rng.normal(size=(n, rows))
    xc, yc = x - x.mean(axis=1, keepdims=True), y - y.mean(axis=1, keepdims=True)
    return xc, yc, np.einsum("nri,nrj->nij", xc, xc), np.einsum("nri,nr->ni", xc, yc)


def test_forward_selection_is_greedy_least_squares():
    xc, yc, a, b = equations(np.random.default_rng(1))
    used = SG.select_features(a, b, 3, forward=True)
    for x, y, got in zip(xc, yc, used):
        chosen = []
        for _ in range(3):
            def error(j):
                cols = x[:, [*chosen, j]]
                return ((y - cols @ np.linalg.lstsq(cols, y, rcond=None)[0]) ** 2).sum()
            chosen.append(min((j for j in range(5) if j not in chosen), key=error))
        assert set(np.flatnonzero(got)) == set(chosen)


def test_largest_weights_and_all():
    xc, yc, a, b = equations(np.random.default_rng(2))
    used = SG.select_features(a, b, 2, forward=False)
    for m, v, got in zip(a, b, used):
        w = np.abs(np.linalg.solve(m + 0.01 * np.eye(5), v))
        assert set(np.flatnonzero(got)) == set(np.argsort(-w)[:2])
    assert SG.select_features(a, b, 5, True).all() and SG.select_features(a, b, 9, False).all()
    sub = SG.ridge_on(a, b, used, 1.0)
    for m, v, got, w in zip(a, b, used, sub):
        at = np.flatnonzero(got)
        assert np.allclose(w[at], np.linalg.solve(m[np.ix_(at, at)] + np.eye(2), v[at])) and not w[~got].any()


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    return spark.createDataFrame([(i, *map(float, r), int(abs(r[0]) + (r[1] > 0))) for i, r in enumerate(x)],
                                 "id long, a double, b double, c double, d double, label int")


def test_explanations_of_selected_features(table):
    feats = ["a", "b", "c", "d"]
    scorer = LinearScorer({"a": 3.0, "b": 0.0, "c": -2.0, "d": 0.01}, decimals=None)
    expl = SG.lime_explain(table, table, feats, scorer, ["id"], n_perturb=300, num_features=2).cache()
    assert expl.groupBy("id").count().where("count <> 2").count() == 0
    picked = {r["feature"]: r["count"] for r in expl.groupBy("feature").count().collect()}
    assert picked["a"] + picked["c"] > 100  # of 120
    imp = {r["feature"]: r["importance"] for r in SG.lime_importance(expl, feats, ["id"]).collect()}
    total = {r["feature"]: r["s"] for r in expl.groupBy("feature").agg(F.sum(F.abs("weight")).alias("s")).collect()}
    assert list(imp)[0] == "a" and set(imp) == set(feats)  # rows without a feature count as 0
    assert all(v == pytest.approx(total.get(f, 0.0) / 60) for f, v in imp.items())
    maps = [r["explanation"] for r in SG.lime_maps(expl, ["id"], feats).collect()]
    assert all(set(m) == set(feats) and sum(v != 0 for v in m.values()) <= 2 for m in maps)
    assert SG.lime_explain(table, table, feats, scorer, ["id"], n_perturb=50).count() == 240
    with pytest.raises(ValueError, match="selection"):
        SG.lime_explain(table, table, feats, scorer, ["id"], selection="best")


def test_perturbation_methods_are_short_enough_to_compile(spark, table, capsys):
    """The JVM interprets methods of 8,000 bytes and more, at many times the cost."""
    feats = ["a", "b", "c", "d"]
    scorer = LinearScorer({"a": 3.0, "b": 0.0, "c": -2.0, "d": 0.01}, decimals=None)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        SG.lime_explain(table, table, feats, scorer, ["id"], num_features=2).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_weights_match_a_plain_computation_of_the_same_draws(spark):
    """One feature, one quartile bin each: ridge of y on z with kernel weights, by hand."""
    rows = spark.createDataFrame([(i, float(i % 4)) for i in range(40)] + [(3, 3.0)], "id long, a double")
    scorer = LinearScorer({"a": 1.0}, decimals=None)
    stats = SG.bin_statistics(rows, ["a"])
    got = {r["id"]: r for r in SG.lime_explain(rows, rows, ["a"], scorer, ["id"], n_perturb=60, stats=stats).collect()}
    drawn = rows.select("id", "a", F.explode(F.sequence(F.lit(0), F.lit(59))).alias("s")).select(
        "id", "a", "s", *[((F.pmod(F.xxhash64("id", "s", F.lit(0), F.lit(k), F.lit(42)), F.lit(1 << 53)).cast("double") + 0.5)
                           / float(1 << 53)).alias(f"u{k}") for k in range(3)]).collect()
    cuts, bins = stats["cuts"]["a"], stats["stats"]["a"]
    total = sum(b[0] for b in bins.values())
    by_id = {}
    for r in drawn:
        own = sum(r["a"] > c for c in cuts)
        share, b = 0.0, None
        for k in sorted(bins):
            share += bins[k][0] / total
            if b is None and r["u0"] < share:
                b = k
        n, mean, std, lo, hi = bins[max(bins) if b is None else b]
        v = min(max(mean + std * math.sqrt(-2 * math.log(r["u1"])) * math.cos(2 * math.pi * r["u2"]), lo), hi)
        z = 1.0 if r["s"] == 0 else float(own == (max(bins) if b is None else b))
        v = r["a"] if r["s"] == 0 else v
        w = math.sqrt(math.exp(-(1 - z) ** 2 / 0.75 ** 2))
        by_id.setdefault(r["id"], []).append((w, z, 1 / (1 + math.exp(-v))))
    assert set(got) == set(by_id) == set(range(40)) and len(by_id[3]) == 120  # a repeated key is one group
    for i, part in by_id.items():
        w, z, y = np.array(part).T
        mz, my = (w * z).sum() / w.sum(), (w * y).sum() / w.sum()
        beta = (w * (z - mz) * (y - my)).sum() / ((w * (z - mz) ** 2).sum() + 1)
        assert got[i]["weight"] == pytest.approx(beta, abs=1e-10)
        assert got[i]["intercept"] == pytest.approx(my - beta * mz, abs=1e-10)


def test_one_vs_rest_probabilities(table):
    k = table.agg(F.max("label")).first()[0] + 1
    model = MD.train_boosted_trees(table, ["a", "b", "c", "d"], "label", params={"maxIter": 3, "maxDepth": 3}, n_classes=k)
    rows = MD.predict_proba(model, table, n_classes=k).collect()
    hard = {r["id"]: r["prediction"] for r in model.transform(table).collect()}
    for r in rows:
        assert len(r["proba"]) == k and sum(r["proba"]) == pytest.approx(1.0) and min(r["proba"]) > 0
        assert r["p"] == max(r["proba"]) and r["pred"] == r["proba"].index(r["p"]) == hard[r["id"]]
    assert len({tuple(r["proba"]) for r in rows}) > 5
    assert list(itertools.chain(rows[0].asDict())) == [*table.columns, "proba", "p", "pred"]
