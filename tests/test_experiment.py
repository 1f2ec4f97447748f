import pytest
from pyspark.sql import functions as F

from tabulae.plans import experiment as E
from tabulae.sources.results import read_results


def _table(spark, n=160):
    x = spark.range(n).select("id", (F.pmod(F.xxhash64("id"), F.lit(1000)) / 1000).alias("a"),
                              (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000)) / 1000).alias("b"))
    return x.withColumn("y", (F.col("a") + F.col("b") / 2 > 0.7).cast("int"))


def test_an_experiment_resumes_skips_and_reruns(spark, tmpdir_path, monkeypatch):
    ledger = E.StageLedger(spark, tmpdir_path)
    given = {"table": _table(spark), "features": ["a", "b"], "label": "y", "key_cols": ["id"]}
    options = {"n_background": 5, "n_perturb": 20, "calibration": 0.2, "evaluation": "hash", "interactions": True}
    kept = []
    monkeypatch.setattr(E.StageLedger, "of", lambda self, *a: kept.append(E._Kept(self, *a)) or kept[-1])

    def lost(*args, **kwargs):
        raise RuntimeError("executors lost")

    whole = E.Q.all_interpretability_metrics
    monkeypatch.setattr(E.Q, "all_interpretability_metrics", lost)
    broken = {**given, "features": ["a", "absent"]}
    status = E.run_experiments(ledger, {"broken": broken, "t": given}, ["logistic"], **options).collect()
    assert [(r.dataset, r.status) for r in status] == [("broken", "failed"), ("t", "failed")]
    assert "executors lost" in status[1].error
    before = kept[-1].computed
    assert before[:3] == ["split", "model", "scored"] and "quality" not in before

    monkeypatch.setattr(E.Q, "all_interpretability_metrics", whole)
    first = E.run_experiment(**given, dataset="t", model="logistic", ledger=ledger, **options).first()
    assert kept[-1].computed == ["quality"]  # all other stages were read back
    assert set(first.calibrated_metrics) == set(first.test_metrics) == set(first.evaluation_metrics)
    assert list(first.interactions) == ["a x b"] and first.test_metrics["roc_auc"] > 0.9

    n = len(kept)
    assert [r.status for r in E.run_experiments(ledger, {"t": given}, ["logistic"], **options).collect()] == ["skipped"]
    assert E.run_experiment(**given, dataset="t", model="logistic", ledger=ledger).first() == first and len(kept) == n
    assert [(r.dataset, r.model, r.experiment_name) for r in read_results(spark, f"{tmpdir_path}/results").collect()] == [
        ("t", "logistic", "t_logistic")]


def test_half_written_stages_are_computed_again(spark, tmpdir_path):
    at = E.StageLedger(spark, tmpdir_path).of("a/b", "m")
    path = at.ledger.stage_path("a/b", "m", "s")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    assert at.table("s", lambda: spark.range(5)).count() == 5 and at.computed == ["s"]
    assert at.table("s", lambda: spark.range(9)).count() == 5 and at.computed == ["s"]


def test_folds_and_unknown_names(spark):
    t = _table(spark)
    got = E._evaluation(t, ["a", "b"], "y", ["id"], "cv", lambda rows: E._fit(rows, ["a", "b"], "y", "logistic", "fast"),
                        (), 0.5, 3, 1).collect()
    assert {r.metric for r in got} >= {"accuracy", "roc_auc"} and all(0 <= r["mean"] <= 1 for r in got)
    with pytest.raises(ValueError, match="Unknown evaluation"):
        E._evaluation(t, ["a"], "y", ["id"], "x", None, (), 0.5, 3, 1)
    with pytest.raises(ValueError, match="Unknown model"):
        E._fit(t, ["a"], "y", "x", "fast")
