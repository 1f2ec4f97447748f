import json
import os

import pytest
from pyspark.sql import functions as F

from tabulae.operators import ledger as L
from tabulae.sources import files as SF
from tabulae.sources import results as SR


def test_format_mean_std(spark):
    df = spark.createDataFrame([(0.123456, 0.01), (0.5, None), (None, None)], "m double, s double")
    out = [r[0] for r in df.select(L.format_mean_std(F.col("m"), F.col("s"))).collect()]
    assert out == ["0.1235 ± 0.0100", "0.5000 ± NA", "NA ± NA"]


def _results(spark):
    return spark.createDataFrame(
        [("d1", "m1", "accuracy", 0.9, 0.01), ("d1", "m1", "zeta", 1.0, 0.0), ("d1", "m2", "accuracy", 0.8, None)],
        "dataset string, model string, metric string, mean double, std double")


def test_results_table_order_and_pending(spark):
    res = _results(spark)
    t = L.results_table(res, ["zeta", "accuracy"])
    assert t.columns[:5] == ["model", "dataset", "accuracy", "accuracy_mean", "accuracy_std"]
    grid = L.experiment_grid(spark.createDataFrame([("d1",), ("d2",)], "dataset string"), ["m1", "m2"])
    pend = {(r.dataset, r.model) for r in L.pending_experiments(grid, res).collect()}
    assert pend == {("d2", "m1"), ("d2", "m2")}
    assert L.pending_experiments(grid, res, rerun=True).count() == 4


def test_union_summaries_requires_model(spark):
    a = spark.createDataFrame([("d", 0.5, 0.1)], "dataset string, accuracy_mean double, accuracy_std double")
    with pytest.raises(ValueError):
        L.union_summaries([a])
    b = a.withColumn("model", F.lit("m"))
    row = L.union_summaries([b]).first()
    assert row.accuracy == "0.5000 ± 0.1000" and row.f1 == "NA ± NA"


def test_merge_params_later_wins(spark):
    df = spark.range(1).select(
        F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("d"),
        F.create_map(F.lit("b"), F.lit("2")).alias("p"),
        F.create_map(F.lit("a"), F.lit("3"), F.lit("c"), F.lit("3")).alias("t"))
    m = df.select(L.merge_params(F.col("d"), F.col("p"), F.col("t"))).first()[0]
    assert m == {"a": "3", "b": "2", "c": "3"}


def test_experiment_id_is_stable(spark):
    df = spark.range(1).select(F.create_map(F.lit("y"), F.lit("2"), F.lit("x"), F.lit("1")).alias("p"))
    a = df.select(L.experiment_id(F.lit("ds_m"), F.col("p"))).first()[0]
    b = spark.range(1).select(L.experiment_id(F.lit("ds_m"), F.create_map(
        F.lit("x"), F.lit("1"), F.lit("y"), F.lit("2")))).first()[0]
    assert a == b and a.startswith("ds_m_") and len(a) == len("ds_m_") + 8


def test_results_roundtrip(spark, tmpdir_path):
    docs = SR.results_documents(_results(spark))
    path = os.path.join(tmpdir_path, "ledger")
    SR.write_results(docs, path)
    back = SR.read_results(spark, path)
    assert {(r.dataset, r.model) for r in back.collect()} == {("d1", "m1"), ("d1", "m2")}
    long = SR.results_to_long(back)
    assert long.count() == 3


def test_read_best_params(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "best.json")
    with open(p, "w") as f:
        json.dump({"ds": {"XGBoost": {"best_score": 0.9, "best_params": {"max_depth": "3"}}}}, f)
    out = SR.read_best_params(spark, p, "ds", "xgboost").first()
    assert out.best_score == 0.9 and out.best_params == {"max_depth": "3"}


def test_target_detection_csv(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "t.csv")
    with open(p, "w") as f:
        f.write("x,flag,z\n1,a,3\n2,b,4\n3,a,5\n")
    _, tgt = SF.read_table_with_target(spark, p)
    assert tgt == "flag"
    with open(p, "w") as f:
        f.write("x,Outcome,z\n1,0,3\n2,1,4\n")
    _, tgt = SF.read_table_with_target(spark, p)
    assert tgt == "Outcome"


def test_read_arff(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "d.arff")
    with open(p, "w") as f:
        f.write("% comment\n@relation r\n@attribute width numeric\n@attribute 'kind' {a,b}\n"
                "@attribute n integer\n@data\n1.5,'a',3\n?,b,4\n")
    df = SF.read_arff(spark, p)
    rows = sorted(df.collect(), key=lambda r: r.n)
    assert df.columns == ["width", "kind", "n"]
    assert rows[0].width == 1.5 and rows[0].kind == "a" and rows[1].width is None and rows[1].kind == "b"


def test_dataset_registry_errors(spark):
    with pytest.raises(FileNotFoundError):
        SF.dataset(spark, "adult_income", data_dir="/nonexistent")
    with pytest.raises(ValueError):
        SF.dataset(spark, "nope")


def test_read_summaries_dataset_from_path(spark, tmpdir_path):
    for ds in ("alpha", "beta"):
        with open(os.path.join(tmpdir_path, f"{ds}_test_summary.csv"), "w") as f:
            f.write("model,accuracy_mean,accuracy_std\nm1,0.5,0.1\n")
    df = SR.read_summaries(spark, os.path.join(tmpdir_path, "*_test_summary.csv"))
    assert sorted(r.dataset for r in df.collect()) == ["alpha", "beta"]
    out = L.union_summaries([df.withColumn("accuracy_mean", F.col("accuracy_mean").cast("double"))])
    assert out.first().accuracy == "0.5000 ± 0.1000"


def test_snapshot_and_tuning_sinks(spark, tmpdir_path):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1)], "x double, y int")
    SR.write_feature_snapshot(df, os.path.join(tmpdir_path, "snap"), "y")
    assert spark.read.parquet(os.path.join(tmpdir_path, "snap")).columns == ["x", "target"]
    best = spark.createDataFrame([("ds", "gbt", 0.9, {"a": "1"})],
                                 "dataset string, model string, best_score double, best_params map<string,string>")
    SR.write_tuning_summary(best, os.path.join(tmpdir_path, "tune"))
    back = spark.read.option("header", True).csv(os.path.join(tmpdir_path, "tune")).first()
    assert back.dataset == "ds" and json.loads(back.best_params) == {"a": "1"}


def test_candidate_grid_and_random_search(spark):
    from tabulae.operators import search as H
    grid = H.candidate_grid(spark, {"depth": [2, 3], "rate": [0.1, None]})
    rows = {r.trial: r.params for r in grid.collect()}
    assert len(rows) == 4 and rows[1] == {"depth": "2", "rate": None}
    a = H.random_candidates(grid, 3, seed=1)
    assert a.count() == 3 and a.select("trial").distinct().count() == 3
    b = H.random_candidates(grid, 10, seed=1, replacement=True)
    assert b.count() == 10 and b.select("trial").distinct().count() <= 4


def test_best_params_of_every_form(spark, tmpdir_path):
    def read(document, *names):
        p = os.path.join(tmpdir_path, f"{len(os.listdir(tmpdir_path))}.json")
        with open(p, "w") as f:
            json.dump(document, f)
        return [(r.dataset, r.model, r.best_score, r.best_params) for r in SR.read_best_params(spark, p, *names).collect()]

    plain = {"ds": {"MLP": {"epochs": 5, "hidden": [8, 4]}}}
    assert read(plain, "ds", "mlp") == [("ds", "mlp", None, {"epochs": "5", "hidden": "[8,4]"})]
    top = {"best_params": {"depth": 3}, "best_score": 0.5}
    assert read(top, "ds", "gbt") == [(None, None, 0.5, {"depth": "3"})] == read(top)
    both = {**plain, **top}
    assert [r[0] for r in read(both, "ds", "MLP")] == ["ds"] and [r[0] for r in read(both, "other", "mlp")] == [None]
    assert read({}, "ds", "mlp") == []


def test_tuning_json_is_read_back(spark, tmpdir_path):
    best = spark.createDataFrame([("a \"b\"", "M", 0.5, {"x": "1"}), ("c", "M", 0.25, {"y": "2", "z": "u v"}), ("c", "N", None, {})],
                                 "dataset string, model string, best_score double, best_params map<string,string>")
    SR.write_tuning_json(best, os.path.join(tmpdir_path, "t"))
    got = {(r.dataset, r.model): (r.best_score, r.best_params) for r in SR.read_best_params(spark, os.path.join(tmpdir_path, "t", "all")).collect()}
    assert got == {("a \"b\"", "m"): (0.5, {"x": "1"}), ("c", "m"): (0.25, {"y": "2", "z": "u v"}), ("c", "n"): (None, {})}
    one = spark.read.text(os.path.join(tmpdir_path, "t", "by_dataset")).where("dataset = 'c'").first().value
    assert json.loads(one) == {"M": {"best_score": 0.25, "best_params": {"y": "2", "z": "u v"}}, "N": {"best_params": {}}}


def test_several_arff_files(spark, tmpdir_path):
    for name, extra in (("a", ""), ("b", ""), ("c", "@attribute z numeric\n")):
        with open(os.path.join(tmpdir_path, f"{name}.arff"), "w") as f:
            f.write(f"@relation r\n@attribute x numeric\n@attribute y {{u, v}}\n{extra}@data\n1,{'u' if name == 'a' else 'v'}\n")
    path = [os.path.join(tmpdir_path, f"{n}.arff") for n in "abc"]
    df = SF.read_arff(spark, path[:2])
    assert df.columns == ["x", "y"] and sorted(r.y for r in df.collect()) == ["u", "v"]
    with pytest.raises(ValueError, match="different headers"):
        SF.read_arff(spark, path)
    assert len(SF.convert_arff_dir(spark, tmpdir_path, os.path.join(tmpdir_path, "out"))) == 3
