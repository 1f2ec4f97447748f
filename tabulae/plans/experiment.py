"""End-to-end experiment job: split -> train -> evaluate -> calibrate -> explain
-> interactions -> explanation quality -> one result row, every step a
DataFrame job.

Each step's table is a stage. Without a ledger a stage is written once to the
checkpoint folder; with a ``StageLedger`` it is kept under the experiment's
folder, so that a run that was lost goes on after its last finished stage, and
an experiment with a stored result is skipped. The driver only holds the fitted
model and small statistics.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scorers import ModelScorer
from ..operators import attribution as X
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import surrogate as SG
from ..operators import xquality as Q
from ..operators.prep import hash_sample
from ..operators.split import hash_split, random_holdout, stratified_kfold, stratified_split
from ..session import reuse

TRAIN, HOLDOUT, TEST = "train", "holdout", "test"


class StageLedger:
    """Stages and results of experiments under one shared folder.

    ``stages/<dataset>/<model>/<stage>`` holds a stage's table and
    ``results/dataset=<dataset>/model=<model>`` the result. A folder counts as
    finished once Spark's commit marker is there, which is written last: what a
    lost job left half-written is computed again. The settings of a finished
    stage are not compared; give other settings another folder, or ``rerun``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def finished(self, path: str) -> bool:
        marker = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return marker.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)

    def stage_path(self, dataset: str, model: str, stage: str) -> str:
        return f"{self.root}/stages/{quote(dataset, safe='')}/{quote(model, safe='')}/{stage}"

    def result_path(self, dataset: str, model: str) -> str:
        return f"{self.root}/results/dataset={quote(dataset, safe='')}/model={quote(model, safe='')}"

    def of(self, dataset: str, model: str, rerun: bool = False) -> "_Kept":
        return _Kept(self, dataset, model, rerun)


class _Kept:
    """One experiment's stages in a ledger; ``rerun`` computes all of them again."""

    def __init__(self, ledger: StageLedger, dataset: str, model: str, rerun: bool):
        self.ledger, self.names, self.rerun = ledger, (dataset, model), rerun
        self.computed: list[str] = []

    def table(self, stage: str, compute: Callable[[], DataFrame]) -> DataFrame:
        path = self.ledger.stage_path(*self.names, stage)
        if self.rerun or not self.ledger.finished(path):
            compute().write.mode("overwrite").parquet(path)
            self.computed.append(stage)
        return self.ledger.spark.read.parquet(path)

    def model(self, stage: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        path = self.ledger.stage_path(*self.names, f"{stage}_files")

        def saved() -> DataFrame:
            # The table is the model's marker: it is written after all of the model's files.
            fit().write().overwrite().save(path)
            return self.ledger.spark.range(1).select(F.lit(path).alias("path"))

        self.table(stage, saved)
        return PipelineModel.load(path)


class _Once:
    """Stages of an experiment without a ledger."""

    def table(self, stage: str, compute: Callable[[], DataFrame]) -> DataFrame:
        return reuse(compute())

    def model(self, stage: str, fit: Callable[[], PipelineModel]) -> PipelineModel:
        return fit()


def _fit(train: DataFrame, features: Sequence[str], label: str, model: str, preset: str) -> PipelineModel:
    if model == "gbt":
        return MD.train_boosted_trees(train, features, label, preset=preset)
    if model == "mlp":
        return MD.train_mlp(train, features, label, hidden=(16,), max_iter=50)
    if model == "logistic":
        return MD.train_logistic(train, features, label)
    raise ValueError(f"Unknown model: {model}")


def _evaluation(data: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str], kind: str, fit,
                columns: Sequence[str], threshold: float, folds: int, seed: int) -> DataFrame:
    """(metric, mean, std) of fits on other parts of the whole table: ``hash``
    trains on the rows whose hashed ``columns`` lie under the threshold and tests
    on the rest, ``cv`` leaves out one class-balanced fold after the other."""
    if kind == "hash":
        parts = reuse(hash_split(data, columns or features, threshold, "_part"))
        pairs = [(F.col("_part") == TRAIN, F.col("_part") == TEST)]
    elif kind == "cv":
        parts = reuse(stratified_kfold(data, label, key_cols, folds, seed, "_part"))
        pairs = [(F.col("_part") != k, F.col("_part") == k) for k in range(folds)]
    else:
        raise ValueError(f"Unknown evaluation: {kind}")
    scored = None
    for k, (inside, outside) in enumerate(pairs):
        one = MD.predict_proba(fit(parts.where(inside)), parts.where(outside)).select(
            F.lit(k).alias("_fold"), F.col(label).alias("label"), "p", "pred")
        scored = one if scored is None else scored.unionByName(one)
    return M.aggregate_folds(M.evaluate_by(scored, ["_fold"], pred="pred")).select("metric", "mean", "std")


def _as_map(table: DataFrame, key, value: str, name: str) -> DataFrame:
    return table.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, F.col(value).cast("double"))))).alias(name))


def run_experiment(table: DataFrame, features: Sequence[str], label: str, key_cols: Sequence[str],
                   dataset: str, model: str = "gbt", preset: str = "fast", test_size: float = 0.2,
                   seed: int = 42, n_background: int = 50, n_perturb: int = 200, calibration: float = 0.0,
                   evaluation: str | None = None, eval_columns: Sequence[str] = (), threshold: float = 0.5,
                   folds: int = 5, interactions: bool = False, ledger: StageLedger | None = None,
                   rerun: bool = False) -> DataFrame:
    """One row: dataset, model, timestamp, train and test metric maps, the
    explanation-quality map, and the maps of what was asked for besides (else
    null): test metrics calibrated on the part ``calibration`` of the train rows,
    which the model then does not see; mean metrics of a ``hash`` or ``cv``
    evaluation; mean |interaction| per pair of features.

    With a ``ledger`` the result is written last; a stored one is returned
    without any computation unless ``rerun``.
    """
    if ledger and not rerun and ledger.finished(ledger.result_path(dataset, model)):
        return stored_results(ledger).where((F.col("dataset") == dataset) & (F.col("model") == model))
    at = ledger.of(dataset, model, rerun) if ledger else _Once()

    def parted() -> DataFrame:
        data = stratified_split(table.select(*key_cols, *features, label), label, key_cols, test_size, seed)
        if not calibration:
            return data
        train = random_holdout(data.where(F.col("split") == TRAIN), key_cols, calibration, seed, "_held")
        train = train.withColumn("split", F.when(F.col("_held"), F.lit(HOLDOUT)).otherwise(F.col("split"))).drop("_held")
        return train.unionByName(data.where(F.col("split") == TEST))

    def fit(rows: DataFrame) -> PipelineModel:
        return _fit(rows, features, label, model, preset)

    data = at.table("split", parted)
    train = data.where(F.col("split") == TRAIN)
    fitted = at.model("model", lambda: fit(train))
    scored = at.table("scored", lambda: MD.predict_proba(fitted, data).select(
        *key_cols, *features, F.col(label).alias("label"), "split", "p", "pred"))
    metrics = at.table("metrics", lambda: M.evaluate_by(scored.where(F.col("split") != HOLDOUT), ["split"], pred="pred"))
    maps = [_as_map(metrics.where(F.col("split") == TRAIN), "metric", "value", "train_metrics"),
            _as_map(metrics.where(F.col("split") == TEST), "metric", "value", "test_metrics")]
    if calibration:
        cal = at.table("calibration", lambda: M.calibrated_metrics(scored.where(F.col("split") == HOLDOUT),
                                                                   scored.where(F.col("split") == TEST)))
        maps.append(_as_map(cal.where("calibrated"), "metric", "value", "calibrated_metrics"))
    if evaluation:
        means = at.table(f"evaluation_{evaluation}", lambda: _evaluation(
            data.drop("split"), features, label, key_cols, evaluation, fit, eval_columns, threshold, folds, seed))
        maps.append(_as_map(means, "metric", "mean", "evaluation_metrics"))

    test = scored.where(F.col("split") == TEST).select(*key_cols, *features)
    scorer = ModelScorer(fitted.stages[-1], features)
    bg = hash_sample(train, n_background, key_cols, seed)
    phi = at.table("shap", lambda: X.shapley_values(test, features, scorer, bg, key_cols))
    local = at.table("lime", lambda: SG.lime_explain(test, train, features, scorer, key_cols, n_perturb=n_perturb, seed=seed))
    if interactions:
        pairs = at.table("interactions", lambda: X.interaction_values(test, features, scorer, bg, key_cols)
                         .where("order = 2").groupBy("feature_i", "feature_j").agg(F.avg(F.abs("value")).alias("strength")))
        maps.append(_as_map(pairs, F.concat_ws(" x ", "feature_i", "feature_j"), "strength", "interactions"))

    def explained() -> DataFrame:
        shap = phi.select(*key_cols, "feature", F.col("phi").alias("value"))
        lime = local.select(*key_cols, "feature", F.col("weight").alias("value"))
        return Q.all_interpretability_metrics(Q.importance_runs(phi, key_cols, rows=test), shap, lime, test, key_cols,
                                              features, scorer)

    maps.append(_as_map(at.table("quality", explained), "metric", "value", "interpretability_metrics"))
    out = maps[0]
    for m in maps[1:]:  # one row each
        out = out.join(F.broadcast(m), F.lit(True))
    none = F.lit(None).cast("map<string,double>")
    out = out.select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"),
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
                     *[F.col(m) if m in out.columns else none.alias(m) for m in MAPS])
    if ledger is None:
        return out
    document = out.select(F.concat_ws("_", "dataset", "model").alias("experiment_name"), "timestamp",
                          F.struct(F.col("test_metrics").alias("mean"), F.create_map().cast("map<string,double>").alias("std"))
                          .alias("test_metrics"), *[m for m in MAPS if m != "test_metrics"])
    document.write.mode("overwrite").json(ledger.result_path(dataset, model))
    return stored_results(ledger).where((F.col("dataset") == dataset) & (F.col("model") == model))


MAPS = ("train_metrics", "test_metrics", "interpretability_metrics", "calibrated_metrics", "evaluation_metrics", "interactions")


def stored_results(ledger: StageLedger) -> DataFrame:
    """One row per stored experiment, as ``run_experiment`` returns it."""
    maps = ", ".join(f"{m} map<string,double>" for m in MAPS if m != "test_metrics")
    schema = (f"timestamp string, test_metrics struct<mean: map<string,double>>, {maps}, dataset string, model string")
    path = f"{ledger.root}/results"
    raw = ledger.spark.read.option("basePath", path).schema(schema).json(path)
    return raw.select("dataset", "model", "timestamp",
                      *[F.col("test_metrics.mean").alias(m) if m == "test_metrics" else m for m in MAPS])


def run_experiments(ledger: StageLedger, tables: Mapping[str, Mapping], models: Sequence[str], rerun: bool = False,
                    **settings) -> DataFrame:
    """(dataset, model, status, error) of every dataset and model, in order:
    ``done``, ``skipped`` (a result was stored) or ``failed`` with its error; a
    failing experiment leaves the others alone. ``tables`` gives each dataset's
    table, features, label and key_cols; ``settings`` go to ``run_experiment``.
    Results: ``stored_results``."""
    rows = []
    for name, given in tables.items():
        for model in models:
            status, error = "done", None
            if not rerun and ledger.finished(ledger.result_path(name, model)):
                status = "skipped"
            else:
                try:
                    run_experiment(**given, dataset=name, model=model, ledger=ledger, rerun=rerun, **settings)
                except Exception as e:  # any error of this experiment is its own row
                    status, error = "failed", f"{type(e).__name__}: {e}"[:500]
            rows.append((name, model, status, error))
    return ledger.spark.createDataFrame(rows, "dataset string, model string, status string, error string")
