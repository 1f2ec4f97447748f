"""Registered model, calibration, tree-Shapley and local-surrogate queries.

These results depend on model fitting or randomised perturbations, so
they have no SQL oracle; their invariants (probabilities sum to one,
sum(phi) + base = logit(p), surrogate weights reproduce the score at the
row, ...) are asserted in ``tests/``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scorers import ModelScorer
from ..operators import attribution as X
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import prep as P
from ..operators import surrogate as SG
from ..operators.split import random_holdout
from ..operators.treeshap import explain_trees, stump, tree_shap
from ..session import reuse
from ..sources.tables import read_table
from .catalog import finish, register
from .fixtures import (DOC_FEATURES, EXPLAIN_SCORER, doc_background, doc_explain_table, document_features)

KEY = ["doc_id"]
PRESET = "fast"


def _train_test(spark, d):
    feats = reuse(document_features(spark, d).drop("p", "pred"))
    return feats.where(F.col("split") == "train"), feats.where(F.col("split") == "test"), feats


@register("model_gbt_eval")
def model_gbt_eval(spark, d):
    """Boosted trees on the document features: metrics per split."""
    train, _, feats = _train_test(spark, d)
    model = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    scored = MD.predict_proba(model, feats)
    return finish(M.evaluate_by(scored, ["split"], pred="pred"))


@register("model_mlp_eval")
def model_mlp_eval(spark, d):
    train, _, feats = _train_test(spark, d)
    model = MD.train_mlp(train, DOC_FEATURES, "label", hidden=(8,), max_iter=50)
    return finish(M.evaluate_by(MD.predict_proba(model, feats), ["split"], pred="pred"))


@register("model_distill_eval")
def model_distill_eval(spark, d):
    """GBT teacher -> linear softmax student, both softened (alpha 0.7, T 2)."""
    train, _, feats = _train_test(spark, d)
    teacher = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    student = MD.distill(train, teacher, DOC_FEATURES, "label", alpha=0.7, temperature=2.0)
    s = MD.predict_proba(student, feats).withColumn("model", F.lit("student"))
    t = MD.predict_proba(teacher, feats).withColumn("model", F.lit("teacher"))
    return finish(M.evaluate_by(s.unionByName(t), ["model", "split"], pred="pred"))


@register("model_distill_loss")
def model_distill_loss(spark, d):
    """Distillation loss (T 2) on train and test of three students of the same boosted
    trees: softened like the teacher, fitted at T 1, and on hard labels only."""
    train, _, feats = _train_test(spark, d)
    teacher = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    scored = reuse(MD.predict_proba(teacher, feats, out="teacher").withColumn("logits", P.teacher_logits(F.col("teacher"))))
    fit = scored.where(F.col("split") == "train")
    out = None
    for name, alpha, t in (("softened", 0.7, 2.0), ("T 1", 0.7, 1.0), ("hard labels", 0.0, 1.0)):
        student = MD.distill(fit, "teacher", DOC_FEATURES, "label", alpha=alpha, temperature=t)
        loss = M.kd_loss(scored.withColumn("student", student.logits()), "logits", "student", "label", 0.7, 2.0, groups=["split"])
        loss = loss.withColumn("model", F.lit(name)).withColumn("passes", F.lit(len(student.history)).cast("long"))
        out = loss if out is None else out.unionByName(loss)
    return finish(out)


@register("model_importance")
def model_importance(spark, d):
    train, _, _ = _train_test(spark, d)
    model = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    rows = MD.native_importance(model, DOC_FEATURES)
    return finish(spark.createDataFrame(rows, "feature string, importance double"))


@register("model_early_stop")
def model_early_stop(spark, d):
    """GBT with a hash-held-out validation indicator (early stopping)."""
    train, _, feats = _train_test(spark, d)
    tr = random_holdout(train, ["doc_id"], 0.2, seed=42, out="is_val")
    model = MD.train_boosted_trees(tr, DOC_FEATURES, "label", preset="default", validation_col="is_val")
    n_trees = model.stages[-1].getNumTrees
    return finish(M.evaluate_by(MD.predict_proba(model, feats), ["split"], pred="pred")
                  .withColumn("n_trees", F.lit(n_trees).cast("long")))


@register("model_multiclass_eval")
def model_multiclass_eval(spark, d):
    """10-class embeddings: network probabilities -> weighted metrics and
    one-vs-rest ROC-AUC."""
    emb = read_table(spark, d, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0]  # all of them
    feats = [f"e{i}" for i in range(dims)]
    t = emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)])
    model = MD.train_mlp(t, feats, "label", hidden=(16,), n_classes=10, max_iter=50)
    scored = MD.predict_proba(model, t, n_classes=10)
    w = M.weighted_label_metrics(scored, "label", "pred")
    auc = M.roc_auc_ovr_weighted(scored, "label", "proba", 10)
    return finish(w.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k"))


@register("explain_tree_shap")
def explain_tree_shap(spark, d):
    """Exact tree Shapley values (log-odds) of the document GBT for every labelled document."""
    train, _, feats = _train_test(spark, d)
    model = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    return finish(tree_shap(model, feats, DOC_FEATURES, KEY))


def _embedding_table(spark, d):
    """Every component of the vectors as a column, and a two-class label."""
    emb = read_table(spark, d, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0]
    feats = [f"e{i}" for i in range(dims)]
    return emb.select("vec_id", (F.col("label") < 5).cast("int").alias("label"),
                      *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)]), feats


@register("explain_tree_shap_wide")
def explain_tree_shap_wide(spark, d):
    """Exact tree Shapley values of boosted trees over all 64 components of
    the vectors (far beyond what enumerating coalitions could do)."""
    t, feats = _embedding_table(spark, d)
    t = reuse(t)
    model = MD.train_boosted_trees(t, feats, "label", preset="plain")
    return finish(tree_shap(model, t, feats, ["vec_id"]))


_STUMPS = [(-0.05, 0.3), (0.0, 1.0), (0.08, -0.4)]  # (threshold, height), once per component


@register("explain_stump_shap", f"""
WITH x AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
s(thr, h) AS (VALUES {', '.join(f'({t!r}::DOUBLE, {h!r}::DOUBLE)' for t, h in _STUMPS)}),
y AS (SELECT vec_id, i, thr, CASE WHEN v <= thr THEN -h ELSE h END * (1 + i % 7) AS y FROM x, s),
m AS (SELECT i, thr, avg(y) AS mu FROM y GROUP BY i, thr),
f AS (SELECT vec_id, i, sum(y) AS y, sum(mu) AS mu FROM y JOIN m USING (i, thr) GROUP BY vec_id, i)
SELECT vec_id, 'e' || i AS feature, round(y - mu, 6) AS phi, round(sum(mu) OVER (PARTITION BY vec_id), 6) AS base,
       round(sum(y) OVER (PARTITION BY vec_id), 6) AS fx FROM f""")
def explain_stump_shap(spark, d):
    """Tree Shapley values of a fixed ensemble of stumps over all components,
    three on each; covers are counted from the table in one aggregate."""
    t, feats = _embedding_table(spark, d)
    covers = t.agg(F.count("*").alias("n"), *[F.sum((F.col(f) <= thr).cast("long")).alias(f"{f}_{k}")
                                               for f in feats for k, (thr, _) in enumerate(_STUMPS)]).first()
    trees = [stump(i, thr, -h * (1 + i % 7), h * (1 + i % 7), covers[f"{f}_{k}"], covers["n"] - covers[f"{f}_{k}"])
             for i, f in enumerate(feats) for k, (thr, h) in enumerate(_STUMPS)]
    return finish(explain_trees(t, trees, feats, ["vec_id"]))


@register("explain_model_shap")
def explain_model_shap(spark, d):
    """Exact Shapley values of a trained GBT via the model-scorer path
    (rows x coalitions x background scored in batch)."""
    train, _, feats = _train_test(spark, d)
    model = MD.train_boosted_trees(train, DOC_FEATURES, "label", preset=PRESET)
    scorer = ModelScorer(model.stages[-1], DOC_FEATURES)
    bg = doc_background(train)
    return finish(X.shapley_values(feats, DOC_FEATURES, scorer, bg, KEY))


N_PERTURB = 200


def _lime(spark, d):
    t = reuse(doc_explain_table(spark, d))
    return SG.lime_explain(t, t, DOC_FEATURES, EXPLAIN_SCORER, KEY, n_perturb=N_PERTURB, seed=42)


@register("explain_lime")
def explain_lime(spark, d):
    return finish(_lime(spark, d))


@register("explain_lime_importance")
def explain_lime_importance(spark, d):
    return finish(SG.lime_importance(_lime(spark, d), DOC_FEATURES, KEY))


@register("explain_lime_maps")
def explain_lime_maps(spark, d):
    return finish(SG.lime_maps(_lime(spark, d), KEY, DOC_FEATURES))


@register("explain_lime_selected")
def explain_lime_selected(spark, d):
    """Surrogates on the 2 features of each row that explain its score best, as
    maps: the others have weight 0."""
    t = reuse(doc_explain_table(spark, d))
    expl = SG.lime_explain(t, t, DOC_FEATURES, EXPLAIN_SCORER, KEY, seed=42, num_features=2)
    return finish(SG.lime_maps(expl, KEY, DOC_FEATURES))


@register("model_multiclass_trees")
def model_multiclass_trees(spark, d):
    """One-vs-rest boosted trees on the vectors' 10 classes: metrics from their
    probabilities."""
    emb = read_table(spark, d, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0]
    feats = [f"e{i}" for i in range(dims)]
    t = reuse(emb.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(feats)]))
    model = MD.train_boosted_trees(t, feats, "label", params={"maxIter": 3, "maxDepth": 3}, n_classes=10)
    scored = reuse(MD.predict_proba(model, t, n_classes=10))
    w = M.weighted_label_metrics(scored, "label", "pred")
    auc = M.roc_auc_ovr_weighted(scored, "label", "proba", 10)
    return finish(w.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k"))


@register("experiment_documents")
def experiment_documents(spark, d):
    """The whole experiment (split, boosted trees, metrics, Shapley values,
    surrogate, explanation quality) on the labelled documents: one result row."""
    from .experiment import run_experiment
    t = document_features(spark, d).drop("p", "pred", "split")
    return run_experiment(t, DOC_FEATURES, "label", KEY, "documents", "gbt", preset=PRESET)


@register("experiment_ledger")
def experiment_ledger(spark, d):
    """Whole experiments of two models under a stage ledger, with calibration, a
    hash evaluation and interactions, then once more: the second run skips both.
    Returns each experiment's metrics as stored."""
    from uuid import uuid4

    from ..session import ensure_checkpoint_dir
    from .experiment import StageLedger, run_experiments, stored_results
    ledger = StageLedger(spark, f"{ensure_checkpoint_dir(spark)}/experiments/{uuid4().hex}")
    table = reuse(document_features(spark, d).drop("p", "pred", "split").select(*KEY, *DOC_FEATURES, "label"))
    tables = {"documents": {"table": table, "features": DOC_FEATURES, "label": "label", "key_cols": KEY}}
    settings = {"calibration": 0.1, "evaluation": "hash", "interactions": True}
    first = run_experiments(ledger, tables, ["logistic", "mlp"], **settings)
    again = run_experiments(ledger, tables, ["logistic", "mlp"], **settings).withColumnRenamed("status", "second_run")
    runs = first.join(again.drop("error"), ["dataset", "model"])
    return stored_results(ledger).drop("timestamp").join(runs, ["dataset", "model"], "full_outer")


@register("search_grid_ml")
def search_grid_ml(spark, d):
    """Exhaustive CV search with Spark ML's CrossValidator (class-balanced
    hash folds) over a logistic-regression grid: mean ROC-AUC per candidate."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.tuning import ParamGridBuilder

    from ..operators.search import grid_search_ml
    from ..operators.split import stratified_kfold
    train, _, _ = _train_test(spark, d)
    folded = stratified_kfold(train, "label", ["doc_id"], k=3, seed=42)
    data = VectorAssembler(inputCols=DOC_FEATURES, outputCol="features").transform(folded).withColumn(
        "label", F.col("label").cast("double"))
    lr = LogisticRegression(featuresCol="features", labelCol="label")
    grid = ParamGridBuilder().addGrid(lr.regParam, [0.0, 0.1, 1.0]).addGrid(lr.elasticNetParam, [0.0, 0.5]).build()
    ev = BinaryClassificationEvaluator(labelCol="label", metricName="areaUnderROC", numBins=0)
    cv = grid_search_ml(lr, grid, ev, data, fold_col="fold", parallelism=2)
    rows = [(i, float(pm[lr.regParam]), float(pm[lr.elasticNetParam]), float(m))
            for i, (pm, m) in enumerate(zip(grid, cv.avgMetrics))]
    return finish(spark.createDataFrame(rows, "trial long, reg_param double, elastic_net double, roc_auc double"))


@register("search_tune_all")
def search_tune_all(spark, d):
    """The same candidate search on two datasets at once (``dataset`` is
    one more grouping key): best candidate per dataset by mean PR-AUC."""
    from ..functions.scorers import LinearScorer
    from ..operators import search as H
    from ..operators.split import stratified_kfold
    from .fixtures import DOC_SCORER, LINEITEM_KEY, LINEITEM_SCORER, LINEITEM_TIES, scored_lineitem

    def margin(sc: LinearScorer):
        return sc.margin() - F.lit(sc.intercept)
    li = scored_lineitem(spark, d, keep_features=True).where(F.col("split") == "train")
    li = stratified_kfold(li, "label", LINEITEM_KEY, k=3, seed=7, tie_cols=LINEITEM_TIES)
    li = li.select(F.lit("lineitem").alias("dataset"), "label", "fold", margin(LINEITEM_SCORER).alias("z"))
    dc, _, _ = _train_test(spark, d)
    dc = stratified_kfold(dc, "label", ["doc_id"], k=3, seed=7)
    dc = dc.select(F.lit("documents").alias("dataset"), "label", "fold", margin(DOC_SCORER).alias("z"))
    rows = li.unionByName(dc)
    cands = H.candidate_grid(spark, {"intercept": [-0.5, 0.0, 0.5, 1.5], "scale": [0.5, 1.0, 2.0]})

    def score(params):
        m = params["intercept"].cast("double") + params["scale"].cast("double") * F.col("z")
        return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-m)), 6)
    cv = H.cv_scores(rows, cands, score, groups=["dataset"])
    summ = H.search_summary(cv, "pr_auc", groups=["dataset"], decimals=6)
    return finish(H.best_params(summ, cands, "pr_auc", groups=["dataset"]))
