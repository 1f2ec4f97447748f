"""Registered ledger and search queries (L, H, S round trip).

Results come from real work on the driver tables: every (dataset, model)
pair is evaluated on repeated stratified test splits (runs), then
aggregated -- the long table ``(dataset, model, metric, mean, std)`` that
the reference writes one JSON file per experiment for.
"""

from __future__ import annotations

import itertools
import uuid

from pyspark.sql import functions as F

from ..functions.scorers import LinearScorer
from ..operators import ledger as L
from ..operators import metrics as M
from ..operators import models as MD
from ..operators import search as H
from ..operators.split import repeated_splits, stratified_kfold
from ..session import ensure_checkpoint_dir, reuse
from ..sources import results as S
from ..sources.tables import read_table
from .catalog import finish, register
from .fixtures import (DOC_FEATURES, DOC_SCORER, LINEITEM_ALT_SCORERS, LINEITEM_FEATURES, LINEITEM_KEY, LINEITEM_SCORER,
                       LINEITEM_TIES, document_features, document_features_sql, scored_lineitem, scored_lineitem_sql)
from .sqlparts import R, evaluate_long_sql, hash_rank_expr, stratified_sql

N_RUNS = 3
METRICS = M.DEFAULT_METRICS
DOC_FLIP = LinearScorer({k: -v for k, v in DOC_SCORER.coefs.items()}, intercept=DOC_SCORER.intercept, name="doc_flip")
DOC_SCORERS = [DOC_SCORER, DOC_FLIP]


# ------------------------------------------------------------------ results
def _test_runs(scored, key, ties):
    runs = repeated_splits(scored, "label", key, n_runs=N_RUNS, test_size=0.2, seed=42, tie_cols=ties)
    return runs.where(F.col("split") == "test").select("run", "label", "p", "pred")


def results_long(spark, d):
    """All (dataset, model) pairs are unioned first, so the evaluation is
    one grouped job over (dataset, model, run) instead of one per pair."""
    parts = []
    for sc in LINEITEM_ALT_SCORERS:
        s = scored_lineitem(spark, d, scorer=sc).drop("split")
        parts.append(_test_runs(s, LINEITEM_KEY, LINEITEM_TIES).select(
            F.lit("lineitem").alias("dataset"), F.lit(sc.name).alias("model"), "*"))
    docs = document_features(spark, d).drop("split", "p", "pred")
    for sc in DOC_SCORERS:
        s = docs.withColumn("p", sc.proba()).withColumn("pred", M.threshold_labels("p"))
        parts.append(_test_runs(s, ["doc_id"], []).select(
            F.lit("documents").alias("dataset"), F.lit(sc.name).alias("model"), "*"))
    tests = parts[0]
    for p in parts[1:]:
        tests = tests.unionByName(p)
    per = M.evaluate_by(tests, ["dataset", "model", "run"], pred="pred")
    per = per.withColumn("value", F.round("value", R))
    return M.aggregate_runs(per, "run", ["dataset", "model"]).select("dataset", "model", "metric", "mean", "std")


def _runs_sql(src: str, key, ties) -> str:
    ex = f"(SELECT s.*, r.range AS run FROM {src} s, range({N_RUNS}) r)"
    sp = stratified_sql(ex, "label", key, 0.2, 42, ["run"], "run", ties)
    test = f"(SELECT * FROM {sp} WHERE split = 'test')"
    return f"""(SELECT metric, avg(value) AS mean, stddev_pop(value) AS std
      FROM ({evaluate_long_sql(test, ['run'], extra=False)}) GROUP BY metric)"""


def results_long_sql() -> str:
    parts = []
    for sc in LINEITEM_ALT_SCORERS:
        src = f"(SELECT * EXCLUDE (split) FROM {scored_lineitem_sql(sc)})"
        parts.append(f"SELECT 'lineitem' AS dataset, '{sc.name}' AS model, metric, mean, std "
                     f"FROM {_runs_sql(src, LINEITEM_KEY, LINEITEM_TIES)}")
    for sc in DOC_SCORERS:
        src = (f"(SELECT doc_id, label, {sc.proba_sql()} AS p, CAST({sc.proba_sql()} >= 0.5 AS INTEGER) AS pred "
               f"FROM {document_features_sql()})")
        parts.append(f"SELECT 'documents' AS dataset, '{sc.name}' AS model, metric, mean, std "
                     f"FROM {_runs_sql(src, ['doc_id'], [])}")
    return "(" + "\nUNION ALL\n".join(parts) + ")"


RES_SQL = results_long_sql()


@register("ledger_results", f"""SELECT dataset, model, metric, round(mean, {R}) AS mean, round(std, {R}) AS std
FROM {RES_SQL}""")
def ledger_results(spark, d):
    return finish(results_long(spark, d))


# ------------------------------------------------------------------ L1 / L2
MODEL_NAMES = ["base", "wide", "flip", "doc", "doc_flip"]


def _datasets(spark, d):
    li = read_table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("lineitem").alias("dataset"), "n_rows")
    dc = read_table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit("documents").alias("dataset"), "n_rows")
    return li.unionByName(dc)


_GRID_SQL = """(SELECT d.dataset, d.n_rows, m.model FROM
  (SELECT 'lineitem' AS dataset, count(*) AS n_rows FROM lineitem
   UNION ALL SELECT 'documents', count(*) FROM documents) d,
  (VALUES """ + ", ".join(f"('{m}')" for m in MODEL_NAMES) + """) AS m(model))"""


@register("ledger_experiment_grid", f"SELECT dataset, n_rows, model FROM {_GRID_SQL}")
def ledger_experiment_grid(spark, d):
    return finish(L.experiment_grid(_datasets(spark, d), MODEL_NAMES))


@register("ledger_pending", f"""SELECT g.dataset, g.n_rows, g.model FROM {_GRID_SQL} g
WHERE NOT EXISTS (SELECT 1 FROM {RES_SQL} r WHERE r.dataset = g.dataset AND r.model = g.model)""")
def ledger_pending(spark, d):
    grid = L.experiment_grid(_datasets(spark, d), MODEL_NAMES)
    return finish(L.pending_experiments(grid, results_long(spark, d)))


# ------------------------------------------------------------------ L3 / L4 / L5
@register("ledger_flatten", f"""SELECT dataset, model, {', '.join(
    f"round(max(mean) FILTER (WHERE metric = '{m}'), {R}) AS test_{m}" for m in METRICS)}
FROM {RES_SQL} GROUP BY dataset, model""")
def ledger_flatten(spark, d):
    return finish(L.flatten_results(results_long(spark, d), METRICS))


def _fmt_sql(m: str, numeric: bool = True) -> str:
    mean, std = f"max(mean) FILTER (WHERE metric = '{m}')", f"max(std) FILTER (WHERE metric = '{m}')"
    text = (f"CASE WHEN {mean} IS NOT NULL AND {std} IS NOT NULL THEN "
            f"printf('%.4f', round({mean}, 4)) || ' ± ' || printf('%.4f', round({std}, 4)) "
            f"WHEN {mean} IS NOT NULL THEN printf('%.4f', round({mean}, 4)) || ' ± NA' ELSE 'NA ± NA' END AS {m}")
    return text + (f", round({mean}, {R}) AS {m}_mean, round({std}, {R}) AS {m}_std" if numeric else "")


@register("ledger_results_table", f"""SELECT model, dataset, {', '.join(_fmt_sql(m) for m in L.metric_order(METRICS))}
FROM {RES_SQL} GROUP BY model, dataset""")
def ledger_results_table(spark, d):
    return finish(L.results_table(results_long(spark, d), METRICS))


@register("ledger_union_summaries", f"""
WITH a AS (SELECT model, dataset, {', '.join(_fmt_sql(m) for m in L.metric_order(METRICS))}
           FROM {RES_SQL} WHERE dataset = 'lineitem' GROUP BY model, dataset),
b AS (SELECT model, dataset, {', '.join(_fmt_sql(m) for m in L.metric_order(METRICS))}
      FROM {RES_SQL} WHERE dataset = 'documents' GROUP BY model, dataset)
SELECT dataset, model, {', '.join(L.PREFERRED_METRICS)} FROM a
UNION ALL SELECT dataset, model, {', '.join(L.PREFERRED_METRICS)} FROM b""")
def ledger_union_summaries(spark, d):
    """Two per-dataset summaries in different shapes -- one with formatted
    columns, one with only numeric ``_mean``/``_std`` columns -- normalised
    and concatenated."""
    res = results_long(spark, d)
    a = L.results_table(res.where(F.col("dataset") == "lineitem"), METRICS)
    b = L.results_table(res.where(F.col("dataset") == "documents"), METRICS, keep_numeric=True)
    b = b.select("model", "dataset", *[c for c in b.columns if c.endswith(("_mean", "_std"))])
    return finish(L.union_summaries([a, b]))


# ------------------------------------------------------------------ L9 / L10, H
def _scorer_params(sc: LinearScorer):
    return F.create_map(*[x for k, v in sorted({**sc.coefs, "intercept": sc.intercept}.items())
                          for x in (F.lit(k), F.lit(repr(float(v))))])


def _params_json_sql(sc: LinearScorer) -> str:
    items = sorted({**sc.coefs, "intercept": sc.intercept}.items())
    return "{" + ",".join(f'"{k}":"{float(v)!r}"' for k, v in items) + "}"


_PJ = ", ".join(f"('{sc.name}', '{_params_json_sql(sc)}')" for sc in [*LINEITEM_ALT_SCORERS, *DOC_SCORERS])


@register("ledger_experiment_id", f"""SELECT r.dataset, r.model,
  r.dataset || '_' || r.model || '_' || substr(sha256(p.js), 1, 8) AS experiment_name
FROM (SELECT DISTINCT dataset, model FROM {RES_SQL}) r JOIN (VALUES {_PJ}) AS p(model, js) ON p.model = r.model""")
def ledger_experiment_id(spark, d):
    res = results_long(spark, d).select("dataset", "model").distinct()
    pm = None
    for sc in [*LINEITEM_ALT_SCORERS, *DOC_SCORERS]:
        part = spark.range(1).select(F.lit(sc.name).alias("model"), _scorer_params(sc).alias("params"))
        pm = part if pm is None else pm.unionByName(part)
    j = res.join(pm, "model")
    name = F.concat_ws("_", "dataset", "model")
    return finish(j.select("dataset", "model", L.experiment_id(name, F.col("params")).alias("experiment_name")))


SEARCH_GRID = {"intercept": [-0.6, -0.4, -0.2], "scale": [0.5, 1.0, 2.0]}
REFIT = "pr_auc"
N_FOLDS = 3


def _search_score(params):
    z = LINEITEM_SCORER.margin() - F.lit(LINEITEM_SCORER.intercept)
    m = params["intercept"].cast("double") + params["scale"].cast("double") * z
    return F.round(F.lit(1.0) / (F.lit(1.0) + F.exp(-m)), 6)


def _cv_long(spark, d, candidates=None):
    train = scored_lineitem(spark, d, keep_features=True).where(F.col("split") == "train").drop("split")
    folded = stratified_kfold(train, "label", LINEITEM_KEY, k=N_FOLDS, seed=7, tie_cols=LINEITEM_TIES)
    cands = candidates if candidates is not None else H.candidate_grid(spark, SEARCH_GRID)
    cv = H.cv_scores(folded.select("label", "fold", *LINEITEM_SCORER.features), cands, _search_score)
    return cv.withColumn("value", F.round("value", R)), cands


def _cands_sql() -> str:
    rows = []
    t = 0
    for a in SEARCH_GRID["intercept"]:
        for b in SEARCH_GRID["scale"]:
            rows.append(f"({t}, {a!r}, {b!r})")
            t += 1
    return "(VALUES " + ", ".join(rows) + ") AS c(trial, intercept, scale)"


def _cv_sql(cands: str | None = None) -> str:
    z = LINEITEM_SCORER.margin_sql() + f" - {float(LINEITEM_SCORER.intercept)!r}"
    src = f"(SELECT * FROM {scored_lineitem_sql(keep_features=True)} WHERE split = 'train')"
    fold = f"(({hash_rank_expr(LINEITEM_KEY, ['label'], 7, tie_cols=LINEITEM_TIES)}) - 1) % {N_FOLDS}"
    p = f"round(1.0 / (1.0 + exp(-(CAST(c.intercept AS DOUBLE) + CAST(c.scale AS DOUBLE) * ({z})))), 6)"
    scored = (f"(SELECT c.trial, f.fold, f.label, {p} AS p, CAST({p} >= 0.5 AS INTEGER) AS pred "
              f"FROM (SELECT *, {fold} AS fold FROM {src}) f, {cands or _cands_sql()})")
    return f"""(SELECT * FROM ({evaluate_long_sql(scored, ['trial', 'fold'], extra=False)})
       WHERE metric IN ('roc_auc', 'pr_auc', 'f1', 'brier_score'))"""


@register("search_cv_results", f"SELECT CAST(trial AS BIGINT) AS trial, CAST(fold AS BIGINT) AS fold, metric, value FROM {_cv_sql()}")
def search_cv_results(spark, d):
    cv, _ = _cv_long(spark, d)
    return finish(cv.withColumn("fold", F.col("fold").cast("long")))


_SUMM_SQL = f"""(WITH s AS (SELECT trial, metric, avg(value) AS mean, stddev_pop(value) AS std FROM {_cv_sql()}
                 GROUP BY trial, metric),
  b AS (SELECT trial AS best_trial FROM s WHERE metric = '{REFIT}' ORDER BY round(mean, {R}) DESC, trial LIMIT 1)
  SELECT s.*, s.trial = b.best_trial AS best FROM s, b)"""


@register("search_multi_metric", f"""SELECT CAST(trial AS BIGINT) AS trial, metric, round(mean, {R}) AS mean,
       round(std, {R}) AS std, best FROM {_SUMM_SQL}""")
def search_multi_metric(spark, d):
    cv, _ = _cv_long(spark, d)
    return finish(H.search_summary(cv, REFIT, decimals=R))


@register("search_best_params", f"""SELECT CAST(s.trial AS BIGINT) AS trial, round(s.mean, {R}) AS best_score,
  MAP {{'intercept': CAST(c.intercept AS VARCHAR), 'scale': CAST(c.scale AS VARCHAR)}} AS best_params
FROM {_SUMM_SQL} s JOIN {_cands_sql()} ON c.trial = s.trial WHERE s.best AND s.metric = '{REFIT}'""")
def search_best_params(spark, d):
    cv, cands = _cv_long(spark, d)
    return finish(H.best_params(H.search_summary(cv, REFIT, decimals=R), cands, REFIT))


N_ITER = 4


@register("search_random", f"""WITH rc AS (SELECT * FROM {_cands_sql()}
  ORDER BY ('0x' || substr(md5('42:' || CAST(trial AS VARCHAR)), 1, 15))::BIGINT, trial LIMIT {N_ITER})
SELECT CAST(trial AS BIGINT) AS trial, metric, round(avg(value), {R}) AS mean, round(stddev_pop(value), {R}) AS std
FROM {_cv_sql('rc AS c')} GROUP BY trial, metric""")
def search_random(spark, d):
    cands = H.random_candidates(H.candidate_grid(spark, SEARCH_GRID), N_ITER, seed=42)
    cv, _ = _cv_long(spark, d, reuse(cands))
    return finish(cv.groupBy("trial", "metric").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")))


@register("ledger_merge_params", f"""SELECT CAST(s.trial AS BIGINT) AS trial, MAP {{
  'intercept': CAST(c.intercept AS VARCHAR), 'l_discount': '4.0', 'l_extendedprice': '-1e-05',
  'l_quantity': '0.03', 'l_tax': '-3.0', 'scale': CAST(c.scale AS VARCHAR), 'source': 'tuned'}} AS params
FROM {_SUMM_SQL} s JOIN {_cands_sql()} ON c.trial = s.trial WHERE s.best AND s.metric = '{REFIT}'""")
def ledger_merge_params(spark, d):
    """default <- preset <- tuned: scorer defaults, a preset that sets the
    scale and a source tag, then the best parameters of the search."""
    cv, cands = _cv_long(spark, d)
    best = H.best_params(H.search_summary(cv, REFIT, decimals=R), cands, REFIT)
    default = _scorer_params(LINEITEM_SCORER)
    preset = F.create_map(F.lit("scale"), F.lit("1.0"), F.lit("source"), F.lit("preset"))
    tuned = F.map_concat(F.col("best_params"), F.create_map(F.lit("source"), F.lit("tuned")))
    out = best.select("trial", L.merge_params(default, preset, tuned).alias("params"))
    return finish(out.select("trial", F.map_from_entries(F.array_sort(F.map_entries("params"))).alias("params")))


# ------------------------------------------------------------------ S5/S6 round trip
@register("ledger_roundtrip_summary", f"""SELECT model, dataset, {', '.join(
    _fmt_sql(m, numeric=False) for m in L.metric_order(METRICS))}
FROM {RES_SQL} GROUP BY model, dataset""")
def ledger_roundtrip_summary(spark, d):
    """Results written as one JSON document per (dataset, model) under the
    shared checkpoint folder, read back with a fixed schema, summarised."""
    res = results_long(spark, d)
    out_dir = f"{ensure_checkpoint_dir(spark)}/ledger-{uuid.uuid4().hex}"
    S.write_results(S.results_documents(res), out_dir)
    back = S.read_results(spark, out_dir)
    return finish(L.results_table(S.results_to_long(back), METRICS, keep_numeric=False))


# ------------------------------------------------- searches that train their candidates
FIT_GRID = {"prior": ["empirical", "equal"], "shrink": [0.0, 0.5, 4.0]}


def _fit_sets(spark, d):
    """Folded training rows of both datasets (functions: made when searched)."""
    def documents():
        t = document_features(spark, d).where(F.col("split") == "train").select("doc_id", "label", *DOC_FEATURES)
        return stratified_kfold(t, "label", ["doc_id"], k=N_FOLDS, seed=7)

    def lineitem():
        t = scored_lineitem(spark, d, keep_features=True).where(F.col("split") == "train").drop("split")
        return stratified_kfold(t, "label", LINEITEM_KEY, k=N_FOLDS, seed=7, tie_cols=LINEITEM_TIES).drop("p", "pred")
    return {"documents": documents, "lineitem": lineitem}


def _fit_discriminants(spark, d, sets, features):
    return H.fit_search(
        sets, H.candidate_grid(spark, FIT_GRID),
        lambda rows, params: MD.train_discriminant(rows, [f for f in features if f in rows.columns], "label",
                                                   float(params["shrink"]), params["prior"], decimals=6),
        lambda model, rows: model.score(rows.select("label", *model.features), "p"), refit=REFIT, decimals=R)


def _fit_sql(name: str) -> str:
    """Fold scores of the discriminants of one dataset, trained in SQL."""
    if name == "documents":
        src, feats = f"(SELECT * FROM {document_features_sql()} WHERE split = 'train')", DOC_FEATURES
        rank = hash_rank_expr(["doc_id"], ["label"], 7)
    else:
        src, feats = f"(SELECT * FROM {scored_lineitem_sql(keep_features=True)} WHERE split = 'train')", LINEITEM_FEATURES
        rank = hash_rank_expr(LINEITEM_KEY, ["label"], 7, tie_cols=LINEITEM_TIES)
    cands = ", ".join(f"({i}, '{p}', {s!r}::DOUBLE)" for i, (p, s) in enumerate(itertools.product(*FIT_GRID.values())))
    x = {f: f"CAST({f} AS DOUBLE)" for f in feats}
    stats = ", ".join(f"avg({x[f]}) FILTER (WHERE label = 1) AS a_{f}, avg({x[f]}) FILTER (WHERE label <> 1) AS b_{f}, "
                      f"var_pop({x[f]}) AS v_{f}" for f in feats)
    weight = {f: f"coalesce((a_{f} - b_{f}) / nullif(v_{f} + shrink, 0), 0)" for f in feats}
    z = " + ".join(f"{weight[f]} * ({x[f]} - (a_{f} + b_{f}) / 2)" for f in feats)
    p = f"round(1.0 / (1.0 + exp(-(CASE WHEN prior = 'empirical' THEN ln(n1 / n0) ELSE 0 END + {z}))), 6)"
    rows = f"(SELECT label, {', '.join(feats)}, (({rank}) - 1) % {N_FOLDS} AS fold FROM {src})"
    scored = f"""(SELECT trial, r.fold, label, {p} AS p, CAST({p} >= 0.5 AS INTEGER) AS pred
      FROM {rows} r JOIN (
        SELECT g.fold, CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE label <> 1) AS DOUBLE) AS n0,
               {stats}
        FROM {rows} o JOIN (SELECT unnest(range({N_FOLDS})) AS fold) g ON o.fold <> g.fold GROUP BY g.fold) m ON r.fold = m.fold,
      (VALUES {cands}) AS c(trial, prior, shrink))"""
    return f"""(SELECT '{name}' AS dataset, trial, fold, metric, value FROM ({evaluate_long_sql(scored, ['trial', 'fold'], extra=False)})
       WHERE metric IN ('roc_auc', 'pr_auc', 'f1', 'brier_score'))"""


@register("search_fit_scores", f"""SELECT dataset, CAST(trial AS BIGINT) AS trial, CAST(fold AS BIGINT) AS fold, metric, value
FROM {_fit_sql('documents')}""")
def search_fit_scores(spark, d):
    """Every fold's scores of every trained candidate (discriminants) on the documents."""
    found = _fit_discriminants(spark, d, {"documents": _fit_sets(spark, d)["documents"]}, DOC_FEATURES)
    return finish(found.scores)


@register("search_fit_all", f"""WITH s AS (
  SELECT dataset, trial, avg(value) AS mean FROM (SELECT * FROM {_fit_sql('documents')} UNION ALL SELECT * FROM {_fit_sql('lineitem')})
  WHERE metric = '{REFIT}' GROUP BY dataset, trial)
SELECT dataset, CAST(trial AS BIGINT) AS trial, round(mean, {R}) AS best_score, NULL::VARCHAR AS error FROM s
QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY round(mean, {R}) DESC, trial) = 1
UNION ALL SELECT 'broken', NULL, NULL, 'ValueError: a search needs two folds at least'""")
def search_fit_all(spark, d):
    """The same search on two datasets and on one that cannot be folded: the best
    trained candidate of each, or why there is none."""
    sets = _fit_sets(spark, d)
    sets["broken"] = lambda: sets["documents"]().where("fold = 0")
    found = _fit_discriminants(spark, d, sets, [*DOC_FEATURES, *LINEITEM_FEATURES])
    return finish(found.best.select("dataset", "trial", "best_score", F.lit(None).cast("string").alias("error")).unionByName(
        found.errors.select("dataset", "trial", F.lit(None).cast("double").alias("best_score"), "error")))


@register("search_trials_gbt")
def search_trials_gbt(spark, d):
    """Boosted trees by trials: 4 draws with replacement from a grid, 3 folds each,
    and the best candidate fitted again on all training rows."""
    grid = H.candidate_grid(spark, {"maxDepth": [2, 3, 4], "maxIter": [5, 10], "stepSize": [0.1, 0.3]})
    found = H.fit_search(
        {"documents": _fit_sets(spark, d)["documents"]}, reuse(H.random_candidates(grid, 4, seed=42, replacement=True)),
        lambda rows, params: MD.train_boosted_trees(rows, DOC_FEATURES, "label", params={
            k: float(v) if k == "stepSize" else int(v) for k, v in params.items()}),
        lambda model, rows: MD.predict_proba(model, rows), refit="roc_auc")
    trees = found.models["documents"].stages[-1].getNumTrees
    return finish(found.summary.withColumn("refit_trees", F.lit(trees).cast("long")))
