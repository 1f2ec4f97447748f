"""Registered evaluation queries (A1-A19, flagship) over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.hashing import order_hash_sql
from ..functions.scorers import SoftmaxScorer
from ..operators import metrics as M
from ..operators.split import repeated_splits, stratified_kfold
from ..sources.tables import read_table
from .catalog import finish, register
from .fixtures import (LINEITEM_ALT_SCORERS, LINEITEM_FEATURES, LINEITEM_KEY, LINEITEM_SCORER,
                       LINEITEM_TIES,
                       document_features, document_features_sql, scored_lineitem,
                       scored_lineitem_sql)
from .sqlparts import (R, curve_ctes, curve_metrics_select, evaluate_long_sql,
                       label_metrics_select)

SL = scored_lineitem_sql()

# ----------------------------------------------------------------- flagship
FLAGSHIP_SQL = evaluate_long_sql(document_features_sql(), ["split"])


@register("flagship_document_eval", FLAGSHIP_SQL)
def flagship_document_eval(spark, d):
    """documents + labels -> text features -> encode -> hash split -> scale
    (train stats) -> fixed scorer -> all metrics per split."""
    feats = document_features(spark, d)
    return finish(M.evaluate_by(feats, ["split"], pred="pred", extra=["f1_max", "precision_at_recall"]))


# ----------------------------------------------------------------- A1 / A10
@register("eval_label_metrics", f"""
SELECT split, tp, fp, fn, tn, round(accuracy, {R}) AS accuracy, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall, round(f1, {R}) AS f1
FROM ({label_metrics_select(SL, ['split'])})""")
def eval_label_metrics(spark, d):
    return finish(M.label_metrics(scored_lineitem(spark, d), groups=["split"]))


# ----------------------------------------------------------------- A3 / A4
@register("eval_curve_metrics", f"""
WITH {curve_ctes(SL, ['split'])}
SELECT split, round(roc_auc, {R}) AS roc_auc, round(pr_auc, {R}) AS pr_auc
FROM ({curve_metrics_select(['split'])})""")
def eval_curve_metrics(spark, d):
    curve = M.binary_curve(scored_lineitem(spark, d), groups=["split"])
    return finish(M.curve_metrics(curve, ["split"]))


# ----------------------------------------------------------------- A5
@register("eval_brier", f"""
SELECT split, round(avg(power(p - label, 2)), {R}) AS brier_score FROM {SL} GROUP BY split""")
def eval_brier(spark, d):
    return finish(M.brier_score(scored_lineitem(spark, d), groups=["split"]))


# ----------------------------------------------------------------- A12
@register("eval_by_split", evaluate_long_sql(SL, ["split"]))
def eval_by_split(spark, d):
    return finish(M.evaluate_by(scored_lineitem(spark, d), ["split"], pred="pred",
                                extra=["f1_max", "precision_at_recall"]))


# ----------------------------------------------------------------- A7
@register("eval_pr_curve", f"""
WITH {curve_ctes(SL, ['split'])}
SELECT split, round(threshold, {R}) AS threshold, round(precision, {R}) AS precision,
       round(recall, {R}) AS recall FROM curve
UNION ALL
SELECT DISTINCT split, CAST(NULL AS DOUBLE), 1.0, 0.0 FROM curve""")
def eval_pr_curve(spark, d):
    return finish(M.pr_curve(scored_lineitem(spark, d), groups=["split"]))


# ----------------------------------------------------------------- A8 / A9
@register("eval_threshold_rules", f"""
WITH {curve_ctes(SL, ['split'])}
SELECT split,
  round(coalesce(arg_max(precision, threshold) FILTER (WHERE recall >= 0.8), 0.0), {R}) AS precision_at_recall,
  round(coalesce(arg_min(precision, threshold) FILTER (WHERE recall >= 0.8), 0.0), {R}) AS precision_at_recall_compat,
  round(greatest(max(2 * precision * recall / (precision + recall + 1e-12)), 0.0), {R}) AS f1_max
FROM curve GROUP BY split""")
def eval_threshold_rules(spark, d):
    curve = M.binary_curve(scored_lineitem(spark, d), groups=["split"])
    fixed = M.precision_at_recall_from_curve(curve, 0.8, ["split"])
    compat = M.precision_at_recall_from_curve(curve, 0.8, ["split"], compat=True).withColumnRenamed(
        "precision_at_recall", "precision_at_recall_compat")
    f1 = 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall") + F.lit(M.F1_EPS))
    f1m = curve.groupBy("split").agg(F.greatest(F.max(f1), F.lit(0.0)).alias("f1_max"))
    return finish(fixed.join(compat, "split").join(f1m, "split"))


# ----------------------------------------------------------------- A2 / A6 multiclass
CLASSES = ["A", "N", "R"]
SOFTMAX = SoftmaxScorer(
    classes=CLASSES,
    coefs={"l_quantity": [0.02, -0.01, 0.0], "l_discount": [-3.0, 2.0, 1.0], "l_tax": [2.0, 0.0, -4.0]},
    intercepts=[0.1, 0.0, -0.1])


def _multiclass(spark, d):
    li = read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", *LINEITEM_FEATURES)
    code = F.create_map(*[x for i, c in enumerate(CLASSES) for x in (F.lit(c), F.lit(i))])
    probs = li.select("l_linestatus", F.element_at(code, F.col("l_returnflag")).alias("label"),
                      SOFTMAX.proba_array().alias("proba"))
    best = F.array_position(F.col("proba"), F.array_max("proba")) - 1
    return probs.withColumn("pred", best.cast("int"))


def _multiclass_sql() -> str:
    ps = SOFTMAX.proba_sql()
    label = "CASE l_returnflag " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES)) + " END"
    return f"""(SELECT l_linestatus, CAST({label} AS BIGINT) AS label, [{', '.join(ps)}] AS proba FROM lineitem)"""


MC = _multiclass_sql()


@register("eval_weighted_multiclass", f"""
WITH s AS (SELECT l_linestatus, label, list_position(proba, list_max(proba)) - 1 AS pred FROM {MC}),
conf AS (SELECT l_linestatus, label, pred, count(*) AS n FROM s GROUP BY ALL),
bt AS (SELECT l_linestatus, label AS cls, sum(n) AS support, sum(CASE WHEN label = pred THEN n ELSE 0 END) AS tp
       FROM conf GROUP BY ALL),
bp AS (SELECT l_linestatus, pred AS cls, sum(n) AS predicted FROM conf GROUP BY ALL),
per AS (SELECT coalesce(bt.l_linestatus, bp.l_linestatus) AS l_linestatus,
               CAST(coalesce(support, 0) AS DOUBLE) AS support, CAST(coalesce(tp, 0) AS DOUBLE) AS tp,
               CAST(coalesce(predicted, 0) AS DOUBLE) AS predicted
        FROM bt FULL OUTER JOIN bp ON bt.l_linestatus = bp.l_linestatus AND bt.cls = bp.cls)
SELECT l_linestatus,
  round(sum(tp) / sum(support), {R}) AS accuracy,
  round(sum(CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END * support) / sum(support), {R}) AS precision_weighted,
  round(sum(CASE WHEN support > 0 THEN tp / support ELSE 0 END * support) / sum(support), {R}) AS recall_weighted,
  round(sum(CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END * support)
        / sum(support), {R}) AS f1_weighted
FROM per GROUP BY l_linestatus""")
def eval_weighted_multiclass(spark, d):
    return finish(M.weighted_label_metrics(_multiclass(spark, d), "label", "pred", ["l_linestatus"]))


@register("eval_ovr_auc", f"""
WITH ex AS (SELECT l_linestatus, c.cls, CAST(label = c.cls AS INTEGER) AS y_cls, proba[c.cls + 1] AS p_cls
            FROM {MC}, (SELECT range AS cls FROM range(3)) c),
{curve_ctes('ex', ['l_linestatus', 'cls'], 'y_cls', 'p_cls')},
per AS ({curve_metrics_select(['l_linestatus', 'cls'])}),
prev AS (SELECT l_linestatus, cls, sum(y_cls) AS support FROM ex GROUP BY ALL)
SELECT per.l_linestatus, round(sum(roc_auc * support) / sum(support), {R}) AS roc_auc_ovr_weighted
FROM per JOIN prev ON per.l_linestatus = prev.l_linestatus AND per.cls = prev.cls
GROUP BY per.l_linestatus""")
def eval_ovr_auc(spark, d):
    return finish(M.roc_auc_ovr_weighted(_multiclass(spark, d), "label", "proba", 3, ["l_linestatus"]))


# ----------------------------------------------------------------- A13 folds
LI_ORDER = ", ".join([*LINEITEM_KEY, *LINEITEM_TIES])
FOLD_SQL = f"""(SELECT *, CAST((row_number() OVER (PARTITION BY label ORDER BY
      {order_hash_sql(LINEITEM_KEY, 42)}, {LI_ORDER}) - 1) % 5 AS INTEGER) AS fold FROM {SL})"""


@register("eval_aggregate_folds", f"""
WITH per AS ({evaluate_long_sql(FOLD_SQL, ['fold'], extra=False)})
SELECT metric, round(avg(value), {R}) AS mean, round(stddev_pop(value), {R}) AS std,
       round(min(value), {R}) AS min, round(max(value), {R}) AS max, count(value) AS n
FROM per GROUP BY metric""")
def eval_aggregate_folds(spark, d):
    folded = stratified_kfold(scored_lineitem(spark, d), "label", LINEITEM_KEY, k=5, seed=42,
                              tie_cols=LINEITEM_TIES)
    per = M.evaluate_by(folded, ["fold"], pred="pred")
    per = per.withColumn("value", F.round("value", R))  # fold metrics as reported
    return finish(M.aggregate_folds(per))


# ----------------------------------------------------------------- A14 runs
N_RUNS = 5
RUNS_SQL = f"""(WITH base AS (SELECT s.*, r.range AS run FROM {SL} s, range({N_RUNS}) r),
  cnt AS (SELECT run, label, count(*) AS n_class FROM base GROUP BY ALL),
  a AS (SELECT *, sum(n_class) OVER (PARTITION BY run) AS n,
               ceil(CAST(0.2 AS DOUBLE) * sum(n_class) OVER (PARTITION BY run)) AS n_test FROM cnt),
  b AS (SELECT *, floor(n_class * n_test / n) AS fl, n_class * n_test / n - floor(n_class * n_test / n) AS rem FROM a),
  c AS (SELECT *, n_test - sum(fl) OVER (PARTITION BY run) AS need,
               row_number() OVER (PARTITION BY run ORDER BY rem DESC, label) AS pos FROM b),
  alloc AS (SELECT run, label, fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS n_test_class FROM c),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY run, label ORDER BY
      ('0x' || substr(md5('42:' || CAST(run AS VARCHAR) || '|' || CAST(row_id AS VARCHAR) || '|'
                          || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)), 1, 15))::BIGINT,
      {LI_ORDER}) AS rk FROM base)
  SELECT ranked.* FROM ranked JOIN alloc USING (run, label) WHERE rk <= n_test_class)"""


@register("eval_aggregate_runs", f"""
WITH per AS ({evaluate_long_sql(RUNS_SQL, ['run'], extra=False)})
SELECT metric, round(avg(value), {R}) AS mean, round(stddev_pop(value), {R}) AS std,
       list(value ORDER BY run) AS runs
FROM per GROUP BY metric""")
def eval_aggregate_runs(spark, d):
    base = scored_lineitem(spark, d).drop("split")
    runs = repeated_splits(base, "label", LINEITEM_KEY, n_runs=N_RUNS, test_size=0.2, seed=42,
                           tie_cols=LINEITEM_TIES)
    per = M.evaluate_by(runs.where(F.col("split") == "test"), ["run"], pred="pred")
    per = per.withColumn("value", F.round("value", R))
    return finish(M.aggregate_runs(per, "run"))


# ----------------------------------------------------------------- A17
TEACHER = LINEITEM_ALT_SCORERS[1]


@register("eval_kd_loss", f"""
WITH s AS (SELECT split, label, {TEACHER.proba_sql()} AS pt, {LINEITEM_SCORER.margin_sql()} AS zs
           FROM {scored_lineitem_sql(keep_features=True)}),
l AS (SELECT split, label, ln(1 - pt + 1e-10) / 2.0 AS t0, ln(pt + 1e-10) / 2.0 AS t1, 0.0 AS s0, zs / 2.0 AS s1,
             zs AS z FROM s),
m AS (SELECT *, greatest(t0, t1) + ln(exp(t0 - greatest(t0, t1)) + exp(t1 - greatest(t0, t1))) AS lt,
             greatest(s0, s1) + ln(exp(s0 - greatest(s0, s1)) + exp(s1 - greatest(s0, s1))) AS ls,
             greatest(0.0, z) + ln(exp(0.0 - greatest(0.0, z)) + exp(z - greatest(0.0, z))) AS lc FROM l),
k AS (SELECT split,
        exp(t0 - lt) * ((t0 - lt) - (s0 - ls)) + exp(t1 - lt) * ((t1 - lt) - (s1 - ls)) AS kl,
        -(CASE WHEN label = 1 THEN z ELSE 0.0 END - lc) AS ce FROM m)
SELECT split, round(0.7 * 4.0 * avg(kl) + 0.3 * avg(ce), {R}) AS kd_loss, round(avg(kl), {R}) AS kl,
       round(avg(ce), {R}) AS ce FROM k GROUP BY split""")
def eval_kd_loss(spark, d):
    from ..operators.prep import teacher_logits
    s = scored_lineitem(spark, d, keep_features=True)
    pt = TEACHER.proba()
    s = s.select("split", "label",
                 teacher_logits(F.array(F.lit(1.0) - pt, pt)).alias("t"),
                 F.array(F.lit(0.0), LINEITEM_SCORER.margin()).alias("s"))
    return finish(M.kd_loss(s, "t", "s", "label", alpha=0.7, temperature=2.0, groups=["split"]))


# ----------------------------------------------------------------- A18 / A19
MODEL_METRICS = M.DEFAULT_METRICS


def _models_long(spark, d):
    """Every model scores the same test rows: one scan, scores exploded as
    (model, p), one evaluation grouped by model."""
    li = scored_lineitem(spark, d, keep_features=True).where(F.col("split") == "test")
    scores = F.array(*[F.struct(F.lit(sc.name).alias("model"), sc.proba().alias("p"))
                       for sc in LINEITEM_ALT_SCORERS])
    ex = li.select("label", F.inline_outer(scores)).withColumn("pred", M.threshold_labels("p"))
    long = M.evaluate_by(ex, ["model"], pred="pred")
    return long.select("model", "metric", F.round("value", R).alias("value"))


def _models_long_sql() -> str:
    parts = []
    for sc in LINEITEM_ALT_SCORERS:
        src = f"(SELECT * FROM {scored_lineitem_sql(sc)} WHERE split = 'test')"
        parts.append(f"SELECT '{sc.name}' AS model, metric, value FROM ({evaluate_long_sql(src, [], extra=False)})")
    return "\nUNION ALL\n".join(parts)


@register("eval_model_comparison", f"""
WITH lg AS ({_models_long_sql()})
SELECT model, {', '.join(f"max(value) FILTER (WHERE metric = '{m}') AS {m}" for m in MODEL_METRICS)}
FROM lg GROUP BY model""")
def eval_model_comparison(spark, d):
    return finish(M.model_comparison(_models_long(spark, d), MODEL_METRICS))


@register("eval_improvement", f"""
WITH lg AS ({_models_long_sql()})
SELECT b.metric, b.value AS baseline, c.value AS candidate,
       round(100.0 * (c.value - b.value), {R}) AS improvement
FROM lg b JOIN lg c ON b.metric = c.metric WHERE b.model = 'base' AND c.model = 'wide'""")
def eval_improvement(spark, d):
    lg = _models_long(spark, d)
    return finish(M.improvement(lg, "base", "wide"))


# ----------------------------------------------------------------- A15 / A16 (property checks)
@register("eval_calibrated_metrics")
def eval_calibrated_metrics(spark, d):
    """Isotonic fit on a hash holdout of the train split, applied to test;
    metrics before and after calibration (key column ``calibrated``)."""
    from ..operators.split import random_holdout
    s = scored_lineitem(spark, d)
    train = random_holdout(s.where(F.col("split") == "train"), LINEITEM_KEY, 0.2, seed=42,
                           tie_cols=LINEITEM_TIES)
    test = s.where(F.col("split") == "test")
    return finish(M.calibrated_metrics(train.where("holdout"), test))


@register("eval_isotonic", f"""WITH h AS (
  SELECT floor(p * 100) / 100 AS score, sum(label)::DOUBLE AS y, count(*)::DOUBLE AS n FROM {scored_lineitem_sql()} GROUP BY 1),
c AS (SELECT row_number() OVER (ORDER BY score) AS i, score, sum(y) OVER (ORDER BY score) AS cy, sum(n) OVER (ORDER BY score) AS cn,
             y, n FROM h),
span AS (SELECT a.i AS a, b.i AS b, (b.cy - a.cy + a.y) / (b.cn - a.cn + a.n) AS mean FROM c a JOIN c b ON a.i <= b.i),
low AS (SELECT c.i, c.score, s.a, min(s.mean) AS least FROM c JOIN span s ON s.a <= c.i AND s.b >= c.i GROUP BY ALL)
SELECT score, round(max(least), {R}) AS calibrated FROM low GROUP BY score""")
def eval_isotonic(spark, d):
    """Isotonic calibration of every lineitem score (cut to 2 decimals): the
    calibrated value of each score."""
    s = scored_lineitem(spark, d).withColumn("p", F.floor(F.col("p") * 100) / 100)
    scores = s.select(F.col("p").alias("score")).distinct()
    return finish(M.apply_isotonic(M.fit_isotonic(s, "label", "p"), scores, "score", "calibrated"))
