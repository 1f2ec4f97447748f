"""Registered explanation-quality queries (I1-I8) on the document explanations.

Explanation sets: ``shap`` = exact Shapley values on the probability scale,
``local`` = the closed-form linear attribution on the margin scale (a
second, different explainer of the same model).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as X
from ..operators import xquality as Q
from ..session import reuse
from .catalog import finish, register
from .fixtures import DOC_FEATURES, EXPLAIN_SCORER, doc_background, doc_explain_table
from .sql_explain import NAMES, base_ctes, shapley_cte
from .sqlparts import R, order_hash_expr

KEY = ["doc_id"]
SEEDS = (42, 43, 44)
SUBSET = 50


def _sets(spark, d):
    # The feature table and the Shapley table feed many aggregations: both
    # are checkpointed once instead of re-reading whole texts per metric.
    t = reuse(doc_explain_table(spark, d))
    bg = doc_background(t)
    phi = reuse(X.shapley_values(t, DOC_FEATURES, EXPLAIN_SCORER, bg, KEY))
    shap = phi.select(*KEY, "feature", F.col("phi").alias("value"))
    local = X.linear_shap(t, EXPLAIN_SCORER, bg, KEY).select(*KEY, "feature", F.col("phi").alias("value"))
    runs = reuse(Q.importance_runs(phi, KEY, SEEDS, SUBSET, rows=t))
    return t, shap, local, runs


def _ctes() -> str:
    mu = ", ".join(f"avg({f}) AS mu_{f}" for f in DOC_FEATURES)
    lx = " UNION ALL ".join(
        f"SELECT doc_id, '{f}' AS feature, {float(EXPLAIN_SCORER.coefs[f])!r} * ({f} - mu_{f}) AS value FROM t, mu"
        for f in DOC_FEATURES)
    subs = ",\n".join(
        f"s{k} AS (SELECT doc_id FROM t ORDER BY {order_hash_expr(['doc_id'], seed)}, doc_id LIMIT {SUBSET}),\n"
        f"r{k} AS (SELECT {k} AS run, feature, avg(abs(value)) AS importance FROM sx "
        f"WHERE doc_id IN (SELECT doc_id FROM s{k}) GROUP BY feature)"
        for k, seed in enumerate(SEEDS, start=1))
    unions = " UNION ALL ".join(f"SELECT * FROM r{k}" for k in range(len(SEEDS) + 1))
    return f"""{base_ctes()}, {shapley_cte()},
sx AS (SELECT phi.doc_id, nm.feature, phi.phi AS value FROM phi JOIN {NAMES} ON nm.i = phi.i),
mu AS (SELECT {mu} FROM bg),
lx AS ({lx}),
r0 AS (SELECT 0 AS run, feature, avg(abs(value)) AS importance FROM sx GROUP BY feature),
{subs},
runs AS ({unions}),
al AS (SELECT r.run, f.feature, coalesce(x.importance, 0.0) AS value
       FROM (SELECT DISTINCT run FROM runs) r
       CROSS JOIN (SELECT feature FROM runs WHERE run = (SELECT min(run) FROM runs)) f
       LEFT JOIN runs x ON x.run = r.run AND x.feature = f.feature),
rk AS (SELECT run, feature, rank() OVER (PARTITION BY run ORDER BY value)
              + (count(*) OVER (PARTITION BY run, value) - 1) / 2.0 AS value FROM al)"""


@register("quality_importance_runs", f"""WITH {_ctes()}
SELECT CAST(run AS BIGINT) AS run, feature, round(importance, {R}) AS importance FROM runs""")
def quality_importance_runs(spark, d):
    return finish(_sets(spark, d)[3])


def _pair_corr(src: str, method: str) -> str:
    if method == "kendall":
        return f"""(SELECT a.run AS ra, b.run AS rb,
            sum(sign(a.value - a2.value) * sign(b.value - b2.value))
            / sqrt(sum(sign(a.value - a2.value) * sign(a.value - a2.value))
                   * sum(sign(b.value - b2.value) * sign(b.value - b2.value))) AS c
          FROM {src} a JOIN {src} b ON a.feature = b.feature AND a.run < b.run
          JOIN {src} a2 ON a2.run = a.run AND a2.feature > a.feature
          JOIN {src} b2 ON b2.run = b.run AND b2.feature = a2.feature
          GROUP BY a.run, b.run)"""
    return f"""(SELECT a.run AS ra, b.run AS rb, corr(a.value, b.value) AS c
          FROM {src} a JOIN {src} b ON a.feature = b.feature AND a.run < b.run GROUP BY a.run, b.run)"""


@register("quality_stability", f"""WITH {_ctes()}
""" + "\nUNION ALL\n".join(
    f"""SELECT '{m}' AS method, round(avg(c), {R}) AS value, count(*) AS n_pairs,
       CAST(sum(CASE WHEN c IS NULL OR isnan(c) THEN 1 ELSE 0 END) AS BIGINT) AS n_undefined
FROM {_pair_corr('rk' if m == 'spearman' else 'al', m)}""" for m in ("spearman", "kendall", "pearson")))
def quality_stability(spark, d):
    runs = _sets(spark, d)[3]
    out = None
    for m in ("spearman", "kendall", "pearson"):
        part = Q.importance_stability(runs, m)
        out = part if out is None else out.unionByName(part)
    return finish(out)


_J = """(SELECT coalesce(s.doc_id, l.doc_id) AS doc_id, coalesce(s.value, 0.0) AS a, coalesce(l.value, 0.0) AS b
         FROM sx s FULL OUTER JOIN lx l ON s.doc_id = l.doc_id AND s.feature = l.feature)"""


@register("quality_consistency", f"""WITH {_ctes()},
j AS {_J},
cs AS (SELECT doc_id, sum(a * b) AS dot, sum(a * a) AS na, sum(b * b) AS nb,
              sqrt(sum((a - b) * (a - b))) AS de, sum(abs(a - b)) AS dm FROM j GROUP BY doc_id)
SELECT 'cosine' AS metric, round(greatest(0.0, avg(CASE WHEN na > 0 AND nb > 0 THEN dot / (sqrt(na) * sqrt(nb))
       ELSE 0.0 END)), {R}) AS consistency FROM cs
UNION ALL SELECT 'euclidean', round(greatest(0.0, 1.0 - avg(de) / (max(de) + 1e-10)), {R}) FROM cs
UNION ALL SELECT 'manhattan', round(greatest(0.0, 1.0 - avg(dm) / (max(dm) + 1e-10)), {R}) FROM cs""")
def quality_consistency(spark, d):
    _, shap, local, _ = _sets(spark, d)
    out = None
    for m in ("cosine", "euclidean", "manhattan"):
        part = Q.explanation_consistency(shap, local, KEY, m)
        out = part if out is None else out.unionByName(part)
    return finish(out)


FID_K = 2


def _fid_sql(src: str) -> str:
    masked = {f: f"CASE WHEN list_contains(tp.top, '{f}') THEN 0.0 ELSE t.{f} END" for f in DOC_FEATURES}
    p0 = EXPLAIN_SCORER.proba_sql({f: f"t.{f}" for f in DOC_FEATURES})
    p1 = EXPLAIN_SCORER.proba_sql(masked)
    return f"""(SELECT avg(abs({p0} - {p1})) AS fidelity FROM t JOIN (
      SELECT doc_id, list(feature) AS top FROM (SELECT doc_id, feature, row_number() OVER
        (PARTITION BY doc_id ORDER BY abs(value) DESC, feature) AS r FROM {src}) WHERE r <= {FID_K}
      GROUP BY doc_id) tp ON tp.doc_id = t.doc_id)"""


@register("quality_fidelity", f"""WITH {_ctes()}
SELECT 'shap' AS explainer, round(fidelity, {R}) AS fidelity FROM {_fid_sql('sx')}
UNION ALL SELECT 'local', round(fidelity, {R}) FROM {_fid_sql('lx')}""")
def quality_fidelity(spark, d):
    t, shap, local, _ = _sets(spark, d)
    a = Q.explanation_fidelity(t, shap, KEY, DOC_FEATURES, EXPLAIN_SCORER, FID_K).select(
        F.lit("shap").alias("explainer"), "fidelity")
    b = Q.explanation_fidelity(t, local, KEY, DOC_FEATURES, EXPLAIN_SCORER, FID_K).select(
        F.lit("local").alias("explainer"), "fidelity")
    return finish(a.unionByName(b))


def _agree_sql(k: int) -> str:
    top = "(SELECT feature FROM runs WHERE run = {r} ORDER BY importance DESC, feature LIMIT " + str(k) + ")"
    return f"""SELECT CAST({k} AS BIGINT) AS top_k, round(CAST(count(*) FILTER (WHERE x.feature IS NOT NULL AND y.feature IS NOT NULL)
       AS DOUBLE) / count(*), {R}) AS agreement
FROM {top.format(r=0)} x FULL OUTER JOIN {top.format(r=1)} y ON x.feature = y.feature"""


@register("quality_agreement", f"""WITH {_ctes()}
{_agree_sql(2)}
UNION ALL {_agree_sql(3)}""")
def quality_agreement(spark, d):
    runs = _sets(spark, d)[3]
    r0, r1 = runs.where(F.col("run") == 0), runs.where(F.col("run") == 1)
    out = None
    for k in (2, 3):
        part = Q.feature_agreement(r0, r1, k).select(F.lit(k).cast("long").alias("top_k"), "agreement")
        out = part if out is None else out.unionByName(part)
    return finish(out)


@register("quality_complexity", f"""WITH {_ctes()}
SELECT 'shap' AS explainer, round(avg(n), {R}) AS complexity FROM
  (SELECT doc_id, sum(CASE WHEN abs(value) > 0.01 THEN 1 ELSE 0 END) AS n FROM sx GROUP BY doc_id)
UNION ALL SELECT 'local', round(avg(n), {R}) FROM
  (SELECT doc_id, sum(CASE WHEN abs(value) > 0.01 THEN 1 ELSE 0 END) AS n FROM lx GROUP BY doc_id)""")
def quality_complexity(spark, d):
    _, shap, local, _ = _sets(spark, d)
    a = Q.explanation_complexity(shap, KEY).select(F.lit("shap").alias("explainer"), "complexity")
    b = Q.explanation_complexity(local, KEY).select(F.lit("local").alias("explainer"), "complexity")
    return finish(a.unionByName(b))


@register("quality_compare_importances", f"""WITH {_ctes()},
ia AS (SELECT feature, avg(abs(value)) AS a FROM sx GROUP BY feature),
ib AS (SELECT feature, avg(abs(value)) AS b FROM lx GROUP BY feature),
j AS (SELECT coalesce(ia.feature, ib.feature) AS feature, coalesce(a, 0.0) AS a, coalesce(b, 0.0) AS b
      FROM ia FULL OUTER JOIN ib ON ia.feature = ib.feature)
SELECT feature, round(a, {R}) AS importance_a, round(b, {R}) AS importance_b,
       round(CASE WHEN max(a) OVER () <> 0 THEN a / max(a) OVER () ELSE 0.0 END, {R}) AS normalized_a,
       round(CASE WHEN max(b) OVER () <> 0 THEN b / max(b) OVER () ELSE 0.0 END, {R}) AS normalized_b
FROM j""")
def quality_compare_importances(spark, d):
    _, shap, local, _ = _sets(spark, d)
    ia = X.shap_importance(shap, value="value")
    ib = X.shap_importance(local, value="value")
    return finish(Q.compare_importances(ia, ib))


@register("quality_all_metrics")
def quality_all_metrics(spark, d):
    """Long (metric, value) of every explanation-quality metric; each part
    has its own oracle above, so this composition is checked by rows."""
    t, shap, local, runs = _sets(spark, d)
    return finish(Q.all_interpretability_metrics(runs, shap, local, t, KEY, DOC_FEATURES, EXPLAIN_SCORER))
