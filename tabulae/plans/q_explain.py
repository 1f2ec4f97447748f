"""Registered explanation and interaction queries (X, N, F12)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.scorers import LinearScorer, SoftmaxScorer
from ..operators import attribution as X
from ..operators.prep import hash_sample
from ..session import reuse
from ..sources.tables import read_table
from .catalog import finish, register
from .fixtures import DOC_FEATURES, EXPLAIN_SCORER, doc_background, doc_explain_sql, doc_explain_table
from .sql_explain import D, NAMES, base_ctes, pair_cte, shapley_cte
from .sqlparts import R

KEY = ["doc_id"]


def _phi(spark, d, method="exact"):
    t = doc_explain_table(spark, d)
    return X.shapley_values(t, DOC_FEATURES, EXPLAIN_SCORER, doc_background(t), KEY, method=method)


def _x_long(spark, d):
    t = doc_explain_table(spark, d)
    return t.unpivot(KEY, DOC_FEATURES, "feature", "value")


SHAP_SQL = f"""WITH {base_ctes()}, {shapley_cte()}
SELECT phi.doc_id, nm.feature, round(phi.phi, {R}) AS phi, round(v0.v, {R}) AS base, round(v1.v, {R}) AS fx
FROM phi JOIN {NAMES} ON nm.i = phi.i
JOIN v v0 ON v0.doc_id = phi.doc_id AND v0.mask = 0
JOIN v v1 ON v1.doc_id = phi.doc_id AND v1.mask = {(1 << D) - 1}"""


@register("explain_shapley_exact", SHAP_SQL)
def explain_shapley_exact(spark, d):
    """Exact Shapley values of every document (all coalitions, 50 background rows)."""
    return finish(_phi(spark, d, "exact"))


@register("explain_shapley_permutation", SHAP_SQL)
def explain_shapley_permutation(spark, d):
    """All feature orders: equals exact Shapley, checked against the same oracle."""
    return finish(_phi(spark, d, "permutation"))


CLASS_SCORER = SoftmaxScorer(["low", "mid", "high"], {f: [0.4 - 0.3 * i, 0.2 * i - 0.1, 0.5 * (-1) ** i]
                                                     for i, f in enumerate(DOC_FEATURES)}, [0.2, 0.0, -0.3], decimals=None)


def _class_sql() -> str:
    """Every class's coalition values by enumeration, and the Shapley sum over them."""
    masked = {f: f"CASE WHEN (m.mask >> {i}) & 1 = 1 THEN t.{f} ELSE bg.{f} END" for i, f in enumerate(DOC_FEATURES)}
    values = " UNION ALL ".join(f"SELECT t.doc_id, m.mask, '{c}' AS class, avg({p}) AS v FROM t, m, bg GROUP BY t.doc_id, m.mask"
                                for c, p in zip(CLASS_SCORER.classes, CLASS_SCORER.proba_sql(masked), strict=True))
    whole = (1 << D) - 1
    tables = base_ctes().rsplit("\nv AS", 1)[0]
    size = "bit_count(a.mask)"
    weight = f"CAST(factorial({size}) AS DOUBLE) * CAST(factorial({D - 1} - {size}) AS DOUBLE) / CAST(factorial({D}) AS DOUBLE)"
    return f"""WITH {tables}
v AS ({values})
SELECT a.doc_id, a.class, nm.feature, round(sum({weight} * (b.v - a.v)), {R}) AS phi,
  round(max(CASE WHEN a.mask = 0 THEN a.v END), {R}) AS base, round(max(CASE WHEN b.mask = {whole} THEN b.v END), {R}) AS fx
FROM {NAMES} JOIN v a ON (a.mask >> nm.i) & 1 = 0
JOIN v b ON b.doc_id = a.doc_id AND b.class = a.class AND b.mask = a.mask | (1 << nm.i)
GROUP BY a.doc_id, a.class, nm.feature"""


@register("explain_class_shapley", _class_sql())
def explain_class_shapley(spark, d):
    """Exact Shapley values of three classes' probabilities, from one scoring."""
    t = doc_explain_table(spark, d)
    return finish(X.class_shapley_values(t, DOC_FEATURES, CLASS_SCORER, doc_background(t), KEY))


@register("explain_kernel_shap", SHAP_SQL)
def explain_kernel_shap(spark, d):
    """Constrained kernel least squares on all coalitions: exact Shapley."""
    return finish(_phi(spark, d, "kernel"))


_LIN_MEANS = ", ".join(f"avg({f}) AS mu_{f}" for f in DOC_FEATURES)
_LIN_ROWS = "\nUNION ALL\n".join(
    f"SELECT doc_id, '{f}' AS feature, round({float(EXPLAIN_SCORER.coefs[f])!r} * ({f} - mu_{f}), {R}) AS phi "
    f"FROM t, mu" for f in DOC_FEATURES)


@register("explain_linear_shap", f"""WITH {base_ctes()}, mu AS (SELECT {_LIN_MEANS} FROM bg)
{_LIN_ROWS}""")
def explain_linear_shap(spark, d):
    t = doc_explain_table(spark, d)
    return finish(X.linear_shap(t, EXPLAIN_SCORER, doc_background(t), KEY))


IMP_SQL = f"""WITH {base_ctes()}, {shapley_cte()},
imp AS (SELECT nm.feature, avg(abs(phi.phi)) AS importance FROM phi JOIN {NAMES} ON nm.i = phi.i GROUP BY nm.feature)"""


@register("explain_shap_importance", f"""{IMP_SQL}
SELECT feature, round(importance, {R}) AS importance,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp""")
def explain_shap_importance(spark, d):
    return finish(X.shap_importance(_phi(spark, d)))


BARS_K = 3


@register("explain_importance_bars", f"""{IMP_SQL}
SELECT * FROM (SELECT feature, round(importance, {R}) AS importance,
       row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp) WHERE rank <= {BARS_K}""")
def explain_importance_bars(spark, d):
    return finish(X.importance_bars(X.shap_importance(_phi(spark, d)), BARS_K))


@register("explain_maps", f"""WITH {base_ctes()}, {shapley_cte()}
SELECT phi.doc_id, map_from_entries(list(struct_pack(k := nm.feature, v := round(phi.phi, {R}))
       ORDER BY nm.feature)) AS explanation
FROM phi JOIN {NAMES} ON nm.i = phi.i GROUP BY phi.doc_id""")
def explain_maps(spark, d):
    phi = _phi(spark, d).withColumn("phi", F.round("phi", R))
    return finish(X.explanation_maps(phi, KEY))


_T_LONG = "\nUNION ALL\n".join(f"SELECT doc_id, '{f}' AS feature, {f} AS value FROM t" for f in DOC_FEATURES)


@register("explain_summary_points", f"""{IMP_SQL},
rk AS (SELECT feature, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM imp),
xl AS ({_T_LONG})
SELECT phi.doc_id, nm.feature, round(xl.value, {R}) AS value, round(phi.phi, {R}) AS phi, rk.rank
FROM phi JOIN {NAMES} ON nm.i = phi.i JOIN xl ON xl.doc_id = phi.doc_id AND xl.feature = nm.feature
JOIN rk ON rk.feature = nm.feature""")
def explain_summary_points(spark, d):
    phi = _phi(spark, d)
    return finish(X.summary_points(phi, _x_long(spark, d), X.shap_importance(phi), KEY))


DEP_FEATURE = "n_words"


@register("explain_dependence", f"""WITH {base_ctes()}, {shapley_cte()},
xl AS ({_T_LONG}),
base AS (SELECT phi.doc_id, xl.value, phi.phi FROM phi JOIN {NAMES} ON nm.i = phi.i
         JOIN xl ON xl.doc_id = phi.doc_id AND xl.feature = nm.feature WHERE nm.feature = '{DEP_FEATURE}'),
oth AS (SELECT doc_id, feature AS color_feature, value AS color_value FROM xl WHERE feature <> '{DEP_FEATURE}'),
j AS (SELECT base.*, oth.color_feature, oth.color_value FROM base JOIN oth USING (doc_id)),
best AS (SELECT color_feature FROM j GROUP BY color_feature
         ORDER BY abs(corr(phi, color_value)) DESC NULLS LAST, color_feature LIMIT 1)
SELECT doc_id, round(value, {R}) AS value, round(phi, {R}) AS phi, color_feature, round(color_value, {R}) AS color_value
FROM j WHERE color_feature IN (SELECT color_feature FROM best)""")
def explain_dependence(spark, d):
    return finish(X.dependence_points(_phi(spark, d), _x_long(spark, d), DEP_FEATURE, KEY))


WATERFALL_MAX = 3


@register("explain_waterfall", f"""WITH {base_ctes()}, {shapley_cte()},
r AS (SELECT phi.doc_id, nm.feature, phi.phi, v0.v AS base,
        row_number() OVER (PARTITION BY phi.doc_id ORDER BY abs(phi.phi) DESC, nm.feature) AS pos
      FROM phi JOIN {NAMES} ON nm.i = phi.i JOIN v v0 ON v0.doc_id = phi.doc_id AND v0.mask = 0),
g AS (SELECT doc_id, CASE WHEN pos <= {WATERFALL_MAX - 1} THEN feature ELSE 'other' END AS feature,
        least(pos, {WATERFALL_MAX}) AS position, sum(phi) AS phi, any_value(base) AS base
      FROM r GROUP BY ALL),
c AS (SELECT *, base + sum(phi) OVER (PARTITION BY doc_id ORDER BY position
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM g)
SELECT doc_id, position, feature, round(phi, {R}) AS phi, round(e - phi, {R}) AS start, round(e, {R}) AS "end"
FROM c""")
def explain_waterfall(spark, d):
    return finish(X.waterfall(_phi(spark, d), KEY, WATERFALL_MAX))


@register("explain_base_value", f"""WITH {base_ctes()}
SELECT round(avg({EXPLAIN_SCORER.proba_sql()}), {R}) AS base_value FROM bg""")
def explain_base_value(spark, d):
    t = doc_explain_table(spark, d)
    bg = doc_background(t).withColumn("p", EXPLAIN_SCORER.proba())
    return finish(X.base_value(bg, "p"))


TOP_K_FEATURES = 2


@register("prep_select_top_features", f"""{IMP_SQL},
top AS (SELECT feature FROM imp ORDER BY importance DESC, feature LIMIT {TOP_K_FEATURES}),
xl AS ({_T_LONG})
SELECT doc_id, feature, round(value, {R}) AS value FROM xl WHERE feature IN (SELECT feature FROM top)""")
def prep_select_top_features(spark, d):
    from ..operators.prep import select_top_features
    top = select_top_features(X.shap_importance(_phi(spark, d)), TOP_K_FEATURES)
    t = doc_explain_table(spark, d).select(*KEY, *top)
    return finish(t.unpivot(KEY, top, "feature", "value"))


# ------------------------------------------------------------------ interactions
def _inter(spark, d, index):
    t = doc_explain_table(spark, d)
    return X.interaction_values(t, DOC_FEATURES, EXPLAIN_SCORER, doc_background(t), KEY, index)


def _ksii_sql_ctes() -> str:
    return f"""{base_ctes()}, {shapley_cte()}, {pair_cte('SII')},
half AS (SELECT doc_id, i, sum(value) AS s FROM (
           SELECT doc_id, i, value FROM pairs UNION ALL SELECT doc_id, j AS i, value FROM pairs) GROUP BY doc_id, i),
inter AS (
  SELECT phi.doc_id, n1.feature AS feature_i, CAST(NULL AS VARCHAR) AS feature_j, CAST(1 AS BIGINT) AS "order",
         phi.phi - 0.5 * half.s AS value
  FROM phi JOIN half ON half.doc_id = phi.doc_id AND half.i = phi.i
  JOIN {NAMES.replace('nm(', 'n1(')} ON n1.i = phi.i
  UNION ALL
  SELECT pairs.doc_id, n1.feature, n2.feature, CAST(2 AS BIGINT), pairs.value
  FROM pairs JOIN {NAMES.replace('nm(', 'n1(')} ON n1.i = pairs.i JOIN {NAMES.replace('nm(', 'n2(')} ON n2.i = pairs.j)"""


_INTER_SELECT = f"""SELECT doc_id, feature_i, feature_j, "order", round(value, {R}) AS value FROM inter"""


@register("interact_ksii", f"WITH {_ksii_sql_ctes()}\n{_INTER_SELECT}")
def interact_ksii(spark, d):
    return finish(_inter(spark, d, "k-SII"))


@register("interact_stii", f"""WITH {base_ctes()}, {pair_cte('STII')},
inter AS (
  SELECT a.doc_id, n1.feature AS feature_i, CAST(NULL AS VARCHAR) AS feature_j, CAST(1 AS BIGINT) AS "order",
         b.v - a.v AS value
  FROM v a JOIN {NAMES.replace('nm(', 'n1(')} ON a.mask = 0
  JOIN v b ON b.doc_id = a.doc_id AND b.mask = (1 << n1.i)
  UNION ALL
  SELECT pairs.doc_id, n1.feature, n2.feature, CAST(2 AS BIGINT), pairs.value
  FROM pairs JOIN {NAMES.replace('nm(', 'n1(')} ON n1.i = pairs.i JOIN {NAMES.replace('nm(', 'n2(')} ON n2.i = pairs.j)
{_INTER_SELECT}""")
def interact_stii(spark, d):
    return finish(_inter(spark, d, "STII"))


def _fsi_sql() -> str:
    design = X.interaction_design(D, "FSI")
    rows = []
    for k, term in enumerate(design.terms):
        fi = DOC_FEATURES[term[0]]
        fj = f"'{DOC_FEATURES[term[1]]}'" if len(term) > 1 else "NULL"
        for j, m in enumerate(design.masks):
            c = float(np.round(design.matrix[k, j], 15))
            if c != 0.0:
                rows.append(f"('{fi}', {fj}, {len(term)}, {m}, {c!r})")
    coef = "(VALUES " + ", ".join(rows) + ") AS coef(feature_i, feature_j, ord, mask, c)"
    return f"""WITH {base_ctes()},
inter AS (SELECT v.doc_id, coef.feature_i, CAST(coef.feature_j AS VARCHAR) AS feature_j,
                 CAST(coef.ord AS BIGINT) AS "order", sum(coef.c * v.v) AS value
          FROM v JOIN {coef} ON coef.mask = v.mask GROUP BY ALL)
{_INTER_SELECT}"""


@register("interact_fsi", _fsi_sql())
def interact_fsi(spark, d):
    """Faithful Shapley interactions; the oracle applies the same least
    squares solution matrix to brute-force coalition values."""
    return finish(_inter(spark, d, "FSI"))


_PAIRS_T = [(a, b) for i, a in enumerate(DOC_FEATURES) for b in DOC_FEATURES[i + 1:]]


@register("interact_deviation", "WITH " + f"t AS {doc_explain_sql()}, "
          + "mu AS (SELECT " + ", ".join(f"avg({f}) AS mu_{f}" for f in DOC_FEATURES) + " FROM t)\n"
          + "\nUNION ALL\n".join(
              f"SELECT doc_id, '{a}' AS feature_i, '{b}' AS feature_j, "
              f"round(({a} - mu_{a}) * ({b} - mu_{b}), {R}) AS value, CAST(2 AS BIGINT) AS \"order\" FROM t, mu"
              for a, b in _PAIRS_T))
def interact_deviation(spark, d):
    t = doc_explain_table(spark, d)
    return finish(X.deviation_interactions(t, DOC_FEATURES, KEY))


STRENGTH_K = 6


@register("interact_strength", f"""WITH {_ksii_sql_ctes()}
SELECT feature_i, feature_j, "order", round(avg(abs(value)), {R}) AS interaction_strength
FROM inter GROUP BY ALL ORDER BY avg(abs(value)) DESC, feature_i, feature_j NULLS FIRST LIMIT {STRENGTH_K}""")
def interact_strength(spark, d):
    return finish(X.interaction_strength(_inter(spark, d, "k-SII"), STRENGTH_K))


@register("interact_edges", f"""WITH {_ksii_sql_ctes()},
top AS (SELECT feature_i, feature_j, "order", avg(abs(value)) AS s FROM inter GROUP BY ALL
        ORDER BY s DESC, feature_i, feature_j NULLS FIRST LIMIT {STRENGTH_K}),
p AS (SELECT * FROM top WHERE "order" = 2)
SELECT feature_i, feature_j, round(s, {R}) AS interaction_strength,
       round(5.0 * s / max(s) OVER (), {R}) AS width FROM p""")
def interact_edges(spark, d):
    return finish(X.interaction_edges(_inter(spark, d, "k-SII"), STRENGTH_K))


MATRIX_K = 3


@register("interact_matrix", f"""WITH {_ksii_sql_ctes()},
pstr AS (SELECT feature_i, feature_j, avg(abs(value)) AS strength FROM inter WHERE "order" = 2 GROUP BY ALL),
both_ AS (SELECT feature_i AS a, feature_j AS b, strength FROM pstr UNION ALL
          SELECT feature_j AS a, feature_i AS b, strength FROM pstr),
top AS (SELECT a FROM both_ GROUP BY a ORDER BY sum(strength) DESC, a LIMIT {MATRIX_K})
SELECT a, b, round(strength, {R}) AS strength FROM both_
WHERE a IN (SELECT a FROM top) AND b IN (SELECT a FROM top)""")
def interact_matrix(spark, d):
    return finish(X.interaction_matrix(_inter(spark, d, "k-SII"), MATRIX_K))


@register("interact_instance", f"""WITH {_ksii_sql_ctes()}
SELECT * FROM (SELECT doc_id, feature_i, feature_j, "order", round(value, {R}) AS value,
  row_number() OVER (PARTITION BY doc_id ORDER BY abs(value) DESC, feature_i, feature_j NULLS FIRST) AS rank
  FROM inter) WHERE rank <= 5""")
def interact_instance(spark, d):
    return finish(X.instance_interactions(_inter(spark, d, "k-SII"), KEY, 5))


# ------------------------------------------- many features, a budget of coalitions
def _wide_table(spark, d, n):
    """All components of the vectors, summed in ``n`` groups of neighbours."""
    emb = read_table(spark, d, "embeddings")
    group = emb.agg(F.max(F.size("embedding"))).first()[0] // n
    feats = [f"g{i}" for i in range(n)]
    sums = [sum((F.col("embedding")[i * group + k].cast("double") for k in range(1, group)), F.col("embedding")[i * group].cast("double"))
            for i in range(n)]
    t = reuse(emb.select("vec_id", *[x.alias(f) for f, x in zip(feats, sums)]))
    scorer = LinearScorer({f: 2.0 * (-1) ** i * (1 + i % 5) for i, f in enumerate(feats)}, 0.2, decimals=None, name="wide")
    return t, feats, scorer, hash_sample(t, 50, ["vec_id"], seed=42)


def _wide_interactions(spark, d, n, index, budget):
    t, feats, scorer, bg = _wide_table(spark, d, n)
    return finish(X.interaction_values(t, feats, scorer, bg, ["vec_id"], index, budget=budget))


@register("interact_ksii_sampled")
def interact_ksii_sampled(spark, d):
    """k-SII of every pair of 16 features, from 800 coalitions."""
    return _wide_interactions(spark, d, 16, "k-SII", 800)


@register("interact_stii_sampled")
def interact_stii_sampled(spark, d):
    """Shapley-Taylor index of every pair of 32 features, from 1 500 coalitions."""
    return _wide_interactions(spark, d, 32, "STII", 1500)


@register("explain_kernel_shap_wide")
def explain_kernel_shap_wide(spark, d):
    """Kernel Shapley values of 32 features, from 1 000 coalitions."""
    t, feats, scorer, bg = _wide_table(spark, d, 32)
    return finish(X.shapley_values(t, feats, scorer, bg, ["vec_id"], method="kernel", n_samples=1000))
