"""SQL text builders for the DuckDB oracles (kept apart from Spark code)."""

from __future__ import annotations

from collections.abc import Sequence

R = 6  # decimals, as in catalog.DECIMALS


def gsel(groups: Sequence[str]) -> str:
    return "".join(f"{g}, " for g in groups)


def part(groups: Sequence[str]) -> str:
    return f"PARTITION BY {', '.join(groups)} " if groups else ""


def grp(groups: Sequence[str]) -> str:
    return f"GROUP BY {', '.join(groups)}" if groups else ""


def curve_ctes(src: str, groups: Sequence[str], label: str = "label", score: str = "p",
               prefix: str = "") -> str:
    """CTEs ``{prefix}h`` and ``{prefix}curve`` (no leading WITH)."""
    g = gsel(groups)
    pb = part(groups)
    run = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""{prefix}h AS (
  SELECT {g}{score} AS threshold,
         CAST(sum(CASE WHEN {label} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
         CAST(sum(CASE WHEN {label} = 1 THEN 0 ELSE 1 END) AS BIGINT) AS neg
  FROM {src} GROUP BY {g}{score}),
{prefix}c AS (
  SELECT *, sum(pos) OVER ({pb}ORDER BY threshold {run}) AS cum_pos,
            sum(neg) OVER ({pb}ORDER BY threshold {run}) AS cum_neg,
            sum(pos) OVER ({pb}) AS tot_pos, sum(neg) OVER ({pb}) AS tot_neg
  FROM {prefix}h),
{prefix}curve AS (
  SELECT *, CAST(tp AS DOUBLE) / (tp + fp) AS precision,
         CASE WHEN tot_pos > 0 THEN CAST(tp AS DOUBLE) / tot_pos ELSE 1.0 END AS recall
  FROM (SELECT *, tot_pos - cum_pos + pos AS tp, tot_neg - cum_neg + neg AS fp FROM {prefix}c))"""


def curve_metrics_select(groups: Sequence[str], prefix: str = "") -> str:
    g = gsel(groups)
    return f"""SELECT {g}
  CASE WHEN max(tot_pos) > 0 AND max(tot_neg) > 0 THEN
    sum(pos * (cum_neg - 0.5 * neg)) / (CAST(max(tot_pos) AS DOUBLE) * max(tot_neg)) END AS roc_auc,
  CASE WHEN max(tot_pos) > 0 THEN sum(pos * precision) / max(tot_pos) END AS pr_auc
FROM {prefix}curve {grp(groups)}"""


def label_metrics_select(src: str, groups: Sequence[str], label: str = "label",
                         pred: str = "pred") -> str:
    g = gsel(groups)
    return f"""SELECT {g}tp, fp, fn, tn,
  CASE WHEN tp + fp + fn + tn > 0 THEN CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn) ELSE 0.0 END AS accuracy,
  CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
  CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall,
  CASE WHEN 2 * tp + fp + fn > 0 THEN CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) ELSE 0.0 END AS f1
FROM (SELECT {g}
  CAST(sum(CASE WHEN {label} = 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN {label} <> 1 AND {pred} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN {label} = 1 AND {pred} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN {label} <> 1 AND {pred} <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn
  FROM {src} {grp(groups)})"""


def evaluate_long_sql(src: str, groups: Sequence[str], extra: bool = True) -> str:
    """Long (groups, metric, value) with the 7 default metrics (+ f1_max and
    precision_at_recall at 0.8 when ``extra``)."""
    g = gsel(groups)
    on = " AND ".join(f"lm.{x} = cm.{x}" for x in groups)
    keys = ", ".join(f"lm.{x}" for x in groups)
    join_kw = f"JOIN cm ON {on}" if groups else "CROSS JOIN cm"
    join_br = f"JOIN br ON {' AND '.join(f'lm.{x} = br.{x}' for x in groups)}" if groups else "CROSS JOIN br"
    extra_cols = ", ex.f1_max, coalesce(ex.precision_at_recall, 0.0) AS precision_at_recall" if extra else ""
    join_ex = ""
    if extra:
        join_ex = (f"JOIN ex ON {' AND '.join(f'lm.{x} = ex.{x}' for x in groups)}" if groups
                   else "CROSS JOIN ex")
    ex_cte = ""
    if extra:
        ex_cte = f""",
ex AS (SELECT {g} greatest(max(2 * precision * recall / (precision + recall + 1e-12)), 0.0) AS f1_max,
       arg_max(precision, threshold) FILTER (WHERE recall >= 0.8) AS precision_at_recall
       FROM curve {grp(groups)})"""
    metric_names = ["accuracy", "precision", "recall", "f1", "pr_auc", "roc_auc", "brier_score"]
    if extra:
        metric_names += ["f1_max", "precision_at_recall"]
    unp = ", ".join(metric_names)
    return f"""WITH {curve_ctes(src, groups)},
lm AS ({label_metrics_select(src, groups)}),
cm AS ({curve_metrics_select(groups)}),
br AS (SELECT {g} avg(power(p - label, 2)) AS brier_score FROM {src} {grp(groups)}){ex_cte},
wide AS (SELECT {keys + ', ' if groups else ''}lm.accuracy, lm.precision, lm.recall, lm.f1,
         cm.pr_auc, cm.roc_auc, br.brier_score{extra_cols}
         FROM lm {join_kw} {join_br} {join_ex})
SELECT {g}metric, round(CAST(value AS DOUBLE), {R}) AS value
FROM wide UNPIVOT INCLUDE NULLS (value FOR metric IN ({unp}))"""


def order_hash_expr(key_cols: Sequence[str], seed: int = 42, seed_col: str | None = None) -> str:
    """DuckDB twin of ``functions.hashing.order_hash`` (optionally seeded by a column)."""
    parts = ([f"CAST({seed_col} AS VARCHAR)"] if seed_col else []) + [
        f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in key_cols]
    joined = " || '|' || ".join(parts)
    return f"('0x' || substr(md5('{seed}:' || {joined}), 1, 15))::BIGINT"


def hash_rank_expr(key_cols: Sequence[str], groups: Sequence[str], seed: int = 42,
                   seed_col: str | None = None, tie_cols: Sequence[str] = ()) -> str:
    order = ", ".join([order_hash_expr(key_cols, seed, seed_col), *key_cols, *tie_cols])
    return f"row_number() OVER ({part(groups)}ORDER BY {order})"


def stratified_sql(src: str, label: str, key_cols: Sequence[str], test_size: float = 0.2,
                   seed: int = 42, groups: Sequence[str] = (), seed_col: str | None = None,
                   tie_cols: Sequence[str] = ()) -> str:
    """Subquery: ``src`` plus a ``split`` column, as operators.split.stratified_split."""
    g = gsel(groups)
    pg = part(groups)
    gl = [*groups, label]
    using = ", ".join(gl)
    return f"""(WITH base AS (SELECT * FROM {src}),
  cnt AS (SELECT {g}{label}, count(*) AS n_class FROM base GROUP BY ALL),
  a AS (SELECT *, sum(n_class) OVER ({pg}) AS n,
               ceil(CAST({test_size} AS DOUBLE) * sum(n_class) OVER ({pg})) AS n_test FROM cnt),
  b AS (SELECT *, floor(n_class * n_test / n) AS fl,
               n_class * n_test / n - floor(n_class * n_test / n) AS rem FROM a),
  c AS (SELECT *, n_test - sum(fl) OVER ({pg}) AS need,
               row_number() OVER ({pg}ORDER BY rem DESC, {label}) AS pos FROM b),
  alloc AS (SELECT {g}{label}, fl + CASE WHEN pos <= need THEN 1 ELSE 0 END AS n_test_class FROM c),
  ranked AS (SELECT *, {hash_rank_expr(key_cols, gl, seed, seed_col, tie_cols)} AS rk_ FROM base)
  SELECT ranked.* EXCLUDE (rk_),
         CASE WHEN rk_ <= n_test_class THEN 'test' ELSE 'train' END AS split
  FROM ranked JOIN alloc USING ({using}))"""
