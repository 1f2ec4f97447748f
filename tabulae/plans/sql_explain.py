"""SQL text for the explanation oracles: coalition values by brute-force
enumeration (rows x coalitions x background) and the Shapley / interaction
formulas written out with factorials, independent of the Spark designs."""

from __future__ import annotations

from .fixtures import DOC_FEATURES, EXPLAIN_SCORER, N_BACKGROUND, doc_explain_sql
from .sqlparts import order_hash_expr

D = len(DOC_FEATURES)
NAMES = "(VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(DOC_FEATURES)) + ") AS nm(i, feature)"


def base_ctes() -> str:
    """CTEs t (rows), bg (background), v (doc_id, mask, v)."""
    masked = {f: f"CASE WHEN (m.mask >> {i}) & 1 = 1 THEN t.{f} ELSE bg.{f} END"
              for i, f in enumerate(DOC_FEATURES)}
    f = EXPLAIN_SCORER.proba_sql(masked)
    return f"""t AS {doc_explain_sql()},
bg AS (SELECT * FROM t ORDER BY {order_hash_expr(['doc_id'], 42)}, doc_id LIMIT {N_BACKGROUND}),
m AS (SELECT range AS mask FROM range({1 << D})),
v AS (SELECT t.doc_id, m.mask, avg({f}) AS v FROM t, m, bg GROUP BY t.doc_id, m.mask)"""


def shapley_cte() -> str:
    """CTE phi (doc_id, i, phi)."""
    s = "bit_count(a.mask)"
    w = f"(CAST(factorial({s}) AS DOUBLE) * CAST(factorial({D - 1} - {s}) AS DOUBLE) / CAST(factorial({D}) AS DOUBLE))"
    return f"""fi AS (SELECT range AS i FROM range({D})),
phi AS (SELECT a.doc_id, fi.i, sum({w} * (b.v - a.v)) AS phi
  FROM v a JOIN fi ON (a.mask >> fi.i) & 1 = 0
  JOIN v b ON b.doc_id = a.doc_id AND b.mask = a.mask | (1 << fi.i)
  GROUP BY a.doc_id, fi.i)"""


def pair_cte(index: str) -> str:
    """CTE pairs (doc_id, i, j, value) for SII or STII."""
    s = "bit_count(s.mask)"
    if index == "SII":
        w = (f"(CAST(factorial({s}) AS DOUBLE) * CAST(factorial({D - 2} - {s}) AS DOUBLE)"
             f" / CAST(factorial({D - 1}) AS DOUBLE))")
    else:
        # 2/d / C(d-1, s)
        w = (f"(2.0 / {D} * CAST(factorial({s}) AS DOUBLE) * CAST(factorial({D - 1} - {s}) AS DOUBLE)"
             f" / CAST(factorial({D - 1}) AS DOUBLE))")
    return f"""pr AS (SELECT a.range AS i, b.range AS j FROM range({D}) a, range({D}) b WHERE a.range < b.range),
pairs AS (SELECT s.doc_id, pr.i, pr.j, sum({w} * (vij.v - vi.v - vj.v + s.v)) AS value
  FROM v s JOIN pr ON (s.mask >> pr.i) & 1 = 0 AND (s.mask >> pr.j) & 1 = 0
  JOIN v vij ON vij.doc_id = s.doc_id AND vij.mask = s.mask | (1 << pr.i) | (1 << pr.j)
  JOIN v vi ON vi.doc_id = s.doc_id AND vi.mask = s.mask | (1 << pr.i)
  JOIN v vj ON vj.doc_id = s.doc_id AND vj.mask = s.mask | (1 << pr.j)
  GROUP BY s.doc_id, pr.i, pr.j)"""
