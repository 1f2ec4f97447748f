"""Registered profiling, preparation and split queries (E, F, P, S1)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction_sql
from ..operators import prep as FP
from ..operators import profile as PR
from ..operators import split as SP
from ..session import ensure_checkpoint_dir
from ..sources import files as SF
from ..sources.tables import read_table
from .catalog import finish, register
from .fixtures import (DOC_FEATURES, LINEITEM_FEATURES, LINEITEM_KEY, LINEITEM_TIES,
                       document_table, document_table_sql, scored_lineitem, scored_lineitem_sql)
from .q_eval import MC, _multiclass
from .sqlparts import R, hash_rank_expr, order_hash_expr, stratified_sql

# ============================================================== E: profiling
_LI_COLS = LINEITEM_FEATURES


@register("profile_describe", f"""
WITH lg AS (UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in _LI_COLS)} FROM lineitem)
            ON {', '.join(_LI_COLS)} INTO NAME "column" VALUE value)
SELECT "column", count(value) AS count,
       CAST(sum(CAST(value AS DECIMAL(38,10))) AS DOUBLE) / CAST(count(value) AS DOUBLE) AS mean, round(stddev_samp(value), {R}) AS std,
       round(min(value), {R}) AS min, round(quantile_cont(value, 0.25), {R}) AS q25,
       round(quantile_cont(value, 0.5), {R}) AS q50, round(quantile_cont(value, 0.75), {R}) AS q75,
       round(max(value), {R}) AS max
FROM lg GROUP BY "column\"""")
def profile_describe(spark, d):
    li = read_table(spark, d, "lineitem")
    return finish(PR.describe_table(li, _LI_COLS), exact=("mean",))


@register("profile_class_distribution", f"""
SELECT CAST(quality AS BIGINT) AS quality, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (), {R}) AS share
FROM labels GROUP BY quality""")
def profile_class_distribution(spark, d):
    return finish(PR.class_distribution(read_table(spark, d, "labels"), "quality"))


def _corr_sql() -> str:
    parts = []
    for i, a in enumerate(_LI_COLS):
        for b in _LI_COLS[i + 1:]:
            for x, y in ((a, b), (b, a)):
                parts.append(f"SELECT '{x}' AS a, '{y}' AS b, round(corr({a}, {b}), {R}) AS corr FROM lineitem")
    return "\nUNION ALL\n".join(parts)


@register("profile_correlation", _corr_sql())
def profile_correlation(spark, d):
    return finish(PR.correlation_matrix(read_table(spark, d, "lineitem"), _LI_COLS))


@register("profile_dataset_info", f"""
SELECT count(*) AS n_rows, count(DISTINCT label) AS n_classes,
       CAST(sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS BIGINT) AS n_train,
       CAST(sum(CASE WHEN split = 'test' THEN 1 ELSE 0 END) AS BIGINT) AS n_test,
       CAST(5 AS BIGINT) AS n_features, CAST(1 AS BIGINT) AS n_categorical, CAST(4 AS BIGINT) AS n_numerical
FROM {document_table_sql()}""")
def profile_dataset_info(spark, d):
    t = document_table(spark, d)
    return finish(PR.dataset_info(t, [*DOC_FEATURES, "lang"], "label", "split"))


@register("profile_value_frequency", """
SELECT o_orderpriority, count(*) AS count FROM orders GROUP BY o_orderpriority""")
def profile_value_frequency(spark, d):
    return finish(FP.value_frequency(read_table(spark, d, "orders"), "o_orderpriority"))


_LABEL_COLS = ["doc_id", "quality", "toxic"]


@register("profile_target_candidates", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS position, count(DISTINCT {c}) AS n_distinct,
       count(DISTINCT {c}) = 2 AS is_binary, CAST(NULL AS BIGINT) AS name_rank FROM labels"""
    for i, c in enumerate(_LABEL_COLS)))
def profile_target_candidates(spark, d):
    return finish(PR.target_candidates(read_table(spark, d, "labels").select(*_LABEL_COLS)))


_BINARY_COLS = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]


@register("profile_binary_columns", "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", CAST({i} AS BIGINT) AS position, count(DISTINCT {c}) = 2 AS is_binary FROM lineitem"""
    for i, c in enumerate(_BINARY_COLS)))
def profile_binary_columns(spark, d):
    return finish(PR.binary_columns(read_table(spark, d, "lineitem").select(*_BINARY_COLS)))


@register("source_read_table", """SELECT 'l_linestatus' AS target, count(*) AS n_rows, count(DISTINCT l_linestatus) AS n_classes,
  CAST(4 AS BIGINT) AS n_columns FROM lineitem""")
def source_read_table(spark, d):
    """A table written as CSV, read back, and its target found by its two values."""
    path = f"{ensure_checkpoint_dir(spark)}/csv/{uuid.uuid4().hex}"
    rows = read_table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_linestatus", "l_returnflag")
    rows.write.option("header", True).csv(path)
    df, target = SF.read_table_with_target(spark, path)
    return finish(df.agg(F.lit(target).alias("target"), F.count("*").alias("n_rows"), F.count_distinct(target).alias("n_classes"),
                         F.lit(len(df.columns)).cast("long").alias("n_columns")))


@register("profile_correlation_wide", """WITH x AS (
  SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT 'e' || p.i AS a, 'e' || q.i AS b, round(corr(p.v, q.v), 6) AS corr
FROM x p JOIN x q ON p.vec_id = q.vec_id AND p.i <> q.i GROUP BY p.i, q.i""")
def profile_correlation_wide(spark, d):
    """All pairs of the vectors' components."""
    emb = read_table(spark, d, "embeddings")
    dims = emb.agg(F.max(F.size("embedding"))).first()[0]
    t = emb.select(*[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])
    return finish(PR.correlation_matrix(t, t.columns))


# ============================================================== F: preparation
RARE_SHARE_PART = 0.04


@register("prep_bucket_rare", f"""
WITH c AS (SELECT p_brand, count(*) AS n FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand),
t AS (SELECT count(*) AS total FROM part)
SELECT p.p_partkey, CASE WHEN c.n < CAST({RARE_SHARE_PART} AS DOUBLE) * t.total THEN 'other' ELSE p.p_brand END AS p_brand
FROM part p LEFT JOIN c ON p.p_brand = c.p_brand, t""")
def prep_bucket_rare(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_brand")
    return finish(FP.bucket_rare(part, ["p_brand"], RARE_SHARE_PART))


@register("prep_label_encode", """
SELECT o_orderkey,
       dense_rank() OVER (ORDER BY coalesce(o_orderstatus, 'nan')) - 1 AS o_orderstatus,
       dense_rank() OVER (ORDER BY coalesce(o_orderpriority, 'nan')) - 1 AS o_orderpriority
FROM orders""")
def prep_label_encode(spark, d):
    o = read_table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return finish(FP.label_encode(o, ["o_orderstatus", "o_orderpriority"]))


@register("prep_encode_target", """
SELECT c_custkey, dense_rank() OVER (ORDER BY coalesce(c_mktsegment, 'nan')) - 1 AS c_mktsegment
FROM customer""")
def prep_encode_target(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return finish(FP.encode_target(c, "c_mktsegment"))


@register("prep_double_encode", """
WITH a AS (SELECT p_partkey, dense_rank() OVER (ORDER BY coalesce(CAST(p_size AS VARCHAR), 'nan')) - 1 AS c1
           FROM part)
SELECT p_partkey, dense_rank() OVER (ORDER BY CAST(c1 AS VARCHAR)) - 1 AS p_size FROM a""")
def prep_double_encode(spark, d):
    p = read_table(spark, d, "part").select("p_partkey", "p_size")
    return finish(FP.double_encode(p, ["p_size"]))


def _scale_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in _LI_COLS)
    cols = ", ".join(f"round(({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END, {R}) AS {c}"
                     for c in _LI_COLS)
    src = scored_lineitem_sql(keep_features=True)
    return f"""WITH s AS {src}, st AS (SELECT {stats} FROM s WHERE split = 'train')
SELECT row_id, l_partkey, l_suppkey, split, {cols} FROM s, st"""


@register("prep_standard_scale", _scale_sql())
def prep_standard_scale(spark, d):
    s = scored_lineitem(spark, d, keep_features=True).select(*LINEITEM_KEY[:3], "split", *_LI_COLS)
    return finish(FP.standard_scale(s, _LI_COLS, F.col("split") == "train"))


@register("prep_quantile_normal")
def prep_quantile_normal(spark, d):
    """Rows-only: landmarks come from a percentile sketch (the reference
    fits on a random subsample); shape properties are tested in tests/."""
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return finish(FP.quantile_normal_scale(c, ["c_acctbal"]))


NOISE_SIGMA = 0.05


def _noise_sql(col: str) -> str:
    def u(salt: str) -> str:
        h = (f"('0x' || substr(md5('7:' || CAST(c_custkey AS VARCHAR) || '|' || '{col}:{salt}'), 1, 15))::BIGINT")
        return f"((CAST({h} AS DOUBLE) + 0.5) / {float(2 ** 60)})"
    z = f"sqrt(-2.0 * ln({u('1')})) * cos({6.283185307179586!r} * {u('2')})"
    return f"round({col} + {NOISE_SIGMA} * {z}, {R})"


@register("prep_gaussian_noise", f"""
SELECT c_custkey, {_noise_sql('c_acctbal')} AS c_acctbal FROM customer""")
def prep_gaussian_noise(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return finish(FP.gaussian_noise(c, ["c_acctbal"], NOISE_SIGMA, seed=7, key_cols=["c_custkey"]))


@register("prep_mixup")
def prep_mixup(spark, d):
    """Rows-only: lambda ~ Beta draws per batch; convexity is tested."""
    t = document_table(spark, d).select("doc_id", "label", *DOC_FEATURES)
    return finish(FP.mixup(t, DOC_FEATURES, "label", ["doc_id"], alpha=0.4, batch_size=64, seed=42))


SMOOTH_EPS = 0.1


@register("prep_smooth_labels", f"""
WITH e AS (SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS y FROM orders)
SELECT o_orderkey, list_transform(range(5), lambda k: round(CASE WHEN k = y THEN CAST({1 - SMOOTH_EPS} AS DOUBLE)
       ELSE CAST(0.0 AS DOUBLE) END + CAST({SMOOTH_EPS / 5} AS DOUBLE), {R})) AS soft_label FROM e""")
def prep_smooth_labels(spark, d):
    o = FP.label_encode(read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority"),
                        ["o_orderpriority"])
    return finish(o.select("o_orderkey", FP.smooth_labels("o_orderpriority", 5, SMOOTH_EPS).alias("soft_label")))


@register("prep_teacher_logits", f"""
SELECT l_linestatus, label, list_transform(proba, lambda x: round(ln(x + 1e-10), {R})) AS teacher_logits
FROM {MC}""")
def prep_teacher_logits(spark, d):
    m = _multiclass(spark, d)
    return finish(m.select("l_linestatus", "label", FP.teacher_logits("proba").alias("teacher_logits")))


CAP_ROWS = 100


@register("prep_cap_sample", f"""
SELECT doc_id, n_chars, n_words FROM {document_table_sql()}
ORDER BY {order_hash_expr(['doc_id'], 42)}, doc_id LIMIT {CAP_ROWS}""")
def prep_cap_sample(spark, d):
    t = document_table(spark, d).select("doc_id", *DOC_FEATURES)
    return finish(FP.cap_training_sample(t, DOC_FEATURES, ["doc_id"], max_rows=CAP_ROWS, max_features=2))


SAMPLE_N = 50


@register("prep_sample_rows", f"""
SELECT c_custkey, c_acctbal FROM customer
ORDER BY {order_hash_expr(['c_custkey'], 43)}, c_custkey LIMIT {SAMPLE_N}""")
def prep_sample_rows(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return finish(FP.hash_sample(c, SAMPLE_N, ["c_custkey"], seed=43))


# ============================================================== P: splits
@register("split_hash", f"""
SELECT c_custkey, CASE WHEN {hash_fraction_sql(['c_custkey', 'c_mktsegment'])} < 0.5
       THEN 'train' ELSE 'test' END AS split FROM customer""")
def split_hash(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return finish(SP.hash_split(c, ["c_custkey", "c_mktsegment"], 0.5).select("c_custkey", "split"))


_DOC = f"(SELECT doc_id, label, n_chars, n_words, n_punct, lang_code FROM {document_table_sql()})"


@register("split_stratified", f"""
SELECT doc_id, label, split FROM {stratified_sql(_DOC, 'label', ['doc_id'], 0.2, 42)}""")
def split_stratified(spark, d):
    t = document_table(spark, d).select("doc_id", "label")
    return finish(SP.stratified_split(t, "label", ["doc_id"], 0.2, 42))


@register("split_kfold", f"""
SELECT doc_id, label, (({hash_rank_expr(['doc_id'], ['label'], 42)}) - 1) % 5 AS fold FROM {_DOC}""")
def split_kfold(spark, d):
    t = document_table(spark, d).select("doc_id", "label")
    return finish(SP.stratified_kfold(t, "label", ["doc_id"], 5, 42))


@register("split_repeated_kfold", f"""
WITH e AS (SELECT t.doc_id, t.label, r.range AS repeat FROM {_DOC} t, range(2) r)
SELECT doc_id, label, repeat,
       (({hash_rank_expr(['doc_id'], ['repeat', 'label'], 42, seed_col='repeat')}) - 1) % 5 AS fold FROM e""")
def split_repeated_kfold(spark, d):
    t = document_table(spark, d).select("doc_id", "label")
    return finish(SP.repeated_stratified_kfold(t, "label", ["doc_id"], 5, 2, 42))


def _per_fold_sql() -> str:
    cols = DOC_FEATURES
    sums = ", ".join(f"sum({c}) AS s_{c}, sum({c} * {c}) AS q_{c}" for c in cols)
    comp = ", ".join(f"sum(s_{c}) OVER () - s_{c} AS s_{c}, sum(q_{c}) OVER () - q_{c} AS q_{c}" for c in cols)
    stats = ", ".join(
        f"s_{c} / n AS m_{c}, CASE WHEN sqrt(greatest(q_{c} / n - (s_{c} / n) * (s_{c} / n), 0.0)) > 0 "
        f"THEN sqrt(greatest(q_{c} / n - (s_{c} / n) * (s_{c} / n), 0.0)) ELSE 1.0 END AS sd_{c}" for c in cols)
    scaled = ", ".join(f"round(({c} - m_{c}) / sd_{c}, {R}) AS {c}" for c in cols)
    return f"""WITH f AS (SELECT *, (({hash_rank_expr(['doc_id'], ['label'], 42)}) - 1) % 5 AS fold FROM {_DOC}),
per AS (SELECT fold, count(*) AS n0, {sums} FROM f GROUP BY fold),
comp AS (SELECT fold, sum(n0) OVER () - n0 AS n, {comp} FROM per),
st AS (SELECT fold, {stats} FROM comp)
SELECT doc_id, label, fold, {scaled} FROM f JOIN st USING (fold)"""


@register("split_per_fold_scale", _per_fold_sql())
def split_per_fold_scale(spark, d):
    t = document_table(spark, d).select("doc_id", "label", *DOC_FEATURES)
    folded = SP.stratified_kfold(t, "label", ["doc_id"], 5, 42)
    return finish(SP.per_fold_scale(folded, "fold", DOC_FEATURES))


@register("split_holdout", f"""
WITH r AS (SELECT c_custkey, {hash_rank_expr(['c_custkey'], [], 42)} AS rk, count(*) OVER () AS n FROM customer)
SELECT c_custkey, rk <= floor(n * CAST(0.2 AS DOUBLE)) AS holdout FROM r""")
def split_holdout(spark, d):
    c = read_table(spark, d, "customer").select("c_custkey")
    return finish(SP.random_holdout(c, ["c_custkey"], 0.2, seed=42))


N_SPLIT_RUNS = 10


@register("split_repeated", f"""
WITH e AS (SELECT t.doc_id, t.label, r.range AS run FROM {_DOC} t, range({N_SPLIT_RUNS}) r)
SELECT doc_id, label, run, split FROM {stratified_sql('e', 'label', ['doc_id'], 0.2, 42, ['run'], 'run')}""")
def split_repeated(spark, d):
    t = document_table(spark, d).select("doc_id", "label")
    return finish(SP.repeated_splits(t, "label", ["doc_id"], N_SPLIT_RUNS, 0.2, 42))


@register("split_stratified_lineitem", f"""
SELECT split, label, count(*) AS n FROM {stratified_sql(f"(SELECT * EXCLUDE (split) FROM {scored_lineitem_sql()})", 'label',
    LINEITEM_KEY, 0.2, 42, tie_cols=LINEITEM_TIES)} GROUP BY split, label""")
def split_stratified_lineitem(spark, d):
    s = scored_lineitem(spark, d).drop("split")
    sp = SP.stratified_split(s, "label", LINEITEM_KEY, 0.2, 42, tie_cols=LINEITEM_TIES)
    return finish(sp.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")))

