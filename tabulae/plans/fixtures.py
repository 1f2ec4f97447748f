"""Shared derived tables for the registered queries, with their SQL twins.

* ``scored_lineitem``: every lineitem row scored by a fixed logistic model
  (label = return flag 'R'), hash split 80/20 on the line key.
* ``document_features``: documents joined with labels, text features
  (characters, words, punctuation, encoded language), standardised on the
  train split and scored by a fixed logistic model for ``quality``.

Each Spark builder has a SQL text producing the same rows in DuckDB so the
oracles can start from identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import hash_fraction_sql
from ..functions.scorers import LinearScorer
from ..operators.metrics import threshold_labels
from ..operators.prep import label_encode, standard_scale
from ..operators.split import hash_split
from ..session import reuse
from ..sources.tables import read_table

# Fixture model coefficients and split thresholds.
LINEITEM_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_SCORER = LinearScorer(
    {"l_quantity": 0.03, "l_extendedprice": -0.00001, "l_discount": 4.0, "l_tax": -3.0},
    intercept=-0.4, name="base")
LINEITEM_ALT_SCORERS = [
    LINEITEM_SCORER,
    LinearScorer({"l_quantity": 0.02, "l_extendedprice": -0.000005, "l_discount": 6.0, "l_tax": -1.0},
                 intercept=-0.5, name="wide"),
    LinearScorer({"l_quantity": -0.01, "l_extendedprice": 0.000004, "l_discount": -2.0, "l_tax": 5.0},
                 intercept=0.1, name="flip"),
]
LINEITEM_TRAIN_SHARE = 0.8
# (l_orderkey, l_linenumber) repeats in the test data: hash orders use this
# key and break remaining ties by the outputs, so tied rows are interchangeable.
LINEITEM_KEY = ["row_id", "l_partkey", "l_suppkey"]
LINEITEM_TIES = ["label", "p"]

DOC_FEATURES = ["n_chars", "n_words", "n_punct", "lang_code"]
DOC_SCORER = LinearScorer({"n_chars": 0.6, "n_words": 0.4, "n_punct": -0.3, "lang_code": 0.2},
                          intercept=1.6, name="doc")
DOC_TRAIN_SHARE = 0.8
WORD_PATTERN = "[^ \\t\\n\\r]+"
PUNCT_PATTERN = "[.,;:!?]"


# --------------------------------------------------------------------------- lineitem
def scored_lineitem(spark: SparkSession, sf_dir: str, scorer: LinearScorer = LINEITEM_SCORER,
                    keep_features: bool = False) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *LINEITEM_FEATURES)
    li = hash_split(li, ["l_orderkey", "l_linenumber"], LINEITEM_TRAIN_SHARE)
    out = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("row_id"),
        "l_partkey", "l_suppkey", "split", (F.col("l_returnflag") == "R").cast("int").alias("label"),
        scorer.proba().alias("p"),
        *(LINEITEM_FEATURES if keep_features else []))
    return out.withColumn("pred", threshold_labels("p"))


def scored_lineitem_sql(scorer: LinearScorer = LINEITEM_SCORER, keep_features: bool = False) -> str:
    feats = "".join(f", {c}" for c in LINEITEM_FEATURES) if keep_features else ""
    frac = hash_fraction_sql(["l_orderkey", "l_linenumber"])
    return f"""(SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, l_partkey, l_suppkey,
        CASE WHEN {frac} < {LINEITEM_TRAIN_SHARE} THEN 'train' ELSE 'test' END AS split,
        CAST(l_returnflag = 'R' AS BIGINT) AS label,
        {scorer.proba_sql()} AS p,
        CAST({scorer.proba_sql()} >= 0.5 AS INTEGER) AS pred{feats}
      FROM lineitem)"""


# --------------------------------------------------------------------------- documents
def document_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents joined with labels, raw text features and split."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id")
    feats = j.select(
        "doc_id", "lang", F.col("quality").alias("label"), "toxic",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)).cast("double").alias("n_words"),
        F.regexp_count(F.col("text"), F.lit(PUNCT_PATTERN)).cast("double").alias("n_punct"))
    # Whole texts are scanned once; the small feature table feeds the
    # encoder fit, the scaler fit and every metric job.
    feats = reuse(feats)
    feats = label_encode(feats, ["lang"], suffix="_code").withColumn(
        "lang_code", F.col("lang_code").cast("double"))
    return hash_split(feats, ["doc_id"], DOC_TRAIN_SHARE)


def document_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised (train statistics) features and fixed-model score."""
    raw = document_table(spark, sf_dir)
    scaled = standard_scale(raw, DOC_FEATURES, F.col("split") == "train")
    return scaled.withColumn("p", DOC_SCORER.proba()).withColumn("pred", threshold_labels("p"))


def document_table_sql() -> str:
    frac = hash_fraction_sql(["d.doc_id"])
    return f"""(SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS label, l.toxic,
        CAST(d.n_chars AS DOUBLE) AS n_chars,
        CAST(len(regexp_extract_all(d.text, '{WORD_PATTERN}')) AS DOUBLE) AS n_words,
        CAST(len(regexp_extract_all(d.text, '{PUNCT_PATTERN}')) AS DOUBLE) AS n_punct,
        CAST(dense_rank() OVER (ORDER BY coalesce(d.lang, 'nan')) - 1 AS DOUBLE) AS lang_code,
        CASE WHEN {frac} < {DOC_TRAIN_SHARE} THEN 'train' ELSE 'test' END AS split
      FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def document_features_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in DOC_FEATURES)
    scaled = ", ".join(
        f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END AS {c}" for c in DOC_FEATURES)
    return f"""(WITH raw AS {document_table_sql()},
      st AS (SELECT {stats} FROM raw WHERE split = 'train'),
      sc AS (SELECT doc_id, lang, label, toxic, split, {scaled} FROM raw, st)
      SELECT *, {DOC_SCORER.proba_sql()} AS p,
             CAST({DOC_SCORER.proba_sql()} >= 0.5 AS INTEGER) AS pred FROM sc)"""


# --------------------------------------------------------------------------- explanations
# Explanations use the unrounded document model so Shapley sums are exact.
EXPLAIN_SCORER = LinearScorer(dict(DOC_SCORER.coefs), DOC_SCORER.intercept, decimals=None, name="doc")
N_BACKGROUND = 50


def doc_explain_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's four text features, standardised over all documents."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")
    feats = docs.select(
        "doc_id", "lang",
        F.col("n_chars").cast("double").alias("n_chars"),
        F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)).cast("double").alias("n_words"),
        F.regexp_count(F.col("text"), F.lit(PUNCT_PATTERN)).cast("double").alias("n_punct"))
    feats = reuse(feats)  # texts scanned once
    feats = label_encode(feats, ["lang"], suffix="_code").withColumn(
        "lang_code", F.col("lang_code").cast("double")).drop("lang")
    return standard_scale(feats, DOC_FEATURES)


def doc_background(table: DataFrame) -> DataFrame:
    from ..operators.prep import hash_sample
    return hash_sample(table, N_BACKGROUND, ["doc_id"], seed=42)


def doc_explain_sql() -> str:
    stats = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in DOC_FEATURES)
    scaled = ", ".join(
        f"({c} - m_{c}) / CASE WHEN s_{c} > 0 THEN s_{c} ELSE 1.0 END AS {c}" for c in DOC_FEATURES)
    return f"""(WITH raw AS (SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars,
        CAST(len(regexp_extract_all(text, '{WORD_PATTERN}')) AS DOUBLE) AS n_words,
        CAST(len(regexp_extract_all(text, '{PUNCT_PATTERN}')) AS DOUBLE) AS n_punct,
        CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS DOUBLE) AS lang_code
      FROM documents),
      st AS (SELECT {stats} FROM raw)
      SELECT doc_id, {scaled} FROM raw, st)"""
