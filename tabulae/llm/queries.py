"""Queries of the training-data operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
import public_tokenizers

from . import (decontaminate, embed_dedup, filter_audit, hard_negatives, line_dedup, mixing, quality, recompress, sharding,
               simhash, sql, token_output, toxicity, url_filter)
from .common import in_train, table

MIX_WEIGHTS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}
N_SHARDS = 40
TOKENIZER = "word_bpe_49k.json"


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _judged(toxicity.score_toxicity(docs, model), 0.5)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = recompress.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", _sha256("kept_text"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), sorted(MIX_WEIGHTS))
    return mixing.mix(docs, model, MIX_WEIGHTS).select("doc_id", "n_tokens", "posteriors", "rate", "copies", "unmet")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return sharding.shard(rows, N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return _judged(quality.score_quality(docs, model), 0.3)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha256("kept_text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.roundtrip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine_hard_negatives(rows, F.col("vec_id") % 100 == 0)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("filter")


def _judged(scored: DataFrame, cut: float) -> DataFrame:
    return scored.select("doc_id", (~in_train(F.col("doc_id"))).alias("held_out"), "score",
                         (F.col("score") >= cut).cast("int").alias("predicted"))


def _sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256).alias("kept_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_simhash, op2_url_filter, op3_toxicity, op4_substring_dedup, op5_mixing, op6_embedding_dedup,
                            op7_sharding, op8_quality, op9_line_dedup, op10_decontamination, op11_token_output,
                            op12_hard_negatives, op13_filter_audit)
} | {"pipeline": corpus_pipeline.run}

ORACLES: dict[str, str] = {
    "op4_substring_dedup": sql.SUBSTRING_DEDUP, "op7_sharding": sql.SHARDING, "op9_line_dedup": sql.LINE_DEDUP,
    "op12_hard_negatives": sql.HARD_NEGATIVES, "op13_filter_audit": sql.FILTER_AUDIT,
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
