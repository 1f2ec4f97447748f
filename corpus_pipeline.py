"""From raw documents to training shards, stage by stage.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
one's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulae.llm import decontaminate, mixing, quality, sharding, simhash
from tabulae.llm.common import table
from tabulae.session import ensure_checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
KEEP_QUALITY = 0.3
# English, German, Spanish and French tokens of the mixture.
WEIGHTS = {"de": 0.15, "en": 0.55, "es": 0.15, "fr": 0.15}
N_SHARDS = 40


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier gives less than ``KEEP_QUALITY``."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_quality(docs, model, keep=True).where(F.col("score") >= KEEP_QUALITY).select(*COLUMNS)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the one with the
    smallest id (null ids last), and of different texts under that id the one
    with the smallest hash. Rows that repeat it go."""
    groups = simhash.near_duplicate_groups(docs, root=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    chosen = groups.groupBy("root").agg(first.alias("f")).select(F.xxhash64("f.doc_id", "f.text_hash").alias("__row"))
    rows = docs.withColumn("__row", F.xxhash64("doc_id", F.xxhash64("text"))).join(chosen, "__row", "left_semi")
    again = Window.partitionBy("__row").orderBy("__row")
    return rows.withColumn("__n", F.row_number().over(again)).where("__n = 1").select(*COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark."""
    found = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=True)
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def mix_domains(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that the languages' expected tokens match
    ``WEIGHTS``; every document stays once at least (rates from 1 up)."""
    model = mixing.train(docs, table(spark, sf_dir, "labels"), sorted(WEIGHTS))
    mixed = mixing.mix(docs, model, WEIGHTS, floor=1.0)
    return mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deals all rows to ``N_SHARDS`` shards of equal bytes."""
    return sharding.shard(docs, N_SHARDS)


STAGES = [("quality classifier", quality_filter), ("SimHash near-dedup", simhash_dedup),
          ("benchmark decontamination", benchmark_decontamination), ("mixing to target weights", mix_domains),
          ("sharding", shard)]

# Learned models and iterative matching: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
