"""Reading the driver tables (one parquet file/folder per table)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

# The table names of the test data set.
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan; Catalyst prunes columns and pushes filters into it.

    A scan with fewer splits than the cluster has cores (a single small
    file or row group) would run all per-row work up to the first shuffle
    in a few tasks; it is spread round-robin. Large inputs already have
    many splits and are left alone.
    """
    if name not in TABLES:
        raise ValueError(f"Unknown table: {name}")
    df = spark.read.parquet(table_path(sf_dir, name))
    return spread(df)


def spread(df: DataFrame) -> DataFrame:
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df
