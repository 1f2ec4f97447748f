"""File sources: CSV tables with target detection, ARFF files, and the
dataset registry.

ARFF is read with Spark's text source: the ``@attribute`` header lines
(bounded by the column count) are collected to build the schema, and the
data lines are parsed in parallel with ``from_csv``.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.profile import detect_target


def read_table_with_target(spark: SparkSession, path: str, target: str | None = None,
                           fmt: str = "csv") -> tuple[DataFrame, str]:
    """Read a table and name its target column: the given one, else the
    first known target name, else the first two-valued column, else the last."""
    reader = spark.read.option("header", True).option("inferSchema", True) if fmt == "csv" else spark.read
    df = reader.format(fmt).load(path)
    if target is None:
        target, _ = detect_target(df)
    if target not in df.columns:
        raise ValueError(f"target {target!r} not in {df.columns}")
    return df, target


_ATTR = re.compile(r"^\s*@attribute\s+('(?:[^']|\\')*'|\"[^\"]*\"|\S+)\s+(.+?)\s*$", re.IGNORECASE)


def _arff_type(spec: str) -> T.DataType:
    s = spec.strip().lower()
    if s in ("numeric", "real", "double"):
        return T.DoubleType()
    if s == "integer":
        return T.LongType()
    return T.StringType()  # nominal {..}, string, date


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """ARFF file(s) -> DataFrame; nominal and string values are text, '?' is null.
    Several files must have the same header."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("_file"),
                                         F.struct(F.col("_metadata.file_block_start"),
                                                  F.monotonically_increasing_id()).alias("_pos"))
    headers = (lines.where(F.lower(F.trim("line")).startswith("@attribute"))
               .groupBy("_file").agg(F.sort_array(F.collect_list(F.struct("_pos", "line"))).alias("h"))
               .select(F.col("h.line").alias("h")).distinct().limit(2).collect())
    if len(headers) != 1:
        raise ValueError(f"the files under {path!r} have " + ("no header" if not headers else "different headers"))
    header = [{"line": x} for x in headers[0]["h"]]
    fields = []
    for r in header:
        m = _ATTR.match(r["line"])
        if not m:
            raise ValueError(f"bad ARFF attribute line: {r['line']}")
        name = m.group(1).strip("'\"")
        fields.append(T.StructField(name, _arff_type(m.group(2))))
    schema = T.StructType(fields)
    data = lines.where(~F.trim("line").startswith("@") & ~F.trim("line").startswith("%")
                       & (F.length(F.trim("line")) > 0))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    parsed = data.select(F.from_csv("line", ddl, {"quote": "'", "nullValue": "?",
                                                  "ignoreLeadingWhiteSpace": "true",
                                                  "ignoreTrailingWhiteSpace": "true"}).alias("r"))
    return parsed.select("r.*")


def convert_arff_dir(spark: SparkSession, src_dir: str, out_dir: str) -> list[str]:
    """Convert every ``.arff`` in a folder to CSV; existing outputs are kept."""
    done = []
    fs, folder = _file_system(spark, src_dir)
    for name in sorted(f.getPath().getName() for f in fs.listStatus(folder)):
        if not name.endswith(".arff"):
            continue
        out = f"{out_dir.rstrip('/')}/{name[:-5]}.csv"
        read_arff(spark, f"{src_dir.rstrip('/')}/{name}").write.mode("ignore").option("header", True).csv(out)
        done.append(out)
    return done


def _file_system(spark: SparkSession, path: str):
    """The file system that Spark reads ``path`` from, and the path there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


# Datasets of the reference, which are downloaded or local
# files there; here they must be supplied as files (no network job).
REFERENCE_DATASETS = ["breast_cancer", "adult_income", "bank_marketing", "diabetes",
                      "in-vehicle_coupon", "credit_card_fraud"]


def dataset(spark: SparkSession, name: str, sf_dir: str | None = None,
            data_dir: str | None = None) -> tuple[DataFrame, str]:
    """Name -> (table, target). Test-data datasets come from ``sf_dir``;
    reference datasets from ``data_dir/<name>.csv``. A missing dataset is an
    error (never silently replaced by another one)."""
    if name == "documents" and sf_dir:
        from ..plans.fixtures import document_table
        return document_table(spark, sf_dir), "label"
    if name == "lineitem" and sf_dir:
        li = spark.read.parquet(f"{sf_dir.rstrip('/')}/lineitem.parquet")
        return li.withColumn("label", (F.col("l_returnflag") == "R").cast("int")).drop("l_returnflag"), "label"
    if name in REFERENCE_DATASETS:
        if data_dir:
            for cand in (f"{name}.csv", f"{name.replace('-', '_')}.csv"):
                p = f"{data_dir.rstrip('/')}/{cand}"
                fs, at = _file_system(spark, p)
                if fs.exists(at):
                    return read_table_with_target(spark, p)
        raise FileNotFoundError(f"dataset {name!r} not found under {data_dir!r}")
    raise ValueError(f"Unknown dataset: {name}")
