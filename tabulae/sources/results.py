"""Result files: experiment JSON documents, best-parameter files, tuning
summaries, importance and summary CSVs.

Experiments are written as one JSON document per (dataset, model) folder
(``partitionBy``), read back with a fixed schema, so a ledger of any size
is a scan, not a driver loop over files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RESULT_SCHEMA = T.StructType([
    T.StructField("experiment_name", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("test_metrics", T.StructType([
        T.StructField("mean", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("std", T.MapType(T.StringType(), T.DoubleType())),
    ])),
])


def results_documents(results_long: DataFrame) -> DataFrame:
    """(dataset, model, metric, mean, std) -> one nested document per experiment."""
    return results_long.groupBy("dataset", "model").agg(
        F.concat_ws("_", F.first("dataset"), F.first("model")).alias("experiment_name"),
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.struct(F.map_from_entries(F.collect_list(F.struct("metric", "mean"))).alias("mean"),
                 F.map_from_entries(F.collect_list(F.struct("metric", "std"))).alias("std")).alias("test_metrics"))


def write_results(docs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One JSON folder per (dataset, model) -- the experiment directory."""
    docs.write.mode(mode).partitionBy("dataset", "model").json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Experiment documents with ``dataset``/``model`` from the folder names
    and ``source_file`` from the file metadata; missing metric maps are empty."""
    schema = T.StructType([*RESULT_SCHEMA.fields, T.StructField("dataset", T.StringType()),
                           T.StructField("model", T.StringType())])
    raw = spark.read.option("basePath", path).schema(schema).json(path)
    empty = F.create_map().cast("map<string,double>")
    return raw.select(
        "dataset", "model", "experiment_name", "timestamp",
        F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("source_file"),
        F.coalesce(F.col("test_metrics.mean"), empty).alias("mean"),
        F.coalesce(F.col("test_metrics.std"), empty).alias("std"))


def results_to_long(docs: DataFrame) -> DataFrame:
    """Experiment documents -> (dataset, model, metric, mean, std)."""
    ex = docs.select("dataset", "model", "std", F.explode("mean").alias("metric", "mean"))
    return ex.select("dataset", "model", "metric", "mean", F.try_element_at("std", F.col("metric")).alias("std"))


def read_best_params(spark: SparkSession, path: str, dataset: str | None = None,
                     model: str | None = None) -> DataFrame:
    """(dataset, model, best_score, best_params) of a tuning JSON, in any of its
    forms: dataset -> model -> {best_score, best_params}, dataset -> model ->
    parameters, or one ``best_params`` (and ``best_score``) at the top level, which
    holds for any dataset and model (null names) that the file does not list.
    Model keys are matched lower-case; values are text."""
    def opened(c) -> Column:
        return F.from_json(c, "map<string,string>")

    top = spark.read.option("wholetext", True).text(path).select(opened("value").alias("m"))
    nested = (top.select(F.explode(F.map_filter("m", lambda k, v: ~k.isin("best_params", "best_score"))).alias("dataset", "v"))
              .select("dataset", F.explode(opened("v")).alias("model", "v")).select("dataset", "model", opened("v").alias("m")))
    whole = F.map_contains_key("m", F.lit("best_params"))
    score, inner = F.try_element_at("m", F.lit("best_score")).cast("double"), opened(F.try_element_at("m", F.lit("best_params")))
    nested = nested.where("m is not null").select("dataset", F.lower("model").alias("model"), F.when(whole, score).alias("best_score"),
                                                  F.when(whole, inner).otherwise(F.col("m")).alias("best_params"))
    if dataset is not None:
        nested = nested.where(F.col("dataset") == dataset)
    if model is not None:
        nested = nested.where(F.col("model") == model.lower())
    none = F.lit(None).cast("string")
    single = top.where(whole).select(none.alias("dataset"), none.alias("model"), score.alias("best_score"), inner.alias("best_params"))
    if dataset is not None or model is not None:
        single = single.join(nested.limit(1).select(F.lit(1).alias("_listed")), F.lit(True), "left_anti")
    return nested.unionByName(single)


def write_tuning_summary(best: DataFrame, path: str) -> None:
    """CSV with JSON-encoded parameter cells, partitioned by dataset."""
    best.select("dataset", "model", "best_score", F.to_json("best_params").alias("best_params")) \
        .write.mode("overwrite").partitionBy("dataset").option("header", True).csv(path)


def write_tuning_json(best: DataFrame, path: str) -> None:
    """Tuning results (dataset, model, best_score, best_params, and ``all_scores`` if
    there) as JSON documents: ``path/all`` holds one, dataset -> model -> entry, and
    ``path/by_dataset/dataset=<name>`` each dataset's, model -> entry. As large as
    the list of tuned models; ``read_best_params`` reads ``path/all``."""
    entry = F.struct(*[c for c in ("best_score", "all_scores", "best_params") if c in best.columns])
    models = best.groupBy("dataset").agg(F.map_from_entries(F.sort_array(F.collect_list(
        F.struct("model", F.to_json(entry).alias("entry"))))).alias("models"))
    # Entries are JSON already: documents are put together as text.
    def document(m) -> Column:
        one = F.transform(F.map_entries(m), lambda e: F.concat(_json_text(e["key"]), F.lit(": "), e["value"]))
        return F.concat(F.lit("{"), F.array_join(one, ", "), F.lit("}"))

    models = models.select("dataset", document("models").alias("value"))
    models.write.mode("overwrite").partitionBy("dataset").text(f"{path}/by_dataset")
    whole = models.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("dataset", "value")))).alias("m"))
    whole.select(document("m").alias("value")).write.mode("overwrite").text(f"{path}/all")


def _json_text(c: Column) -> Column:
    """A string column as a quoted JSON string."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'^\{"v":(.*)\}$', 1)


def write_csv(df: DataFrame, path: str) -> None:
    """Importance / summary tables as CSV with a header."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_feature_snapshot(df: DataFrame, path: str, label: str, fmt: str = "parquet") -> None:
    """Features and target (renamed ``target``) as one table."""
    out = df.withColumnRenamed(label, "target")
    (out.write.mode("overwrite").option("header", True).format(fmt).save(path))


# Fixed value: the file-name suffix of per-dataset summary tables.
SUMMARY_SUFFIX = "_test_summary.csv"


def read_summaries(spark: SparkSession, paths) -> DataFrame:
    """Per-dataset summary CSVs (files, or Spark CSV folders) as one table;
    a missing ``dataset`` column is taken from the file or folder name
    without the ``_test_summary.csv`` suffix."""
    df = spark.read.option("header", True).csv(paths)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)_test_summary\.csv(/[^/]*)?$", 1)
    if "dataset" not in df.columns:
        df = df.withColumn("dataset", name)
    return df
