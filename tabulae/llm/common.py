"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts are taken from Arrow batches in runs of about this many bytes, so a
# task's arrays stay small however many or long the documents of a batch are.
RUN_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, by a path that only Spark opens."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text column; null counts as the empty text."""
    return F.coalesce(text, F.lit("")).cast("binary")


def text_runs(batches: Iterator[pa.RecordBatch], text: str = "text",
              limit: int = RUN_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts hold about ``limit`` bytes together
    (one longer text makes a slice of its own), with their texts."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        start = size = 0
        texts: list[bytes] = []
        for i in range(batch.num_rows):
            value = col[i].as_py() or b""
            if texts and size + len(value) > limit:
                yield batch.slice(start, len(texts)), texts
                start, size, texts = i, 0, []
            texts.append(value)
            size += len(value)
        if texts:
            yield batch.slice(start, len(texts)), texts


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit numbers (splitmix64 steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def in_train(id_col: Column) -> Column:
    """True for rows whose labels may be learned: crc32 of the id, written as
    text, is no multiple of 5."""
    return F.crc32(id_col.cast("string").cast("binary")) % 5 != 0


def hash_order(id_col: Column) -> Column:
    """A fixed pseudo-random order of ids, for bounded samples."""
    return F.xxhash64(id_col, F.lit(7))


def annotate(df: DataFrame, text_col: str, new: list[tuple[str, T.DataType]], make: Callable[[], Callable]) -> DataFrame:
    """All columns of ``df`` and the ``new`` ones (name, type), which
    ``make()(texts)`` gives as Arrow arrays for a run of UTF-8 texts; ``make`` is
    called once per task. Columns of ``df`` with the new names are replaced."""
    df = df.drop(*[name for name, _ in new])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in new]])

    def run(batches: Iterator[pa.RecordBatch]):
        of = make()
        for part, texts in text_runs(batches, "__text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *of(texts)], schema.names)

    return df.withColumn("__text", as_bytes(F.col(text_col))).mapInArrow(run, schema)
