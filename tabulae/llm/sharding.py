"""Sharding by sampled splitters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tabulae.session import reuse

from .common import hash_order

OVERHEAD = 16
# Fine ranges: so many per shard, more on large inputs so that one range stays
# near RANGE_BYTES; and so many sampled keys per range.
RANGES_PER_SHARD, RANGE_BYTES, SAMPLES = 16, 64 << 20, 8
SPLIT_ROUNDS = 4


def _bucket(splitters: np.ndarray):
    @pandas_udf("int")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(splitters, key.to_numpy(), side="right").astype(np.int32))
    return bucket


def _sampled(rows: DataFrame, share) -> np.ndarray:
    """Sorted keys of rows drawn with a chance in proportion to their size; as
    many as the shares of all rows sum up to, on average."""
    drawn = F.pmod(hash_order(F.struct("__key", "__id")), F.lit(1 << 40)) < share * (1 << 40)
    return np.sort(np.array([r[0] for r in rows.where(drawn).select("__key").collect()], np.int64))


def shard(df: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` and ``size``, ``shard`` and ``slot``.

    Rows are ranged by a key of their text's and then their id's hash, so equal
    texts lie side by side and a group of copies too large for one shard goes on
    in the next. Shards are the ranges between ``n_shards`` - 1 cuts of the
    running size: each holds its share of all bytes to within one row.

    Keys are drawn with a chance in proportion to row size; their quantiles
    split the rows into many more ranges than shards, and a range that came out
    overfull is split by keys drawn from it alone. Only counts and sums per
    range reach the driver; rows are ordered inside a range only.

    ``size`` is the text's UTF-8 bytes (null: none) plus 16; ``slot`` counts a
    shard's rows from 0 without gaps. Rows with equal id and text are one key
    and may change places; null ids come first within their text. Input columns
    with the names of the new ones are replaced; an empty table gives no rows.
    """
    if n_shards < 1:
        raise ValueError("at least one shard is needed")
    df = df.drop("size", "shard", "slot")
    text, id_ = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    key = F.conv(F.concat(F.substring(F.md5(text.cast("binary")), 1, 9), F.substring(F.md5(id_.cast("binary")), 1, 6)), 16, 10)
    rows = df.withColumns({"__key": key.cast("long"), "size": F.octet_length(text).cast("long") + OVERHEAD,
                           "__id": F.col(id_col)})
    narrow = reuse(rows.select("__key", "__id", "size"))
    n, total = narrow.agg(F.count("*"), F.sum("size")).first()
    if not n:
        return rows.drop("__key", "__id").withColumns({"shard": F.lit(0), "slot": F.lit(0).cast("long")})
    n_ranges = max(n_shards * RANGES_PER_SHARD, -(-total // RANGE_BYTES))
    sample = _sampled(narrow, F.col("size") / F.lit(total / (n_ranges * SAMPLES)))
    splitters = np.unique(sample[SAMPLES - 1::SAMPLES])
    for left in range(SPLIT_ROUNDS, -1, -1):
        ranges = (narrow.groupBy(_bucket(splitters)("__key").alias("b"))
                  .agg(F.count("*").alias("n"), F.sum("size").alias("s"), F.min("__key").alias("lo"),
                       F.max("__key").alias("hi")).collect())
        overfull = [r["b"] for r in ranges if r["s"] > 4 * total / n_ranges and r["lo"] < r["hi"]]
        if not overfull or not left:
            break
        inside = narrow.where(_bucket(splitters)("__key").isin(overfull))
        more = _sampled(inside, F.col("size") / F.lit(total / (n_ranges * SAMPLES * 4)))
        splitters = np.unique(np.concatenate([splitters, more[SAMPLES // 2::SAMPLES]]))
    by = {r["b"]: r for r in ranges}
    before_n, before_s, n_sum, s_sum = [], [], 0, 0
    for b in range(len(splitters) + 1):
        before_n.append(n_sum)
        before_s.append(s_sum)
        n_sum, s_sum = n_sum + (by[b]["n"] if b in by else 0), s_sum + (by[b]["s"] if b in by else 0)
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame(  # one row per range
        pd.DataFrame({"__b": np.arange(len(before_n), dtype=np.int32), "__n0": before_n, "__s0": before_s})))

    def placed(frame: DataFrame) -> DataFrame:
        order = Window.partitionBy("__b").orderBy("__key", "__id", "size")
        until = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        frame = (frame.withColumn("__b", _bucket(splitters)("__key")).join(starts, "__b")
                 .withColumns({"__rank": F.col("__n0") + F.row_number().over(order) - 1, "__until": F.col("__s0") + until}))
        # The row's middle byte decides, as a share of all bytes.
        middle = 2 * F.col("__until") - F.col("size")
        return frame.withColumn("shard", F.floor(middle / F.lit(2.0 * total) * n_shards).cast("int"))

    first = {r["shard"]: r["r"] for r in placed(narrow).groupBy("shard").agg(F.min("__rank").alias("r")).collect()}
    starts_at = F.create_map(*[F.lit(x) for pair in sorted(first.items()) for x in pair])
    return (placed(rows).withColumn("slot", F.col("__rank") - starts_at[F.col("shard")])
            .select(*df.columns, "size", "shard", "slot"))
