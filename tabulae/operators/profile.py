"""Profiling: describe, class distribution, correlations, dataset info,
target detection.

``describe_table`` computes exact quartiles without collecting a column
into one task: values are unpivoted to (column, value), collapsed to
distinct values with counts, ranked by the bucketed running sum, and each
quantile's two neighbouring order statistics are picked by a conditional
aggregate (linear interpolation, like ``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.running import group_totals, running_sums

# The quartiles reported by describe and the names tried, in
# order, when looking for a target column.
DESCRIBE_QUANTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
TARGET_NAMES = ["target", "Target", "class", "Class", "y", "Y", "label", "Label",
                "fraud", "Fraud", "Outcome", "outcome"]


def long_values(df: DataFrame, cols: Sequence[str], name: str = "column",
                value: str = "value") -> DataFrame:
    """Unpivot numeric columns to (column, value) as doubles."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), name, value)


def exact_quantiles(long: DataFrame, quantiles: dict[str, float], group: str = "column",
                    value: str = "value") -> DataFrame:
    """Exact linear-interpolated quantiles per group (nulls ignored)."""
    vals = long.where(F.col(value).isNotNull())
    counts = vals.groupBy(group, value).agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(counts, value, ["cnt"], [group])
    cum = group_totals(cum, ["cnt"], [group])
    # 0-based order statistics covered by this distinct value: [cum-cnt, cum)
    lo_rank = F.col("cum_cnt") - F.col("cnt")
    hi_rank = F.col("cum_cnt")
    aggs = []
    for name, q in quantiles.items():
        pos = F.lit(float(q)) * (F.col("tot_cnt") - 1)
        k_lo, k_hi = F.floor(pos), F.ceil(pos)
        v_lo = F.max(F.when((lo_rank <= k_lo) & (k_lo < hi_rank), F.col(value)))
        v_hi = F.max(F.when((lo_rank <= k_hi) & (k_hi < hi_rank), F.col(value)))
        frac = F.max(pos - k_lo)
        aggs.append((v_lo + frac * (v_hi - v_lo)).alias(name))
    return cum.groupBy(group).agg(*aggs)


def describe_table(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: count, mean, sample std, min, quartiles, max (long rows)."""
    long = long_values(df, cols)
    # The mean is summed as DECIMAL(38,10): exact and independent of the
    # summation order for decimal-valued data (falls back to the double
    # average if the decimal sum would overflow).
    dec = F.try_sum(F.col("value").try_cast("decimal(38,10)") if hasattr(F.col("value"), "try_cast")
                    else F.expr("try_cast(value AS DECIMAL(38,10))"))
    exact_mean = dec.cast("double") / F.count("value").cast("double")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.coalesce(exact_mean, F.avg("value")).alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"))
    qs = exact_quantiles(long, DESCRIBE_QUANTILES)
    return moments.join(qs, "column", "left").select(
        "column", "count", "mean", "std", "min", *DESCRIBE_QUANTILES, "max")


def class_distribution(df: DataFrame, label: str) -> DataFrame:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    return group_totals(counts, ["count"]).select(
        label, "count", (F.col("count") / F.col("tot_count")).alias("share"))


# Columns of a block of cross products, and tasks' sums that are merged at a time.
GRAM_BLOCK, GRAM_FAN_IN = 64, 32


@dataclass
class CrossSums:
    """Sums over the rows in which both of two columns have a value, for a block
    of columns a by a block of columns b: how many, of a, of b, of their
    squares and of their products, all as differences from ``centre``."""

    centre: tuple[np.ndarray, np.ndarray]
    n: np.ndarray
    a: np.ndarray
    b: np.ndarray
    aa: np.ndarray
    bb: np.ndarray
    ab: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray, centre: tuple[np.ndarray, np.ndarray]) -> CrossSums:
        (x, m), (y, k) = ((np.where(np.isnan(v), 0.0, v - c), (~np.isnan(v)).astype(float)) for v, c in zip((x, y), centre))
        return cls(centre, m.T @ k, x.T @ k, m.T @ y, (x * x).T @ k, m.T @ (y * y), x.T @ y)

    def moved(self, centre: tuple[np.ndarray, np.ndarray]) -> CrossSums:
        """The same sums from another centre."""
        p, q = (self.centre[0] - centre[0])[:, None], (self.centre[1] - centre[1])[None, :]
        return CrossSums(centre, self.n, self.a + self.n * p, self.b + self.n * q, self.aa + 2 * p * self.a + self.n * p * p,
                         self.bb + 2 * q * self.b + self.n * q * q, self.ab + p * self.b + q * self.a + self.n * p * q)

    def plus(self, other: CrossSums) -> CrossSums:
        o = other.moved(self.centre)
        return CrossSums(self.centre, self.n + o.n, self.a + o.a, self.b + o.b, self.aa + o.aa, self.bb + o.bb, self.ab + o.ab)

    def correlation(self) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            u, v = self.n * self.aa - self.a ** 2, self.n * self.bb - self.b ** 2
            r = (self.n * self.ab - self.a * self.b) / np.sqrt(u * v)
        return np.where((u > 0) & (v > 0), np.clip(r, -1, 1), np.nan)

    def pack(self) -> bytes:
        return b"".join(x.tobytes() for x in (*self.centre, self.n, self.a, self.b, self.aa, self.bb, self.ab))

    @classmethod
    def unpack(cls, data: bytes, p: int, q: int) -> CrossSums:
        x = np.frombuffer(data)
        return cls((x[:p], x[p:p + q]), *x[p + q:].reshape(6, p, q))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every ordered pair (a, b), a != b, long form, over
    the rows in which both have a value (NaN counts as none; null where a column
    does not vary there).

    One scan: every task adds up cross products of its Arrow batches as matrix
    products, block of columns by block of columns, from a centre of its own (so
    large means cost no digits). The blocks' sums are merged ``GRAM_FAN_IN`` tasks
    at a time; what is shuffled is d^2 numbers a task, whatever the rows."""
    names, d = list(cols), len(cols)
    if d < 2:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    starts = list(range(0, d, GRAM_BLOCK))
    width = {i: min(GRAM_BLOCK, d - i) for i in starts}

    def local(batches):
        sums: dict[tuple[int, int], CrossSums] = {}
        centre = np.full(d, np.nan)
        for pdf in batches:
            x = pdf.to_numpy(dtype=float)
            # The first value of each column: a constant one leaves exact zeros.
            first = np.argmax(~np.isnan(x), axis=0) if len(x) else np.zeros(d, int)
            seen = x[first, np.arange(d)] if len(x) else np.full(d, np.nan)
            new = np.where(np.isnan(centre), seen, centre)
            moved, centre = np.isnan(centre) & ~np.isnan(new), new
            at = np.where(np.isnan(centre), 0.0, centre)
            for i in starts:
                for j in starts[starts.index(i):]:
                    p, q = slice(i, i + width[i]), slice(j, j + width[j])
                    part = CrossSums.of(x[:, p], x[:, q], (at[p], at[q]))
                    old = sums.get((i, j))
                    sums[i, j] = part if old is None else part.plus(old) if moved.any() else old.plus(part)
        task = TaskContext.get().partitionId()
        if sums:
            yield pd.DataFrame({"i": [k[0] for k in sums], "j": [k[1] for k in sums], "task": [task] * len(sums),
                                "sums": [x.pack() for x in sums.values()]})

    def merged(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        p, q = width[int(key[0])], width[int(key[1])]
        total = None
        for data in pdf["sums"]:
            part = CrossSums.unpack(data, p, q)
            total = part if total is None else total.plus(part)
        return pd.DataFrame({"i": [key[0]], "j": [key[1]], "task": [key[2]], "sums": [total.pack()]})

    def pairs(batches):
        for pdf in batches:
            for i, j, data in zip(pdf["i"], pdf["j"], pdf["sums"]):
                r = CrossSums.unpack(data, width[i], width[j]).correlation()
                at = [(a, b) for a in range(width[i]) for b in range(width[j]) if i < j or a < b]
                value = np.array([r[a, b] for a, b in at])
                left, right = [names[i + a] for a, _ in at], [names[j + b] for _, b in at]
                if at:
                    yield pd.DataFrame({"a": left + right, "b": right + left, "corr": np.tile(value, 2)})

    values = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(names)])
    schema = "i int, j int, task long, sums binary"
    parts = values.mapInPandas(local, schema)
    tasks = values.rdd.getNumPartitions()
    while tasks > 1:
        parts = parts.withColumn("task", F.expr(f"task div {GRAM_FAN_IN}")).groupBy("i", "j", "task").applyInPandas(merged, schema)
        tasks = -(-tasks // GRAM_FAN_IN)
    return parts.mapInPandas(pairs, "a string, b string, corr double").withColumn(
        "corr", F.nanvl("corr", F.lit(None).cast("double")))


def dataset_info(df: DataFrame, features: Sequence[str], label: str, split: str | None = None) -> DataFrame:
    """One row: sizes, feature kinds (from the schema), class count, split sizes."""
    types = dict(df.dtypes)
    cat = [c for c in features if types[c] == "string"]
    num = [c for c in features if c not in cat]
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct(label).alias("n_classes")]
    if split:
        aggs += [F.sum((F.col(split) == "train").cast("long")).alias("n_train"),
                 F.sum((F.col(split) == "test").cast("long")).alias("n_test")]
    return df.agg(*aggs).select(
        "*", F.lit(len(features)).cast("long").alias("n_features"),
        F.lit(len(cat)).cast("long").alias("n_categorical"),
        F.lit(len(num)).cast("long").alias("n_numerical"))


def target_candidates(df: DataFrame) -> DataFrame:
    """Per column: position, exact distinct non-null count, binary flag and
    whether its name is one of the known target names (one aggregation)."""
    cols = df.columns
    row = df.agg(*[F.count_distinct(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(cols)])
    stacked = F.stack(F.lit(len(cols)), *[
        x for i, c in enumerate(cols) for x in (F.lit(c), F.lit(i).cast("long"), F.col(f"n{i}"))])
    out = row.select(stacked.alias("column", "position", "n_distinct"))
    rank = F.create_map(*[x for i, n in enumerate(TARGET_NAMES) for x in (F.lit(n), F.lit(i))])
    return out.select("*", (F.col("n_distinct") == 2).alias("is_binary"),
                      F.try_element_at(rank, F.col("column")).cast("long").alias("name_rank"))


def binary_columns(df: DataFrame) -> DataFrame:
    """(column, position, is_binary): whether a column has exactly two different
    non-null values. One scan: a task keeps three values of a column at most, as
    that many show that it is not; no exact distinct count, no shuffle of rows.
    Zeros of either sign are one value, all NaNs one; an empty table has none."""
    cols, types = df.columns, dict(df.dtypes)
    def text(c: str) -> Column:
        x = F.col(f"`{c}`")
        return ((x + F.lit(0.0)) if types[c] in ("float", "double") else x).cast("string").alias(f"c{cols.index(c)}")

    def sketch(batches):
        seen: list[dict] = [{} for _ in cols]
        for batch in batches:
            for i, kept in enumerate(seen):
                if len(kept) < 3:
                    for v in batch.column(i).unique().to_pylist():
                        if v is not None and len(kept) < 3:
                            kept[v] = None
        rows = [(i, v) for i, kept in enumerate(seen) for v in kept]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([v for _, v in rows], pa.string())],
                                         ["position", "value"])

    found = (df.select(*[text(c) for c in cols]).mapInArrow(sketch, "position long, value string")
             .groupBy("position").agg(F.count_distinct("value").alias("n")))
    names = df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(cols)], "column string, position long")
    return names.join(found, "position", "left").select(
        "column", "position", F.coalesce(F.col("n") == 2, F.lit(False)).alias("is_binary"))


def detect_target(df: DataFrame) -> tuple[str, str]:
    """Pick the target: first known name in fixed order, else the first
    column with exactly two distinct values, else the last column."""
    for name in TARGET_NAMES:
        if name in df.columns:
            return name, "name"
    cand = binary_columns(df).where("is_binary").orderBy("position").limit(1).collect()
    if cand:
        return cand[0]["column"], "binary"
    return df.columns[-1], "last"
