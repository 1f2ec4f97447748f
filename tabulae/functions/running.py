"""Bucketed running sums: the shared primitive behind ranks, curves and splits.

A window ordered over a whole group puts the group in one task. Here the
order key is cut into range buckets first:

1. each row gets a bucket id that is monotone in the key (uniform keys:
   arithmetic; other numeric keys: bounds from ``approxQuantile``, applied
   with ``Bucketizer``'s binary search);
2. per (group, bucket) totals form a small table whose exclusive running
   sum (a window over at most ``n_buckets`` rows per group) is the offset;
3. the running sum inside each (group, bucket) is a window partitioned by
   (group, bucket), so work spreads over groups x buckets tasks;
4. offset + in-bucket sum gives the exact global running sum.

Callers aggregate to one row per (group, key) before calling, so a hot key
value is a single row and cannot skew a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BUCKET = "_rs_bucket"


def default_buckets(df: DataFrame) -> int:
    """Range buckets per group: a few per shuffle partition."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    return max(4, 4 * parts)


def _bucketed(df: DataFrame, key: str, n_buckets: int,
              key_range: tuple[float, float] | None) -> DataFrame:
    if key_range is not None:
        lo, hi = key_range
        width = (float(hi) - float(lo)) / n_buckets
        b = F.floor((F.col(key).cast("double") - F.lit(float(lo))) / F.lit(width))
        return df.withColumn(_BUCKET, F.least(F.greatest(b, F.lit(0)), F.lit(n_buckets - 1)).cast("int"))
    probs = [i / n_buckets for i in range(1, n_buckets)]
    # Statistics only: n_buckets-1 doubles reach the driver.
    bounds = df.approxQuantile(key, probs, 1.0 / (8 * n_buckets)) if probs else []
    uniq = sorted({float(b) for b in bounds if b is not None})
    splits = [float("-inf"), *uniq, float("inf")]
    if len(splits) < 3:
        return df.withColumn(_BUCKET, F.lit(0))
    tmp = f"{_BUCKET}_in"
    out = Bucketizer(splits=splits, inputCol=tmp, outputCol=_BUCKET, handleInvalid="keep").transform(
        df.withColumn(tmp, F.col(key).cast("double")))
    return out.drop(tmp).withColumn(_BUCKET, F.col(_BUCKET).cast("int"))


def running_sums(df: DataFrame, key: str, sum_cols: Sequence[str],
                 group_cols: Sequence[str] = (), prefix: str = "cum_",
                 n_buckets: int | None = None,
                 key_range: tuple[float, float] | None = None,
                 tie_cols: Sequence[str] = (), totals_prefix: str | None = None) -> DataFrame:
    """Add ``prefix + c``: inclusive running sum of ``c`` in ascending ``key``
    order within ``group_cols``; with ``totals_prefix`` also the group's total,
    from the same bucket sums.

    ``df`` should hold one row per (group, key) -- or be ordered by
    ``key`` then ``tie_cols``, which must make the order total.
    ``key_range`` declares the key uniform on [lo, hi) (hash keys).
    """
    nb = n_buckets or default_buckets(df)
    keyed = _bucketed(df, key, nb, key_range)
    gb = [*group_cols, _BUCKET]

    totals = keyed.groupBy(*gb).agg(*[F.sum(c).alias(c) for c in sum_cols])
    w_off = (Window.partitionBy(*group_cols).orderBy(_BUCKET)
             .rowsBetween(Window.unboundedPreceding, -1))
    tots = {c: f"{totals_prefix}{c}" for c in sum_cols} if totals_prefix else {}
    whole = Window.partitionBy(*group_cols)
    offsets = totals.select(*gb, *[F.coalesce(F.sum(c).over(w_off), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
                            *[F.sum(c).over(whole).alias(t) for c, t in tots.items()])

    w_in = (Window.partitionBy(*gb).orderBy(key, *tie_cols)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    inner = keyed.select("*", *[F.sum(c).over(w_in).alias(f"_in_{c}") for c in sum_cols])
    cond = [inner[g].eqNullSafe(offsets[g]) for g in gb]
    joined = inner.join(offsets, cond, "inner").select(
        inner["*"], *[offsets[f"_off_{c}"] for c in sum_cols], *[offsets[t] for t in tots.values()])
    out = joined.select(
        *[c for c in joined.columns if not c.startswith(("_in_", "_off_")) and c != _BUCKET],
        *[(F.col(f"_off_{c}") + F.col(f"_in_{c}")).alias(prefix + c) for c in sum_cols])
    return out


def group_totals(df: DataFrame, sum_cols: Sequence[str], group_cols: Sequence[str] = (),
                 prefix: str = "tot_") -> DataFrame:
    """Attach per-group totals via a small aggregate joined back on the keys."""
    tot = df.groupBy(*group_cols).agg(*[F.sum(c).alias(prefix + c) for c in sum_cols])
    if not group_cols:
        # A global aggregate is exactly one row: a bounded broadcast.
        one = F.lit(1)
        return (df.withColumn("_one", one)
                .join(F.broadcast(tot.withColumn("_one", one)), "_one").drop("_one"))
    cond = [df[g].eqNullSafe(tot[g]) for g in group_cols]
    return df.join(tot, cond, "inner").select(df["*"], *[tot[prefix + c] for c in sum_cols])
