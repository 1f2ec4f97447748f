"""Feature preparation: rare-category bucketing, encoding, scaling, noise,
mix-up, label smoothing, row/feature caps, samples.

Statistics are fitted with one aggregation (per column counts, moments,
landmarks) and applied with a join or a broadcast one-row table; nothing
row-level leaves the executors.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ORDER_HASH_BITS, order_hash, unit_uniform
from ..functions.normal import norm_ppf

# The rare-category share, its replacement, the null
# category spelling, the quantile clip bound and the teacher log epsilon.
RARE_SHARE = 0.01
RARE_VALUE = "other"
NULL_CATEGORY = "nan"
QUANTILE_BOUND = 1e-7
LOG_EPS = 1e-10


def _one_row_join(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a single-row statistics table (a bounded broadcast)."""
    k = "_one_row_key"
    return df.withColumn(k, F.lit(1)).join(F.broadcast(one_row.withColumn(k, F.lit(1))), k).drop(k)


def value_frequency(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count"))


def bucket_rare(df: DataFrame, cols: Sequence[str], min_share: float = RARE_SHARE,
                other: str = RARE_VALUE) -> DataFrame:
    """Categories with count strictly below ``min_share`` of all rows become
    ``other``; nulls count in the total and are never rare."""
    total = df.groupBy().agg(F.count(F.lit(1)).alias("_total"))
    out = df
    for c in cols:
        counts = (df.where(F.col(c).isNotNull()).groupBy(c)
                  .agg(F.count(F.lit(1)).alias("_cnt")))
        rare = (_one_row_join(counts, total)
                .where(F.col("_cnt") < F.lit(float(min_share)) * F.col("_total"))
                .select(F.col(c).alias("_rare_value"), F.lit(True).alias("_is_rare")))
        out = (out.join(rare, out[c] == rare["_rare_value"], "left")
               .withColumn(c, F.when(F.col("_is_rare"), F.lit(other)).otherwise(F.col(c)))
               .drop("_rare_value", "_is_rare"))
    return out


# Largest category count whose label list may pass through the driver
# (StringIndexer keeps it there and ships it to every task).
MAX_DRIVER_LABELS = 100_000


def label_encode(df: DataFrame, cols: Sequence[str], suffix: str = "",
                 max_driver_labels: int = MAX_DRIVER_LABELS) -> DataFrame:
    """Code = 0-based position among the column's sorted distinct strings;
    nulls become the category 'nan'.

    Columns whose (approximate) distinct count is within
    ``max_driver_labels`` use Spark ML ``StringIndexer`` (alphabetical);
    larger ones are ranked on the executors (``distributed_codes``) and
    joined back, so no unbounded label list reaches the driver.
    """
    from pyspark.ml.feature import StringIndexer

    tmp = {c: f"_le_in_{c}" for c in cols}
    outs = {c: f"_le_out_{c}" for c in cols}
    staged = df.select("*", *[F.coalesce(F.col(c).cast("string"), F.lit(NULL_CATEGORY)).alias(tmp[c])
                              for c in cols])
    approx = staged.agg(*[F.approx_count_distinct(tmp[c], 0.05).alias(c) for c in cols]).first()
    small = [c for c in cols if approx[c] <= max_driver_labels / 1.2]
    large = [c for c in cols if c not in small]
    enc = staged
    if small:
        model = StringIndexer(inputCols=[tmp[c] for c in small], outputCols=[outs[c] for c in small],
                              stringOrderType="alphabetAsc", handleInvalid="keep").fit(staged)
        enc = model.transform(staged)
    for c in large:
        codes = distributed_codes(staged.select(F.col(tmp[c]).alias("_v")), "_v")
        enc = enc.join(codes.select(F.col("_v").alias(tmp[c]), F.col("_code").alias(outs[c])), tmp[c], "left")
    return enc.select(*[c for c in df.columns if not (c in cols and not suffix)],
                      *[F.col(outs[c]).cast("long").alias(c + suffix) for c in cols])


def distributed_codes(values: DataFrame, col: str) -> DataFrame:
    """(value, _code): dense 0-based rank of the distinct values, computed
    without a global window. Distinct values are range-partitioned and the
    partition ids are materialised (so the sampled bounds are fixed); the
    per-partition counts (one row per partition) give offsets, and a window
    inside each partition gives the local rank."""
    from pyspark.sql import Window

    from ..session import reuse

    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))
    ranged = reuse(values.select(col).distinct().repartitionByRange(n, col)
                   .withColumn("_pid", F.spark_partition_id()))
    sizes = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_pid").orderBy(col)) - 1
    return (ranged.join(F.broadcast(offsets), "_pid")  # one row per partition: bounded
            .select(col, (F.col("_off") + local).cast("long").alias("_code")))


def encode_target(df: DataFrame, label: str) -> DataFrame:
    """Encode a text/category target the same way; numeric targets stay."""
    if dict(df.dtypes)[label] == "string":
        return label_encode(df, [label])
    return df


def double_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Compatibility: encode, then encode the codes again as strings."""
    return label_encode(label_encode(df, cols), cols)


def standard_scale(df: DataFrame, cols: Sequence[str], fit_where: Column | None = None) -> DataFrame:
    """(x - mean) / population std, fitted on ``fit_where`` rows (train),
    applied to all rows; zero-variance columns are only centred."""
    fit = df.where(fit_where) if fit_where is not None else df
    stats = fit.groupBy().agg(*[x for c in cols for x in (
        F.avg(F.col(c).cast("double")).alias(f"_m_{c}"),
        F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}"))])
    j = _one_row_join(df, stats)
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) /
              F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)) for c in cols}
    return j.select(*[scaled[c].alias(c) if c in scaled else F.col(c) for c in df.columns])


def quantile_landmarks(df: DataFrame, cols: Sequence[str], n_quantiles: int = 1000,
                       accuracy: int = 100000) -> dict[str, list[float]]:
    """Landmarks at evenly spaced percentiles (a bounded sketch per column);
    the reference also fits on a subsample, so sketch accuracy suffices."""
    probs = [i / (n_quantiles - 1) for i in range(n_quantiles)]
    row = df.groupBy().agg(*[F.percentile_approx(F.col(c).cast("double"), probs, accuracy).alias(c)
                             for c in cols]).first()
    return {c: [float(v) for v in row[c]] for c in cols}


def _unique_landmarks(landmarks: list[float]) -> tuple[list[float], list[float]]:
    """Unique landmark values and their reference CDF positions; repeated
    landmarks take the middle of their positions."""
    n = len(landmarks)
    refs: dict[float, list[float]] = {}
    for i, v in enumerate(landmarks):
        refs.setdefault(v, []).append(i / (n - 1))
    xs = sorted(refs)
    return xs, [(min(refs[v]) + max(refs[v])) / 2.0 for v in xs]


def quantile_normal_scale(df: DataFrame, cols: Sequence[str], fit_where: Column | None = None,
                          n_quantiles: int = 1000) -> DataFrame:
    """Map each column to N(0,1) through its training empirical CDF.

    The interval of each value among the (bounded) landmarks is found by
    ``Bucketizer``'s binary search; the CDF is linear between landmarks,
    then clipped and sent through the normal quantile expression.
    """
    from pyspark.ml.feature import Bucketizer

    fit = df.where(fit_where) if fit_where is not None else df
    lms = quantile_landmarks(fit, cols, n_quantiles)
    staged = df
    ins, outs, splits, uniq = [], [], [], {}
    for c in cols:
        xs, ys = _unique_landmarks(lms[c])
        uniq[c] = (xs, ys)
        if len(xs) >= 3:
            ins.append(f"_qn_in_{c}")
            outs.append(f"_qn_b_{c}")
            splits.append([float("-inf"), *xs[1:-1], float("inf")])
            staged = staged.withColumn(f"_qn_in_{c}", F.col(c).cast("double"))
    if ins:
        staged = Bucketizer(splitsArray=splits, inputCols=ins, outputCols=outs,
                            handleInvalid="keep").transform(staged)
    out = {}
    for c in cols:
        xs, ys = uniq[c]
        x = F.col(c).cast("double")
        if len(xs) == 1:
            u = F.when(x < F.lit(xs[0]), 0.0).when(x > F.lit(xs[0]), 1.0).otherwise(ys[0])
        else:
            idx = (F.col(f"_qn_b_{c}").cast("int") + 1) if len(xs) >= 3 else F.lit(1)
            ax, ay = F.array(*[F.lit(v) for v in xs]), F.array(*[F.lit(v) for v in ys])
            x0, x1 = F.element_at(ax, idx), F.element_at(ax, idx + 1)
            y0, y1 = F.element_at(ay, idx), F.element_at(ay, idx + 1)
            u = (F.when(x <= F.lit(xs[0]), F.lit(0.0)).when(x >= F.lit(xs[-1]), F.lit(1.0))
                 .otherwise(y0 + (x - x0) / (x1 - x0) * (y1 - y0)))
        u = F.least(F.greatest(u, F.lit(QUANTILE_BOUND)), F.lit(1.0 - QUANTILE_BOUND))
        out[c] = norm_ppf(u)
    return staged.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def gaussian_noise(df: DataFrame, cols: Sequence[str], sigma: float, seed: int,
                   key_cols: Sequence[str]) -> DataFrame:
    """x + sigma * z, z ~ N(0,1) by Box-Muller over per-(row, column) hashes:
    reproducible under task retries, unlike ``randn``."""
    out = {}
    for c in cols:
        u1 = unit_uniform(key_cols, seed, salt=f"{c}:1")
        u2 = unit_uniform(key_cols, seed, salt=f"{c}:2")
        z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)
        out[c] = F.col(c) + F.lit(float(sigma)) * z
    return df.select(*[out[c].alias(c) if c in out else F.col(c) for c in df.columns])


def smooth_labels(label: str | Column, n_classes: int, eps: float) -> Column:
    """(1 - eps) * onehot(label) + eps / K as an array column."""
    y = F.col(label) if isinstance(label, str) else label
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)),
                       lambda k: F.when(k == y.cast("int"), F.lit(1.0 - eps)).otherwise(F.lit(0.0))
                       + F.lit(eps / n_classes))


def teacher_logits(proba: str | Column) -> Column:
    """log(p + 1e-10) per class."""
    p = F.col(proba) if isinstance(proba, str) else proba
    return F.transform(p, lambda x: F.log(x + F.lit(LOG_EPS)))


def hash_sample(df: DataFrame, n: int, key_cols: Sequence[str], seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows without replacement: the first n rows in
    hash order. A count sizes a hash pre-filter so the final top-n merge
    sees about n rows per task instead of n per input partition; if the
    filter keeps fewer than n rows the unfiltered top-n runs instead."""
    h = order_hash(key_cols, seed)
    total = df.count()
    if total <= n:
        return df
    keep = min(1.0, (n + 10.0 * math.sqrt(n) + 100.0) / total)
    cut = int(keep * 2 ** ORDER_HASH_BITS)
    keyed = df.withColumn("_sh", h)
    pre = keyed.where(F.col("_sh") < F.lit(cut))
    src = pre if keep >= 1.0 or pre.count() >= n else keyed
    return src.orderBy("_sh", *key_cols).limit(n).drop("_sh")


def hash_sample_sql_order(key_cols: Sequence[str], seed: int = 42) -> str:
    from ..functions.hashing import order_hash_sql
    return order_hash_sql(key_cols, seed) + ", " + ", ".join(key_cols)


def cap_training_sample(df: DataFrame, feature_cols: Sequence[str], key_cols: Sequence[str],
                        max_rows: int = 10000, max_features: int = 100, seed: int = 42) -> DataFrame:
    """Keep at most ``max_rows`` rows (hash sample) and the first
    ``max_features`` feature columns."""
    keep_feats = list(feature_cols)[:max_features]
    rest = [c for c in df.columns if c not in feature_cols]
    return hash_sample(df, max_rows, key_cols, seed).select(*rest, *keep_feats)


def select_top_features(importance: DataFrame, k: int, feature: str = "feature",
                        value: str = "importance") -> list[str]:
    """Names of the k most important features (ties by name)."""
    rows = importance.orderBy(F.col(value).desc(), F.col(feature)).limit(k).collect()
    return [r[feature] for r in rows]


def mixup(df: DataFrame, feature_cols: Sequence[str], label: str, key_cols: Sequence[str],
          alpha: float, n_classes: int = 2, batch_size: int = 256, seed: int = 42) -> DataFrame:
    """Mix each row with a partner from its hash-ordered batch.

    Rows get a position in hash order; batch = position // batch_size and the
    partner is the row ``shift`` places later in the same batch (cyclic), an
    equi-join on (batch, slot). One lambda ~ Beta(alpha, alpha) per batch
    (1 when alpha <= 0), drawn in an Arrow UDF seeded by (seed, batch).
    Output keeps both labels and the mixed soft label.
    """
    from .split import hash_rank

    ranked = hash_rank(df, key_cols, seed, (), "_pos")
    ranked = (ranked.withColumn("_batch", ((F.col("_pos") - 1) / batch_size).cast("long"))
              .withColumn("_slot", ((F.col("_pos") - 1) % batch_size).cast("long")))
    sizes = ranked.groupBy("_batch").agg(F.count(F.lit(1)).alias("_bn"))
    ranked = ranked.join(sizes, "_batch")
    shift = F.lit(1 + (seed % 7))
    ranked = ranked.withColumn("_pslot", (F.col("_slot") + shift) % F.col("_bn"))
    partner = ranked.select(F.col("_batch").alias("_pb"), F.col("_slot").alias("_ps"),
                            *[F.col(c).alias(f"_p_{c}") for c in feature_cols],
                            F.col(label).alias("_p_label"))
    j = ranked.join(partner, (ranked["_batch"] == partner["_pb"]) & (ranked["_pslot"] == partner["_ps"]))

    @F.pandas_udf("double")
    def batch_lambda(batch: pd.Series) -> pd.Series:
        if alpha <= 0:
            return pd.Series(np.ones(len(batch)))
        uniq = batch.unique()
        lam = {b: float(np.random.default_rng([seed, int(b)]).beta(alpha, alpha)) for b in uniq}
        return batch.map(lam).astype("float64")

    j = j.withColumn("lam", batch_lambda(F.col("_batch")))
    mixed = [(F.col("lam") * F.col(c) + (1 - F.col("lam")) * F.col(f"_p_{c}")).alias(c) for c in feature_cols]
    soft = F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: (
        F.col("lam") * (k == F.col(label).cast("int")).cast("double")
        + (1 - F.col("lam")) * (k == F.col("_p_label").cast("int")).cast("double")))
    keep = [c for c in df.columns if c not in feature_cols]
    return j.select(*keep, *mixed, F.col("_p_label").alias("label_b"), "lam", soft.alias("soft_label"))
