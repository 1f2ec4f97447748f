"""Splits and resampling as columns: ``split``, ``fold``, ``run``.

Random draws of the reference become md5 hash orders: a row's position in
``order_hash(key, seed)`` order (ties broken by the key) replaces a shuffled
index. Splits need no position, only the n-th hash of a class: it is found from
a histogram of the hashes and one bucket of them, and compared with in a map-only
pass, so no full row is shuffled. Folds need each row's position, which comes
from the bucketed running sum, so that a class holding a third of all rows still
spreads over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import ORDER_HASH_BITS, hash_fraction, order_hash
from ..functions.running import running_sums
from ..session import discard, reuse

_H = "_h"
# Buckets of the hash order that a cut is looked for in, as a power of two.
CUT_BITS = 16


def hash_split(df: DataFrame, cols: Sequence[str], threshold: float = 0.5,
               out: str = "split", validate: bool = False, min_rows: int = 10) -> DataFrame:
    """train where md5(values joined by '||') as a fraction is < threshold."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"the split hashes columns that the table does not have: {missing}")
    res = df.withColumn(out, F.when(hash_fraction(cols) < F.lit(threshold), F.lit("train"))
                        .otherwise(F.lit("test")))
    if validate:
        counts = {r[out]: r["n"] for r in res.groupBy(out).agg(F.count(F.lit(1)).alias("n")).collect()}
        if counts.get("train", 0) < min_rows or counts.get("test", 0) < min_rows:
            raise ValueError(f"a side of the split has fewer than {min_rows} rows: {counts}")
    return res


def hash_rank(df: DataFrame, key_cols: Sequence[str], seed: int | str = 42,
              groups: Sequence[str] = (), out: str = "rank",
              seed_col: str | None = None, tie_cols: Sequence[str] = ()) -> DataFrame:
    """1-based position of each row in md5-hash order within ``groups``.

    Order: hash(key), then the key columns, then ``tie_cols`` (for tables
    whose key is not unique). ``seed_col`` (e.g. a run id) adds a per-row
    seed offset so exploded repeats get independent orders.
    """
    seed_parts = [F.col(seed_col)] if seed_col else []
    h = order_hash([*seed_parts, *key_cols], int(seed))
    keyed = df.withColumn(_H, h).withColumn("_one", F.lit(1))
    ranked = running_sums(keyed, _H, ["_one"], groups, prefix="_rk",
                          key_range=(0.0, float(2 ** ORDER_HASH_BITS)),
                          tie_cols=[*key_cols, *tie_cols])
    return ranked.withColumnRenamed("_rk_one", out).drop(_H, "_one")


def class_allocation(df: DataFrame, label: str, test_size: float,
                     groups: Sequence[str] = ()) -> DataFrame:
    """Test rows per class: the overall test size ceil(f*n) spread over
    classes by floor of the proportional share, then one extra row to the
    classes with the largest remainders (ties: smaller class value first)."""
    counts = df.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n_class"))
    return _allocate(counts, label, test_size, groups)


def _allocate(counts: DataFrame, label: str, test_size: float, groups: Sequence[str]) -> DataFrame:
    w_all = Window.partitionBy(*groups)
    n = F.sum("n_class").over(w_all)
    n_test = F.ceil(F.lit(float(test_size)) * n)
    cont = F.col("n_class") * F.col("_n_test") / F.col("_n")
    alloc = (counts.withColumn("_n", n).withColumn("_n_test", n_test)
             .withColumn("_floor", F.floor(cont))
             .withColumn("_rem", cont - F.col("_floor")))
    need = F.col("_n_test") - F.sum("_floor").over(w_all)
    order = Window.partitionBy(*groups).orderBy(F.col("_rem").desc(), F.col(label))
    alloc = alloc.withColumn("_need", need).withColumn("_pos", F.row_number().over(order))
    return alloc.select(*groups, label, "n_class",
                        (F.col("_floor") + F.when(F.col("_pos") <= F.col("_need"), 1).otherwise(0))
                        .cast("long").alias("n_test_class"))


def _first_in_order(df: DataFrame, on: Sequence[str], key_cols: Sequence[str], seed: int, seed_col: str | None,
                    tie_cols: Sequence[str], wanted) -> tuple[DataFrame, Column]:
    """``df`` and a flag: is the row among the first of its class (``on``) in hash
    order? ``wanted`` turns the class counts (on, ``n_class``) into (on, ``_want``).

    1. a histogram of the hashes' leading bits per class, in one narrow scan;
    2. its running sums tell the bucket that holds the wanted position;
    3. only that bucket's hashes and keys are ordered, for the exact cut;
    4. rows compare themselves with their class's cut, one row a class: Spark
       broadcasts that table if its written size allows.
    """
    ties = [*key_cols, *tie_cols]
    seeds = [F.col(seed_col)] if seed_col else []
    h = order_hash([*seeds, *key_cols], int(seed))
    order = F.struct(h.alias("h"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(ties)])
    names = [f"_on{i}" for i in range(len(on))]
    narrow = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(on, names, strict=True)], order.alias("_order"))
    narrow = narrow.withColumn("_bucket", F.shiftright("_order.h", ORDER_HASH_BITS - CUT_BITS).cast("int"))
    counts = reuse(narrow.groupBy(*names, "_bucket").agg(F.count(F.lit(1)).alias("n")))
    back = counts.groupBy(*names).agg(F.sum("n").alias("n_class"))
    want = wanted(back.select(*[F.col(n).alias(c) for n, c in zip(names, on, strict=True)], "n_class"))
    want = want.select(*[F.col(f"`{c}`").alias(f"_w{i}") for i, c in enumerate(on)], "_want")
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*names).orderBy("_bucket")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = counts.withColumn("_before", before)
    hit = sums.join(want, _same(sums, names, want, "_w")).where("_before < _want and _want <= _before + n")
    hit = reuse(hit.select(*[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)], F.col("_bucket").alias("_cb"),
                           (F.col("_want") - F.col("_before")).alias("_nth")))
    inside = narrow.join(hit, _same(narrow, names, hit, "_c") & (narrow["_bucket"] == hit["_cb"]))
    nth = F.row_number().over(Window.partitionBy(*names).orderBy("_order"))
    cut = reuse(inside.withColumn("_n", nth).where("_n = _nth").select(
        *[F.col(n).alias(f"_c{i}") for i, n in enumerate(names)], F.col("_order").alias("_cut")))
    discard(counts, hit)
    joined = df.join(cut, _same(df, on, cut, "_c"), "left").drop(*[f"_c{i}" for i in range(len(on))])
    return joined, F.coalesce(order <= F.col("_cut"), F.lit(False))


def _same(left: DataFrame, cols: Sequence[str], right: DataFrame, prefix: str) -> Column:
    """Null-safe equality of ``cols`` with ``prefix0``, ``prefix1``, ...; rows
    with a null label or group are a class of their own."""
    return reduce(and_, [left[f"`{c}`"].eqNullSafe(right[f"{prefix}{i}"]) for i, c in enumerate(cols)], F.lit(True))


def stratified_split(df: DataFrame, label: str, key_cols: Sequence[str],
                     test_size: float = 0.2, seed: int = 42, out: str = "split",
                     groups: Sequence[str] = (), seed_col: str | None = None,
                     tie_cols: Sequence[str] = ()) -> DataFrame:
    """Class-proportional train/test: the first n_test rows of each class in
    hash order are test. Rows alike in ``key_cols`` and ``tie_cols`` share a side."""
    def wanted(counts: DataFrame) -> DataFrame:
        return _allocate(counts, label, test_size, groups).withColumnRenamed("n_test_class", "_want")

    joined, first = _first_in_order(df, [*groups, label], key_cols, seed, seed_col, tie_cols, wanted)
    return joined.withColumn(out, F.when(first, F.lit("test")).otherwise(F.lit("train"))).drop("_cut")


def stratified_kfold(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 5,
                     seed: int = 42, out: str = "fold", groups: Sequence[str] = (),
                     seed_col: str | None = None, tie_cols: Sequence[str] = ()) -> DataFrame:
    """fold = (position in class, hash order) mod k: class-balanced folds."""
    ranked = hash_rank(df, key_cols, seed, [*groups, label], "_rank", seed_col, tie_cols)
    return ranked.withColumn(out, ((F.col("_rank") - 1) % k).cast("int")).drop("_rank")


def repeated_stratified_kfold(df: DataFrame, label: str, key_cols: Sequence[str], k: int = 5,
                              repeats: int = 2, seed: int = 42,
                              tie_cols: Sequence[str] = ()) -> DataFrame:
    """Rows x repeats (``repeat`` column), each repeat its own fold order."""
    ex = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    return stratified_kfold(ex, label, key_cols, k, seed, groups=["repeat"], seed_col="repeat",
                            tie_cols=tie_cols)


def random_holdout(df: DataFrame, key_cols: Sequence[str], fraction: float, seed: int = 42,
                   out: str = "holdout", tie_cols: Sequence[str] = ()) -> DataFrame:
    """Flag int(n * fraction) rows (first in hash order) as holdout; rows alike in
    ``key_cols`` and ``tie_cols`` share a side."""
    def wanted(counts: DataFrame) -> DataFrame:
        return counts.select(F.floor(F.col("n_class") * F.lit(float(fraction))).alias("_want"))

    joined, first = _first_in_order(df, [], key_cols, seed, None, tie_cols, wanted)
    return joined.withColumn(out, first).drop("_cut")


def repeated_splits(df: DataFrame, label: str, key_cols: Sequence[str], n_runs: int = 10,
                    test_size: float = 0.2, seed: int = 42,
                    tie_cols: Sequence[str] = ()) -> DataFrame:
    """Rows x runs: a stratified split per run, seed offset by the run id."""
    ex = df.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(n_runs - 1))))
    return stratified_split(ex, label, key_cols, test_size, seed, groups=["run"], seed_col="run",
                            tie_cols=tie_cols)


def per_fold_scale(df: DataFrame, fold: str, cols: Sequence[str]) -> DataFrame:
    """Scale each row with mean / population std fitted on the *other* folds.

    One pass gives each fold's count, mean and sum of squared deviations; a
    fold's statistics merge those of the others (a table of k rows, joined
    back on ``fold``), so large offsets don't cancel. A null fold is one fold.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"_mean_{c}"), F.var_pop(x).alias(f"_var_{c}"), F.count(x).alias(f"_n_{c}")]
    per = df.groupBy(F.col(fold).alias("_fold")).agg(*aggs)
    rows = per.withColumn("_all", F.collect_list(F.struct(*per.columns)).over(Window.partitionBy()))
    others = F.filter("_all", lambda r: ~r["_fold"].eqNullSafe(F.col("_fold")))
    rows = rows.withColumn("_all", others)
    stats = [F.col("_fold")]
    for c in cols:
        def total(f):
            return F.aggregate("_all", F.lit(0.0), lambda acc, r: acc + F.coalesce(f(r), F.lit(0.0)))

        n = total(lambda r, c=c: r[f"_n_{c}"].cast("double"))
        mean = total(lambda r, c=c: r[f"_n_{c}"] * r[f"_mean_{c}"]) / F.nullif(n, F.lit(0.0))
        rows = rows.withColumn(f"_m_{c}", mean)
        square = total(lambda r, c=c: r[f"_n_{c}"] * (r[f"_var_{c}"] + F.pow(r[f"_mean_{c}"] - F.col(f"_m_{c}"), F.lit(2.0))))
        std = F.sqrt(square / F.nullif(n, F.lit(0.0)))
        stats += [F.col(f"_m_{c}"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias(f"_sd_{c}")]
    st = rows.select(*stats)
    j = df.join(F.broadcast(st), df[fold].eqNullSafe(st["_fold"])).drop("_fold")  # one row per fold
    return j.select(*[c for c in df.columns if c not in cols],
                    *[((F.col(c) - F.col(f"_m_{c}")) / F.col(f"_sd_{c}")).alias(c) for c in cols])
