"""Experiment ledger: grid, skip logic, flattening, formatted summary tables,
experiment ids and parameter merges -- all as DataFrame operations over a
long results table ``(dataset, model, metric, mean, std)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Preferred metric column order of the summary table and the
# placeholder for missing numbers.
PREFERRED_METRICS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "brier_score"]
NA = "NA"


def experiment_grid(datasets: DataFrame, models: Sequence[str]) -> DataFrame:
    """datasets x models as rows (explode of the model list)."""
    return datasets.select("*", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))


def pending_experiments(grid: DataFrame, existing: DataFrame, rerun: bool = False) -> DataFrame:
    """Grid rows without a stored result (all rows when ``rerun``)."""
    if rerun:
        return grid
    return grid.join(existing.select("dataset", "model").distinct(), ["dataset", "model"], "left_anti")


def existing_results(grid: DataFrame, results: DataFrame) -> DataFrame:
    """Stored results of grid rows (what a skipped run returns)."""
    return results.join(grid.select("dataset", "model"), ["dataset", "model"], "left_semi")


def metric_order(metrics: Sequence[str]) -> list[str]:
    """Preferred metrics first (in fixed order), the rest alphabetically."""
    ms = set(metrics)
    return [m for m in PREFERRED_METRICS if m in ms] + sorted(m for m in ms if m not in PREFERRED_METRICS)


def flatten_results(results: DataFrame, metrics: Sequence[str], prefix: str = "test_") -> DataFrame:
    """One row per experiment with ``prefix + metric`` mean columns."""
    wide = results.groupBy("dataset", "model").pivot("metric", list(metrics)).agg(F.first("mean"))
    return wide.select("dataset", "model", *[F.col(m).alias(prefix + m) for m in metrics])


def format_mean_std(mean: Column, std: Column, decimals: int = 4) -> Column:
    """'m ± s' with fixed decimals; std missing -> 'm ± NA'; mean missing -> 'NA ± NA'.

    Values are rounded first so the text does not depend on how an engine
    formats binary ties."""
    fmt = f"%.{decimals}f"
    m = F.format_string(fmt, F.round(mean, decimals))
    s = F.format_string(fmt, F.round(std, decimals))
    ok_m = mean.isNotNull() & ~F.isnan(mean)
    ok_s = std.isNotNull() & ~F.isnan(std)
    return (F.when(ok_m & ok_s, F.concat(m, F.lit(" ± "), s))
            .when(ok_m, F.concat(m, F.lit(" ± NA")))
            .otherwise(F.lit("NA ± NA")))


def results_table(results: DataFrame, metrics: Sequence[str], decimals: int = 4,
                  keep_numeric: bool = True, id_cols: Sequence[str] = ("model", "dataset")) -> DataFrame:
    """Wide summary: id columns, then per metric the formatted text and
    (optionally) numeric mean/std; sorted by dataset, model, nulls last."""
    order = metric_order(metrics)
    agg = []
    for m in order:
        agg += [F.first(F.when(F.col("metric") == m, F.col("mean")), ignorenulls=True).alias(f"{m}_mean"),
                F.first(F.when(F.col("metric") == m, F.col("std")), ignorenulls=True).alias(f"{m}_std")]
    wide = results.groupBy(*id_cols).agg(*agg)
    cols = [*id_cols]
    for m in order:
        cols.append(format_mean_std(F.col(f"{m}_mean"), F.col(f"{m}_std"), decimals).alias(m))
        if keep_numeric:
            cols += [f"{m}_mean", f"{m}_std"]
    return wide.select(*cols).orderBy(F.col("dataset").asc_nulls_last(), F.col("model").asc_nulls_last())


def metric_cells(columns: Sequence[str], metrics: Sequence[str] = PREFERRED_METRICS, decimals: int = 4) -> list[Column]:
    """One column per metric of a summary with ``columns``: the formatted one where
    it is there, else the text of its mean and deviation ('NA' for what is not)."""
    def number(name: str) -> Column:
        return (F.col(name) if name in columns else F.lit(None)).cast("double")

    made = {m: format_mean_std(number(f"{m}_mean"), number(f"{m}_std"), decimals) for m in metrics if m not in columns}
    return [made.get(m, F.col(m)).alias(m) for m in metrics]


def union_summaries(parts: Sequence[DataFrame], metrics: Sequence[str] = PREFERRED_METRICS,
                    decimals: int = 4) -> DataFrame:
    """Concatenate per-dataset summaries, keep (dataset, model, metrics),
    sort nulls last. A part without ``model`` is an error."""
    kept = []
    for p in parts:
        if "model" not in p.columns:
            raise ValueError(f"'model' column not found. Columns: {p.columns}")
        kept.append(p.select("dataset", "model", *metric_cells(p.columns, metrics, decimals)))
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k, allowMissingColumns=True)
    return out.orderBy(F.col("dataset").asc_nulls_last(), F.col("model").asc_nulls_last())


def sorted_params_json(params: Column) -> Column:
    """JSON text of a string map with keys sorted (stable across runs)."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(params))))


def experiment_id(name: Column, params: Column, n_hex: int = 8) -> Column:
    """name + '_' + first hex digits of sha-256 of the sorted parameters."""
    return F.concat(name, F.lit("_"), F.substring(F.sha2(sorted_params_json(params), 256), 1, n_hex))


def merge_params(*maps: Column) -> Column:
    """Shallow merge of string maps; later maps win (default <- preset <- tuned)."""
    def tag(level: int):
        return lambda x: F.struct(x["key"].alias("key"), F.lit(level).alias("lv"), x["value"].alias("value"))

    entries = None
    for level, m in enumerate(maps):
        e = F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), tag(level))
        entries = e if entries is None else F.concat(entries, e)
    # keep, per key, the entry of the highest level: sort by key asc, level desc
    srt = F.array_sort(entries, lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1)
                       .otherwise(b["lv"] - a["lv"]))
    firsts = F.filter(srt, lambda x, i: (i == 0) | (x["key"] != F.element_at(srt, i)["key"]))
    return F.map_from_entries(F.transform(firsts, lambda x: F.struct(x["key"], x["value"])))
