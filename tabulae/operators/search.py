"""Hyperparameter search as tables.

* ``candidate_grid`` / ``random_candidates``: the candidate table
  ``(trial, params map<string,string>)`` built by exploding the (bounded,
  user-given) value lists; random search keeps the first ``n_iter``
  candidates in hash order.
* ``cv_scores``: every candidate scored on every fold in one job -- the rows,
  written once, are read by a branch per candidate (or few of them) and the
  metrics are grouped by (trial, fold) with the shared evaluation code.
* ``search_summary``: mean / population std per (trial, metric) and the
  best trial by the refit metric (``max_by``).
* ``grid_search_ml``: Spark ML ``CrossValidator`` for trained estimators.
* ``fit_search``: every (dataset, candidate, fold) is a fit of its own, many of
  them at a time as concurrent Spark jobs; each returns its scores by several
  metrics or an error row, and the best candidate is fitted again on all rows.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import order_hash
from ..session import reuse
from .metrics import evaluate_by

GRID_WARN = 50
# Branches that the candidates of a search are dealt over.
MAX_BRANCHES = 32


def candidate_grid(spark: SparkSession, grid: Mapping[str, Sequence]) -> DataFrame:
    """All combinations, numbered in the product order of the grid keys. The
    entries of a ``params`` map are in the order of their names."""
    keys = list(grid)
    n = 1
    for k in keys:
        n *= len(grid[k])
    if n > GRID_WARN:
        warnings.warn(f"grid has {n} candidates (> {GRID_WARN}); consider random search", stacklevel=2)
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    rows = [(i, [None if combo[k] is None else str(combo[k]) for k in order])
            for i, combo in enumerate(itertools.product(*[grid[k] for k in keys]))]
    names = F.array(*[F.lit(keys[k]) for k in order]) if keys else F.array().cast("array<string>")
    return (spark.createDataFrame(rows, "trial long, vals array<string>")
            .select("trial", F.map_from_arrays(names, F.col("vals")).alias("params")))


def random_candidates(candidates: DataFrame, n_iter: int, seed: int = 42,
                      replacement: bool = False) -> DataFrame:
    """``n_iter`` candidates: without replacement the first in hash order;
    with replacement (independent draws per parameter set, as a trial
    sampler does) draw i picks trial hash(seed, i) mod n, with a ``draw``
    column."""
    if not replacement:
        return candidates.orderBy(order_hash(["trial"], seed), "trial").limit(n_iter)
    n = candidates.count()  # size of the user-given grid
    spark = candidates.sparkSession
    draws = spark.range(n_iter).select(F.col("id").alias("draw"),
                                       F.pmod(order_hash(["id"], seed), F.lit(n)).alias("trial"))
    return draws.join(F.broadcast(candidates), "trial").select("draw", "trial", "params")


def cv_scores(folded: DataFrame, candidates: DataFrame, score_fn: Callable[[Column], Column],
              fold: str = "fold", groups: Sequence[str] = (), threshold: float = 0.5,
              metrics: Sequence[str] = ("roc_auc", "pr_auc", "f1", "brier_score")) -> DataFrame:
    """Long (groups, trial, fold, metric, value): validation metrics of each
    candidate on each fold. ``score_fn(params)`` gives the probability
    column of a row under the candidate's parameter map."""
    paired = _pair(folded, candidates)
    scored = paired.withColumn("p", score_fn(F.col("params")))
    return evaluate_by(scored, [*groups, "trial", fold], threshold=threshold, metrics=list(metrics))


def _pair(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """Attach every candidate to every row: the rows are written once and read by a
    few branches, each with its own candidates (the list is bounded by the grid), so a
    task that aggregates what follows holds the groups of its branch's candidates only."""
    kept = reuse(rows)
    types = {f.name: f.dataType for f in candidates.schema.fields}
    found = candidates.select("trial", F.map_entries("params").alias("entries")).collect()  # in the map's order

    def literal(r) -> Column:
        entries = [F.struct(F.lit(k), F.lit(v).cast("string")) for k, v in r["entries"] or ()]
        params = F.map_from_entries(F.array(*entries)) if entries else F.create_map()
        params = F.lit(None) if r["entries"] is None else params
        return F.struct(F.lit(r["trial"]).cast(types["trial"]).alias("trial"), params.cast(types["params"]).alias("params"))

    if not found:
        return kept.select("*", *[F.lit(None).cast(types[c]).alias(c) for c in ("trial", "params")]).limit(0)
    branches = [found[k::MAX_BRANCHES] for k in range(min(MAX_BRANCHES, len(found)))]
    return reduce(DataFrame.unionAll, [kept.select("*", F.inline(F.array(*map(literal, some)))) for some in branches])


def search_summary(cv: DataFrame, refit: str = "pr_auc", groups: Sequence[str] = (),
                   higher_is_better: bool = True, decimals: int | None = None) -> DataFrame:
    """Per (groups, trial, metric): mean and population std over folds, plus
    ``best`` marking the trial with the best mean refit metric (ties: the
    lower trial number; ``decimals`` compares rounded means)."""
    summ = cv.groupBy(*groups, "trial", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    ref = summ.where(F.col("metric") == refit)
    m = F.round("mean", decimals) if decimals is not None else F.col("mean")
    key = F.struct((m if higher_is_better else -m).alias("m"), (-F.col("trial")).alias("t"))
    best = ref.groupBy(*groups).agg(F.max_by("trial", key).alias("_best"))
    if groups:
        j = summ.join(best, list(groups), "inner")
    else:  # one best row: a bounded broadcast on a constant key
        j = summ.withColumn("_k", F.lit(1)).join(F.broadcast(best.withColumn("_k", F.lit(1))), "_k").drop("_k")
    return j.select(*groups, "trial", "metric", "mean", "std", (F.col("trial") == F.col("_best")).alias("best"))


def best_params(summary: DataFrame, candidates: DataFrame, refit: str = "pr_auc",
                groups: Sequence[str] = ()) -> DataFrame:
    """(groups, trial, best_score, best_params) of the winning trial."""
    b = summary.where(F.col("best") & (F.col("metric") == refit)).select(
        *groups, "trial", F.col("mean").alias("best_score"))
    return b.join(candidates.select("trial", F.col("params").alias("best_params")), "trial")


def grid_search_ml(estimator, param_maps, evaluator, df: DataFrame, fold_col: str | None = None,
                   num_folds: int = 3, parallelism: int = 2, seed: int = 42):
    """Exhaustive CV search with Spark ML; fits run as Spark jobs."""
    from pyspark.ml.tuning import CrossValidator
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=param_maps, evaluator=evaluator,
                        numFolds=num_folds, parallelism=parallelism, seed=seed)
    if fold_col:
        cv = cv.setFoldCol(fold_col)
    return cv.fit(df)


# Fits that a search may ask for; their candidates and scores are on the driver.
MAX_FITS = 10000


@dataclass
class SearchResult:
    """Tables of a ``fit_search``, and the refitted best model of each dataset."""

    scores: DataFrame       # (dataset, trial, fold, metric, value)
    errors: DataFrame       # (dataset, trial, fold, error); null fold: the refit, null trial: the dataset
    summary: DataFrame      # ``search_summary`` per dataset, of candidates that were scored on all folds
    best: DataFrame         # ``best_params`` per dataset
    models: dict[str, object]


def fit_search(datasets: Mapping[str, DataFrame | Callable[[], DataFrame]], candidates: DataFrame,
               fit: Callable[[DataFrame, dict], object], score: Callable[[object, DataFrame], DataFrame],
               refit: str = "pr_auc", metrics: Sequence[str] = ("roc_auc", "pr_auc", "f1", "brier_score"),
               fold: str = "fold", label: str = "label", decimals: int | None = None, parallelism: int = 4,
               higher_is_better: bool | None = None) -> SearchResult:
    """Cross-validated search that trains its candidates.

    ``datasets`` are tables with a ``fold`` column (or functions that make them);
    ``candidates`` is a ``candidate_grid``, or ``random_candidates`` of one (draws
    that repeat a candidate are fitted once). For every fold, ``fit(rows of the
    other folds, params)`` gives a model and ``score(model, rows of the fold)`` a
    table with the columns ``label``, ``p`` and, if hard labels are not p >= 0.5,
    ``pred``; all ``metrics`` come from that one scored table.

    ``parallelism`` fits run at a time, each in a driver thread whose jobs go to its
    dataset's scheduler pool (fair if the session schedules so); the rows stay
    in Spark. A fit that fails gives an error row and leaves the others alone; a
    candidate with an error is not ranked; a dataset without a ranked candidate
    has no best row. The candidate of the best mean ``refit`` metric (ties: the
    lower trial) is fitted on all its dataset's rows."""
    if not datasets:
        raise ValueError("no datasets to search on")
    candidates = candidates.select("trial", "params").dropDuplicates(["trial"])
    rows = candidates.limit(MAX_FITS + 1).collect()
    grid = {r["trial"]: dict(r["params"]) for r in sorted(rows, key=lambda r: r["trial"])}
    if len(grid) > MAX_FITS:
        raise ValueError(f"more than {MAX_FITS} candidates")
    spark = candidates.sparkSession
    scores, errors, models = [], [], {}
    tables: dict[str, DataFrame] = {}
    folds: dict[str, list] = {}

    def guarded(dataset, trial, k, work):
        """``work()`` or None, with an error row."""
        try:
            spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"search-{dataset}")
            return work()
        except Exception as e:  # whatever a fit raises belongs to its row
            errors.append((dataset, trial, k, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"[:300]))
            return None

    def prepare(dataset):
        source = datasets[dataset]
        tables[dataset] = reuse(source() if callable(source) else source)
        folds[dataset] = sorted(r[0] for r in tables[dataset].where(F.col(fold).isNotNull()).select(fold).distinct().collect())
        if len(folds[dataset]) < 2:
            raise ValueError("a search needs two folds at least")

    def one(dataset, trial, k):
        here = F.col(fold) == k
        scored = score(fit(tables[dataset].where(~here), dict(grid[trial])), tables[dataset].where(here))
        pred = "pred" if "pred" in scored.columns else None
        found = evaluate_by(scored, [], label=label, pred=pred, metrics=list(metrics)).collect()
        scores.extend((dataset, trial, int(k), r["metric"], r["value"]) for r in found)

    def all_of(jobs):
        with ThreadPoolExecutor(parallelism) as pool:
            for done in [pool.submit(inheritable_thread_target(spark)(guarded), *job) for job in jobs]:
                done.result()

    all_of([(d, None, None, partial(prepare, d)) for d in datasets])
    failed = {e[0] for e in errors}
    all_of([(d, t, int(k), partial(one, d, t, k)) for d in datasets if d not in failed for t in grid for k in folds[d]])

    complete = {(d, t) for d in folds for t in grid if d not in failed and not any(e[:2] == (d, t) for e in errors)}
    long = spark.createDataFrame(sorted(scores), "dataset string, trial long, fold int, metric string, value double")
    if decimals is not None:
        long = long.withColumn("value", F.round("value", decimals))
    ranked = spark.createDataFrame(sorted(complete), "dataset string, trial long")
    better = refit != "brier_score" if higher_is_better is None else higher_is_better
    summary = search_summary(long.join(F.broadcast(ranked), ["dataset", "trial"]), refit, ["dataset"], better, decimals)
    best = best_params(summary, candidates, refit, ["dataset"])

    def again(dataset, trial):
        models[dataset] = fit(tables[dataset], dict(grid[trial]))

    winners = summary.where("best").select("dataset", "trial").distinct().collect()
    all_of([(r["dataset"], r["trial"], None, partial(again, r["dataset"], r["trial"])) for r in winners])
    rows = [(d, t, k, e) for d, t, k, e in sorted(errors, key=str)]
    return SearchResult(long, spark.createDataFrame(rows, "dataset string, trial long, fold int, error string"), summary, best, models)
