"""Correlations by blocked cross products; two-valued columns by a sketch."""
import numpy as np
import pandas as pd
import pytest

from tabulae.operators import profile as P


def frame(spark, x, parts):
    cols = [f"c{i}" for i in range(x.shape[1])]
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(parts), cols


@pytest.mark.parametrize("d,block,fan_in,parts", [(3, 64, 32, 1), (7, 3, 2, 9), (70, 32, 3, 5)])
def test_correlations_equal_pairwise_complete_ones(spark, monkeypatch, d, block, fan_in, parts):
    monkeypatch.setattr(P, "GRAM_BLOCK", block)
    monkeypatch.setattr(P, "GRAM_FAN_IN", fan_in)
    rng = np.random.default_rng(d)
    x = rng.normal(size=(200, d)) @ rng.normal(size=(d, d)) + 1e7 * rng.normal(size=d)  # large means
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 0] = np.where(np.isnan(x[:, 0]), np.nan, 0.1)  # constant
    x[5:, 1] = np.nan  # few values
    x[:5, 1] = range(5)
    df, cols = frame(spark, x, parts)
    got = P.correlation_matrix(df, cols).toPandas()
    assert len(got) == d * (d - 1) and not got.duplicated(["a", "b"]).any()
    want = pd.DataFrame(x, columns=cols).corr(min_periods=2)
    for a, b, r in got.itertuples(index=False):
        assert (np.isnan(want.loc[a, b]) and np.isnan(r)) or r == pytest.approx(want.loc[a, b], abs=1e-6), (a, b)


def test_five_hundred_columns_in_one_scan(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 500))
    df, cols = frame(spark, x, 3)
    out = P.correlation_matrix(df, cols)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 2  # the sums, and the pairs from the merged sums
    got = {(r["a"], r["b"]): r["corr"] for r in out.where("a = 'c3' OR b = 'c499'").collect()}
    want = np.corrcoef(x.T)
    assert len(got) == 2 * 499 - 1
    assert all(v == pytest.approx(want[int(a[1:]), int(b[1:])], abs=1e-9) for (a, b), v in got.items())


def test_correlations_of_odd_tables(spark):
    df = spark.createDataFrame([], "a double, `b.c` double")
    assert all(r["corr"] is None for r in P.correlation_matrix(df, ["a", "b.c"]).collect())
    assert P.correlation_matrix(df, ["a"]).count() == 0
    one = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0)], "a double, `b.c` double")
    assert [r["corr"] for r in P.correlation_matrix(one, ["a", "b.c"]).collect()] == [None, None]


def test_binary_columns_without_counting_all_values(spark):
    rows = [(i, i % 2, "x" if i % 3 else None, [0.0, -0.0, 1.0][i % 3], True, None, float("nan") if i % 2 else 1.0) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, two int, one string, zeros double, flag boolean, none string, nans double").repartition(6)
    out = P.binary_columns(df)
    assert {r["column"] for r in out.collect() if r["is_binary"]} == {"two", "zeros", "nans"}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
    assert P.detect_target(df) == ("two", "binary")
    assert not any(r["is_binary"] for r in P.binary_columns(df.limit(0)).collect())
    assert P.detect_target(df.select("id", "one")) == ("one", "last")
