import numpy as np
import pandas as pd
import pytest

from tabulae.functions.running import running_sums


@pytest.mark.parametrize("buckets", [1, 4, 16])
def test_running_sums_match_pandas(spark, buckets):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.normal(size=500), "v": rng.integers(0, 5, 500)})
    pdf = pdf.groupby(["g", "k"], as_index=False)["v"].sum()
    df = spark.createDataFrame(pdf).repartition(7)
    out = running_sums(df, "k", ["v"], ["g"], n_buckets=buckets).toPandas()
    exp = pdf.sort_values(["g", "k"]).assign(cum_v=lambda x: x.groupby("g")["v"].cumsum())
    got = out.sort_values(["g", "k"])
    assert got["cum_v"].tolist() == exp["cum_v"].tolist()


def test_running_sums_hash_range_with_ties(spark):
    pdf = pd.DataFrame({"k": [5, 5, 1, 9, 2**59, 3], "t": [2, 1, 0, 0, 0, 0], "one": 1})
    df = spark.createDataFrame(pdf)
    out = running_sums(df, "k", ["one"], key_range=(0.0, float(2**60)), n_buckets=8, tie_cols=["t"]).toPandas()
    order = out.sort_values(["k", "t"])["cum_one"].tolist()
    assert order == [1, 2, 3, 4, 5, 6]
