"""Results must not depend on how the input is partitioned (1, 4, 16)."""
import numpy as np
import pytest

from tabulae.functions.scorers import LinearScorer
from tabulae.operators import attribution as X
from tabulae.operators import metrics as M


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    rows = [(i, int(rng.integers(0, 2)), float(np.round(rng.random(), 3)), "a" if i % 3 else "b")
            for i in range(3000)]
    return spark.createDataFrame(rows, "row_id long, label int, p double, g string")


def _metrics(df):
    out = M.evaluate_by(df, ["g"], extra=["f1_max", "precision_at_recall"]).collect()
    return sorted((r.g, r.metric, round(r.value, 12)) for r in out)


def test_evaluate_by_partition_invariant(scored):
    base = _metrics(scored.coalesce(1))
    for n in (4, 16):
        assert _metrics(scored.repartition(n)) == base


def test_shapley_partition_invariant(spark):
    sc = LinearScorer({"a": 1.0, "b": -0.5}, decimals=None)
    rows = spark.createDataFrame([(i, float(i % 7), float(i % 5)) for i in range(200)], "id long, a double, b double")
    bg = rows.where("id < 10")

    def phi(df):
        return sorted((r.id, r.feature, round(r.phi, 12))
                      for r in X.shapley_values(df, ["a", "b"], sc, bg, ["id"]).collect())
    base = phi(rows.coalesce(1))
    assert phi(rows.repartition(16)) == base
