import math

import duckdb
import pytest

import __spark_entry__ as E
from tabulae.sources.tables import TABLES

from .conftest import SF001


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) == {"split", "metric", "value"}


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


ORACLES = sorted(E.oracle_sql())


@pytest.mark.parametrize("name", ORACLES)
def test_oracle_matches(spark, con, name):
    sdf = E.queries()[name](spark, SF001)
    cols = sorted(sdf.columns)
    srows = sorted((tuple(_norm(r[c]) for c in cols) for r in sdf.collect()), key=repr)
    cur = con.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in cur.description]
    assert sorted(dcols) == cols
    drows = sorted((tuple(_norm(dict(zip(dcols, r))[c]) for c in cols) for r in cur.fetchall()), key=repr)
    assert srows == drows


@pytest.mark.parametrize("name", ["search_best_params", "ledger_merge_params"])
def test_map_entries_are_in_the_oracles_order(spark, con, name):
    """Rows collected as Python objects lose a map's order; Arrow keeps it."""
    got = E.queries()[name](spark, SF001).toArrow()
    want = con.execute(E.oracle_sql()[name]).to_arrow_table()
    maps = [f.name for f in want.schema if str(f.type).startswith("map")]
    assert maps
    for c in maps:
        assert sorted(map(str, got.column(c).to_pylist())) == sorted(map(str, want.column(c).to_pylist()))
