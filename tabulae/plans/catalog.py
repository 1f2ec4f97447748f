"""Registry of the queries the driver runs, each with its DuckDB oracle.

Queries take ``(spark, sf_dir)`` and return a DataFrame. Floating outputs
are rounded to ``DECIMALS`` digits on both sides so that summation order
cannot change a compared value; integer outputs are BIGINT on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}
DECIMALS = 6


def register(name: str, sql: str | None = None):
    """Decorator: add a query (and its oracle SQL when it has one)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _round_type(c, dt: T.DataType, decimals: int):
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return F.round(c, decimals)
    if isinstance(dt, (T.IntegerType, T.ShortType, T.ByteType)):
        return c.cast("long")
    if isinstance(dt, T.ArrayType) and isinstance(dt.elementType, (T.DoubleType, T.FloatType)):
        return F.transform(c, lambda x: F.round(x, decimals))
    return c


def finish(df: DataFrame, decimals: int = DECIMALS, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round doubles (also inside double arrays) and widen ints to long.

    Columns in ``exact`` are computed bit-identically by both engines (an
    exact decimal sum and one IEEE division) and are left unrounded: a
    rounded copy could differ only because the engines round ties in
    different ways."""
    return df.select(*[(F.col(f"`{f.name}`") if f.name in exact
                        else _round_type(F.col(f"`{f.name}`"), f.dataType, decimals)).alias(f.name)
                       for f in df.schema.fields])


def load_all() -> None:
    """Import every query module so their registrations run."""
    from . import q_eval, q_prep, q_explain, q_quality, q_ledger, q_models  # noqa: F401
