"""Deterministic hash expressions shared by splits, samples and orders.

All hashes are md5 based so that any SQL engine with ``md5`` can reproduce
them (a DuckDB oracle uses ``('0x' || substr(md5(s), 1, 15))::BIGINT``).
Values are joined with their plain string form, so hash keys should be
integer or string columns; doubles print differently across engines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The joiner the hash split puts between values, and the
# number of leading hex digits kept (13 -> 52 bits, exact in a double;
# 15 -> 60 bits for long hash orders).
SPLIT_JOINER = "||"
FRACTION_HEX_DIGITS = 13
ORDER_HEX_DIGITS = 15
ORDER_HASH_BITS = 4 * ORDER_HEX_DIGITS


def _as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined_string(cols: Sequence[str | Column], sep: str = SPLIT_JOINER) -> Column:
    """Values cast to string and joined; null prints as ``None`` like Python."""
    parts = [F.coalesce(_as_col(c).cast("string"), F.lit("None")) for c in cols]
    return F.concat_ws(sep, *parts)


def hash_fraction(cols: Sequence[str | Column], sep: str = SPLIT_JOINER) -> Column:
    """md5 of the joined values mapped to [0, 1): leading 52 bits / 2^52."""
    hexed = F.substring(F.md5(joined_string(cols, sep)), 1, FRACTION_HEX_DIGITS)
    return F.conv(hexed, 16, 10).cast("double") / F.lit(float(2 ** (4 * FRACTION_HEX_DIGITS)))


def order_hash(cols: Sequence[str | Column], seed: int = 42) -> Column:
    """Uniform 60-bit non-negative long from md5(seed ':' values).

    Used as a random-but-reproducible sort key; uniform over
    [0, 2^60), which lets range buckets be computed without sampling.
    """
    text = F.concat(F.lit(f"{seed}:"), joined_string(cols, "|"))
    return F.conv(F.substring(F.md5(text), 1, ORDER_HEX_DIGITS), 16, 10).cast("long")


def order_hash_sql(cols: Sequence[str], seed: int = 42) -> str:
    """The same order hash in DuckDB SQL (for oracles)."""
    joined = " || '|' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in cols)
    return f"('0x' || substr(md5('{seed}:' || {joined}), 1, {ORDER_HEX_DIGITS}))::BIGINT"


def hash_fraction_sql(cols: Sequence[str], sep: str = SPLIT_JOINER) -> str:
    joined = f" || '{sep}' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'None')" for c in cols)
    return (f"(('0x' || substr(md5({joined}), 1, {FRACTION_HEX_DIGITS}))::BIGINT"
            f" / {float(2 ** (4 * FRACTION_HEX_DIGITS))})")


def unit_uniform(cols: Sequence[str | Column], seed: int, salt: str = "") -> Column:
    """Reproducible U(0,1) draw per row (open interval) from the order hash."""
    h = order_hash([*cols, F.lit(salt)] if salt else cols, seed)
    return (h.cast("double") + F.lit(0.5)) / F.lit(float(2 ** ORDER_HASH_BITS))
