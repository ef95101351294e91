"""Key registry: Spark callable + oracle SQL (+ the double columns both sides round)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Entry:
    fn: Callable[[SparkSession, str], DataFrame]
    sql: Optional[str]
    dbl: Sequence[str] = field(default_factory=tuple)
    digits: int = 6


REGISTRY: dict[str, Entry] = {}


def register(key: str, sql: Optional[str] = None, dbl: Sequence[str] = (), digits: int = 6):
    def deco(fn):
        REGISTRY[key] = Entry(fn, sql, tuple(dbl), digits)
        return fn
    return deco


def _digits(dbl: Sequence, digits: int) -> list[tuple[str, int]]:
    """``dbl`` entries are column names (use ``digits``) or (name, digits) pairs."""
    return [(c, digits) if isinstance(c, str) else (c[0], c[1]) for c in dbl]


def _off_tie(digits: int) -> float:
    return 0.137 * 10.0 ** -digits


def _round_spark(df: DataFrame, dbl: Sequence, digits: int) -> DataFrame:
    if not dbl:
        return df
    # Sums in another order differ in the last bits, which turns a decimal tie (a mean of 32 amounts) either way; both
    # engines first add the same fraction of a unit. "+ 0.0" turns a rounded -0.0 into 0.0.
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(_off_tie(d)), d) + F.lit(0.0) for c, d in _digits(dbl, digits)})


def _round_sql(sql: str, dbl: Sequence, digits: int) -> str:
    if not dbl:
        return sql
    rep = ", ".join(f"round(CAST({c} AS DOUBLE) + CAST({_off_tie(d)!r} AS DOUBLE), {d}) + CAST(0 AS DOUBLE) AS {c}" for c, d in _digits(dbl, digits))
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) q"


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for k, e in REGISTRY.items():
        def run(spark, sf_dir, _e=e):
            return _round_spark(_e.fn(spark, sf_dir), _e.dbl, _e.digits)
        out[k] = run
    return out


def oracle_queries() -> dict[str, str]:
    return {k: _round_sql(e.sql, e.dbl, e.digits) for k, e in REGISTRY.items() if e.sql is not None}
