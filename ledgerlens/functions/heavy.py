"""Keys with more rows than one task should sort, found by counting and cut into slabs.

The ``HEAVY_KEYS`` most frequent keys with more than ``at_least`` rows are heavy. There are no more of them by
definition, so a frame of them, also with ``CUTS`` cut points each, is safe to broadcast; and no other key can have more
than one in ``HEAVY_KEYS`` of all rows, which one task holds however large the table grows. Where no key is heavy,
adaptive execution finds the broadcast side empty and drops the whole branch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAVY_KEYS = 1024
CUTS = 255
CUT_ACCURACY = 10_000


def heavy_keys(df: DataFrame, key: str, at_least: int) -> DataFrame:
    """(key): at most ``HEAVY_KEYS`` rows. One count per key, combined map-side."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > at_least)
    return counts.orderBy(F.desc("_n"), key).limit(HEAVY_KEYS).select(key)


def of_heavy(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    return df.join(F.broadcast(heavy), key, "left_semi")


def of_others(df: DataFrame, key: str, heavy: DataFrame) -> DataFrame:
    return df.join(F.broadcast(heavy), key, "left_anti")


def with_cuts(df: DataFrame, key: str, **cols: str) -> DataFrame:
    """``df`` (rows of heavy keys only) with an array per name in ``cols``: cut points of that column for its key.

    The cuts are approximate quantiles: they decide only how rows are dealt out, never a result.
    """
    probs = [(i + 1) / (CUTS + 1) for i in range(CUTS)]
    cuts = df.groupBy(key).agg(*[F.percentile_approx(c, probs, CUT_ACCURACY).alias(name) for name, c in cols.items()])
    return df.join(F.broadcast(cuts), key)


def slab(cuts: Column, x: Column) -> Column:
    """Number of cuts at or below ``x``: a later slab holds only larger values."""
    return F.size(F.filter(cuts, lambda c: c <= x))
