"""Exact quantiles without a single-task buffer.

``percentile`` (exact) keeps every distinct value of a group in one aggregation
buffer -- for a ledger-wide quantile that is the whole column in one task. Here:

1. one aggregation per group: count, min, max and a mergeable
   ``percentile_approx`` sketch (bounded memory, partial aggregation) probed at a
   few probabilities below and above each q;
2. per group, the tightest probes that provably bracket the order statistics
   k = floor(h), ceil(h), h = (n - 1) q, are chosen from n: the sketch's rank
   error is at most eps * n (eps = 1 / accuracy) and its rank discretisation at
   most q / n below and (1 - q) / n above, so a probe p_lo is valid when
   p_lo <= q - q / n - 2 eps (symmetrically above); min / max always are;
3. one more pass counts values: rows below a bracket as one value (null), rows inside it
   (about 6 n / accuracy per quantile for large n, at most 20 % of a small group) by
   value; a running count from the null on finds the exact order statistics;
4. linear interpolation lo + (h - k) (hi - lo) (numpy/pandas "linear").

Two reads of the data. Further aggregates (``extra``) ride along in the first. A global
quantile reads its one-row bracket frame as a scalar subquery planned once (no join).
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .exprs import attach

DEFAULT_ACCURACY = 100_000
WIDE_MARGINS = (0.01, 0.1)


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (),
                    accuracy: int = DEFAULT_ACCURACY, extra: dict[str, Callable[[Column], Column]] | None = None,
                    clip: Column | None = None) -> DataFrame:
    """Per group (``by``; empty = one global row): columns ``q_0 .. q_{m-1}``
    (exact, linearly interpolated), ``n`` (count without nulls and NaN) and the ``extra``
    aggregates of the values by name. No row without values. With ``clip`` (a scalar) the quantiles are those of the
    values cut off above it, and it is returned as column ``clip``: cutting off keeps the order, so it is enough to
    cut the order statistics."""
    keys = list(by)
    eps = 1.0 / accuracy
    vals = df.select(*keys, F.col(col).cast("double").alias("_x")).filter(F.col("_x").isNotNull() & ~F.isnan("_x"))
    more = list(extra or {})
    margins = (3 * eps,) + WIDE_MARGINS
    probes: list[float] = []
    for q in qs:
        probes += [min(max(q - m, 0.0), 1.0) for m in margins] + [min(max(q + m, 0.0), 1.0) for m in margins]
    aggs = [F.count(F.lit(1)).alias("n"), F.min("_x").alias("_mn"), F.max("_x").alias("_mx"),
            F.percentile_approx("_x", probes, accuracy).alias("_pa"), *[f(F.col("_x")).alias(c) for c, f in (extra or {}).items()]]
    st = vals.groupBy(*keys).agg(*aggs) if keys else vals.agg(*aggs)
    n = F.col("n").cast("double")
    br = []
    per_q = 2 * len(margins)
    for i, q in enumerate(qs):
        lo, hi = F.col("_mn"), F.col("_mx")
        for j in reversed(range(len(margins))):        # widest first: the tightest valid probe wins
            p_lo = probes[i * per_q + j]
            p_hi = probes[i * per_q + len(margins) + j]
            if p_lo > 0.0:
                lo = F.when(F.lit(p_lo) <= F.lit(q) - F.lit(q) / n - F.lit(2 * eps),
                            F.col("_pa")[i * per_q + j]).otherwise(lo)
            if p_hi < 1.0:
                hi = F.when(F.lit(p_hi) >= F.lit(q) + F.lit(1.0 - q) / n + F.lit(2 * eps),
                            F.col("_pa")[i * per_q + len(margins) + j]).otherwise(hi)
        br += [lo.alias(f"_lo{i}"), hi.alias(f"_hi{i}")]
    st = st.select(*keys, "n", *more, *br)
    ends = [c for i in range(len(qs)) for c in (f"_lo{i}", f"_hi{i}")]
    if keys:
        j = vals.join(st, keys, "inner")   # group-level frame: AQE broadcasts it when small
    else:                                 # one row: a scalar subquery referenced once, no join
        j = attach(vals, "_st", st.select(F.struct("n", *more, *ends)).scalar())
        j = j.select("_x", *[F.col(f"_st.{c}").alias(c) for c in ["n", *more, *ends]])
    value = lambda i: F.when(F.col("_x") <= F.col(f"_hi{i}"), F.struct(
        F.lit(i).alias("_qi"), F.when(F.col("_x") >= F.col(f"_lo{i}"), F.col("_x")).alias("_v")))
    marked = j.select(*keys, "n", *more, F.explode(F.array_compact(F.array(*[value(i) for i in range(len(qs))]))).alias("_m"))
    ride = [F.any_value(c).alias(c) for c in ["n", *more]]
    vc = marked.groupBy(*keys, F.col("_m._qi").alias("_qi"), F.col("_m._v").alias("_v")).agg(F.count(F.lit(1)).alias("_c"), *ride)
    w = Window.partitionBy(*keys, "_qi").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    h = (F.col("n") - 1) * F.get(F.array(*[F.lit(float(q)) for q in qs]), F.col("_qi"))
    vc = vc.withColumn("_cum", F.sum("_c").over(w)).withColumn("_h", h)
    res = vc.groupBy(*keys, "_qi").agg(
        F.min(F.when(F.col("_cum") > F.floor("_h"), F.col("_v"))).alias("_v1"),
        F.min(F.when(F.col("_cum") > F.ceil("_h"), F.col("_v"))).alias("_v2"), F.any_value("_h").alias("_h"), *ride)
    if clip is not None:
        res = attach(res, "clip", clip).withColumns({"_v1": F.least("_v1", "clip"), "_v2": F.least("_v2", "clip")})
        ride = [*ride, F.any_value("clip").alias("clip")]
    res = res.withColumn("_q", F.col("_v1") + (F.col("_h") - F.floor("_h")) * (F.col("_v2") - F.col("_v1")))
    return res.groupBy(*keys).agg(*[F.max(F.when(F.col("_qi") == i, F.col("_q"))).alias(f"q_{i}") for i in range(len(qs))], *ride) \
        .filter(F.col("n").isNotNull())
