"""Exploratory profile of a ledger.

Each statistic is a small DataFrame built from global or grouped aggregates;
bounds needed by a second pass (histogram edges, quartile fences) arrive as
scalar subqueries, never via ``collect``.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.exprs import attach, attach_scalars, is_high_risk, known_number
from ..functions.quantiles import exact_quantiles


def overview(tx: DataFrame, customers: Optional[DataFrame] = None) -> DataFrame:
    """Rows, distinct customers, first/last timestamp, column count, customer rows."""
    aggs = [F.count(F.lit(1)).alias("total_transactions"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.min("timestamp").alias("first_timestamp"), F.max("timestamp").alias("last_timestamp"),
            F.lit(len(tx.columns)).cast("bigint").alias("column_count")]
    out = tx.agg(*aggs)
    n_cust = customers.select(F.count(F.lit(1))).scalar() if customers is not None else F.lit(0)
    return out.withColumn("customer_rows", n_cust.cast("bigint") if customers is not None else F.lit(0).cast("bigint"))


SKETCH_LG_K = 12


def daily_sketches(tx: DataFrame, lg_k: int = SKETCH_LG_K) -> DataFrame:
    """P1, mergeable: (day, rows, first, last, customers) with a distinct-count sketch per day (2^lg_k registers).

    Written per day, the overview of a growing ledger needs only the new days' rows; rows without a time are day null.
    """
    return tx.groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.hll_sketch_agg(F.col("customer_id").cast("string"), F.lit(lg_k)).alias("customers"))


def overview_of_sketches(days: DataFrame) -> DataFrame:
    """P1 from ``daily_sketches`` of any days, also of several writes of one day: the customer count is an estimate with a
    relative error of about 1 / sqrt(2^lg_k) (1.6 % by default); the rest is exact."""
    return days.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_transactions"),
        F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("customers")), F.lit(0)).alias("unique_customers_estimate"),
        F.min("first").alias("first_timestamp"), F.max("last").alias("last_timestamp"))


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, nulls) for every column, from one aggregation."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], df.columns, "column_name", "nulls")


def describe(df: DataFrame, col: str = "amount", decimals: int = 2) -> DataFrame:
    """Count, mean, sample std, min, linear quartiles, max; rounded."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75], extra={"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max})
    names = {"mean": "mean", "std": "std", "min": "min", "p25": "q_0", "p50": "q_1", "p75": "q_2", "max": "max"}
    one = attach(df.sparkSession.range(1), "_q", q.select(F.struct("n", *names.values())).scalar())   # a row even without values
    return one.select(F.coalesce("_q.n", F.lit(0)).alias("count"), *[F.round(F.col(f"_q.{c}"), decimals).alias(k) for k, c in names.items()])


def clip_bound(df: DataFrame, col: str = "amount", q: float = 0.99, cap: float = 50000.0):
    """P4 clip: min(q-quantile, cap) as a scalar-subquery column."""
    return exact_quantiles(df, col, [q]).select(F.least(F.col("q_0"), F.lit(cap))).scalar()


def histogram(df: DataFrame, col: str, bins: int, lo=None, hi=None, clip: Optional[tuple[float, float]] = None) -> DataFrame:
    """Equal-width histogram, numpy style (last bin closed), all bins
    present (zero-filled). ``lo``/``hi`` default to the data's own min/max; ``clip`` =
    (quantile, cap) first clips values at the lower of the two. One frame of bounds."""
    spark = df.sparkSession
    x = known_number(F.col(col).cast("double"))
    if clip is not None:
        bounds = exact_quantiles(df, col, [clip[0]], extra={"mn": F.min, "mx": F.max}).withColumn("clip", F.least("q_0", F.lit(clip[1])))
        bounds = bounds.select(F.least("mn", "clip").alias("lo"), F.least("mx", "clip").alias("hi"), "clip")
    else:
        bounds = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")) if lo is None or hi is None else spark.range(1)
        bounds = bounds.select("lo" if lo is None else F.lit(float(lo)).alias("lo"), "hi" if hi is None else F.lit(float(hi)).alias("hi"),
                               F.lit(None).cast("double").alias("clip"))
    vals = attach(df.select(x.alias("x")).filter(F.col("x").isNotNull()), "_b", bounds.select(F.struct("lo", "hi", "clip")).scalar())
    vals = vals.withColumn("x", F.least(F.col("x"), F.col("_b.clip")))
    lo_c, hi_c = F.col("_b.lo"), F.col("_b.hi")
    b = F.when((F.col("x") < lo_c) | (F.col("x") > hi_c), None).when(lo_c == hi_c, F.lit(0)).otherwise(
        F.least(F.floor((F.col("x") - lo_c) / (hi_c - lo_c) * bins), F.lit(bins - 1)).cast("int"))
    counts = vals.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.any_value("_b").alias("_b"))
    # at most bins + 1 rows become one, with the bounds; the bins are read from it
    one = counts.agg(F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"), F.any_value("_b").alias("_b"))
    edge = lambda given, own: F.lit(float(given)) if given is not None else own
    lo_c, hi_c = edge(lo, lo_c), edge(hi, hi_c)
    width = hi_c - lo_c
    return one.select("m", "_b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (lo_c + width * F.col("bin") / bins).alias("bin_lo"),
        (lo_c + width * (F.col("bin") + 1) / bins).alias("bin_hi"),
        F.coalesce(F.try_element_at("m", F.col("bin")), F.lit(0)).alias("count"))


def box_stats(df: DataFrame, by: str = "transaction_type", col: str = "amount", clip_upper=None) -> DataFrame:
    """P5: per group q1/median/q3, whiskers at the most extreme points within
    1.5 IQR of the box, and the number of points beyond them. NaN counts as missing."""
    v = df.select(F.col(by).alias("grp"), known_number(F.col(col).cast("double")).alias("x")).filter(F.col("x").isNotNull())
    q = exact_quantiles(v, "x", [0.25, 0.5, 0.75], by=["grp"], clip=clip_upper)
    q = q.select("grp", F.col("q_0").alias("q1"), F.col("q_1").alias("median"), F.col("q_2").alias("q3"),
                 (F.col("clip") if clip_upper is not None else F.lit(None).cast("double")).alias("clip"))
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    # one row per group: AQE broadcasts it when small (few groups), else shuffles on the key
    j = v.join(q, "grp").withColumn("x", F.least("x", "clip"))
    inside = (F.col("x") >= F.col("lo_fence")) & (F.col("x") <= F.col("hi_fence"))
    box = [F.any_value(c).alias(c) for c in ("q1", "median", "q3")]
    w = j.groupBy("grp").agg(*box, F.min(F.when(inside, F.col("x"))).alias("whisker_lo"),
                             F.max(F.when(inside, F.col("x"))).alias("whisker_hi"),
                             F.count_if(~inside).alias("outliers"))
    return w.select(F.col("grp").alias(by), "q1", "median", "q3", "whisker_lo", "whisker_hi", "outliers")


def value_counts(df: DataFrame, col: str, share: bool = False, top: Optional[int] = None) -> DataFrame:
    """Counts per value (nulls dropped), descending; optional share %."""
    c = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("count"))
    if share:   # the total is the sum of the counts: one read of the ledger
        c = attach_scalars(c, c, "_all", F.sum("count").alias("n"))
        c = c.withColumn("share_pct", F.round(F.col("count") * 100.0 / F.col("_all.n"), 4)).drop("_all")
    c = c.orderBy(F.col("count").desc(), F.col(col).asc())
    return c.limit(top) if top else c


def daily_series(df: DataFrame) -> DataFrame:
    """Count and volume per calendar day, zero-filled from first to last day."""
    d = df.filter(F.col("timestamp").isNotNull()).groupBy(F.to_date("timestamp").alias("day")).agg(
        F.count(known_number(F.col("amount"))).alias("count"), F.coalesce(F.sum(known_number(F.col("amount"))), F.lit(0.0)).alias("total"))
    bounds = d.select(F.struct(F.min("day").alias("first"), F.max("day").alias("last"))).scalar()
    spark = df.sparkSession
    cal = spark.range(1).select(bounds.alias("_b")).select(
        F.explode(F.sequence(F.col("_b.first"), F.col("_b.last"), F.expr("INTERVAL 1 DAY"))).alias("day"))
    return cal.join(d, "day", "left").select(
        "day", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("total", F.lit(0.0)).alias("total"))


def top_customers(df: DataFrame, n: int = 10) -> DataFrame:
    """Top n customers by total amount with count and mean."""
    g = df.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.sum(known_number(F.col("amount"))).alias("total_amount"), F.count(known_number(F.col("amount"))).alias("txn_count"),
        F.avg(known_number(F.col("amount"))).alias("avg_amount"))
    return g.orderBy(F.col("total_amount").desc(), F.col("customer_id").asc()).limit(n)


def cash_split(df: DataFrame) -> DataFrame:
    """P10: per is_cash class count, sum, mean, and the cash share of all rows (%, 1 decimal)."""
    share = df.select(F.round(F.avg(F.coalesce(F.col("is_cash"), F.lit(False)).cast("double")) * 100, 1)).scalar()
    g = df.filter(F.col("is_cash").isNotNull()).groupBy("is_cash").agg(
        F.count(known_number(F.col("amount"))).alias("count"), F.sum(known_number(F.col("amount"))).alias("total"),
        F.avg(known_number(F.col("amount"))).alias("mean"))
    return g.withColumn("cash_pct", share)


def top_countries(df: DataFrame, n: int = 15, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Top n counterparty countries by count (nulls dropped) with high-risk flag."""
    top = value_counts(df, "counterparty_country", top=n)
    return is_high_risk(top, cfg, "counterparty_country", "high_risk")


def near_ctr_stats(df: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Near-threshold cash rows and their % of cash rows (denominator >= 1)."""
    cash = F.coalesce(F.col("is_cash"), F.lit(False))
    near = cash & (F.col("amount") >= cfg.structuring_lower) & (F.col("amount") < cfg.ctr_threshold)
    out = df.agg(F.count_if(near).alias("near_ctr_count"), F.count_if(cash).alias("_cash"))
    return out.select("near_ctr_count",
                      F.round(F.col("near_ctr_count") * 100.0 / F.greatest(F.col("_cash"), F.lit(1)), 2)
                      .alias("near_ctr_pct"))


def truth_profile(df: DataFrame) -> DataFrame:
    """Rows per ground-truth pattern other than 'none' (null counts as a
    pattern, like pandas), with flagged-row totals and share %."""
    pat = F.col("ground_truth_pattern")
    g = df.filter(~pat.eqNullSafe("none")).groupBy(pat.alias("pattern")).agg(F.count(F.lit(1)).alias("rows"))
    g = attach_scalars(g, df, "_t", F.count(F.lit(1)).alias("total"),
                       F.count_if(F.coalesce(F.col("ground_truth_flag"), F.lit(False))).alias("flagged"))
    return g.select("pattern", "rows", F.col("_t.flagged").alias("flagged_rows"),
                    F.round(F.col("_t.flagged") * 100.0 / F.col("_t.total"), 4).alias("flagged_pct"))


def describe_features(feat: DataFrame, cols: Sequence[str], decimals: int = 4) -> DataFrame:
    """Describe every numeric feature: long format via unpivot, one grouped agg."""
    long = feat.select("customer_id", *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(["customer_id"], list(cols), "feature", "value")
    r = lambda e: F.round(e, decimals)
    g = long.groupBy("feature").agg(F.count("value").alias("count"), F.avg("value").alias("mean"),
                                    F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
                                    F.max("value").alias("max"))
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], by=["feature"])
    g = g.join(q.drop("n"), "feature")   # one row per feature column: tiny
    return g.select("feature", "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"),
                    r(F.col("min")).alias("min"), r(F.col("q_0")).alias("p25"), r(F.col("q_1")).alias("p50"),
                    r(F.col("q_2")).alias("p75"), r(F.col("max")).alias("max"))
