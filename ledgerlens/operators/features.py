"""Per-customer features.

Plan shape, designed for a skewed ledger on many executors:
* every additive feature (A1, A2, A5, A6, A7, A9, A10, A13, A14, and the telescoped
  mean gaps of A4/A8) is ONE ``groupBy(customer_id).agg`` -> partial aggregation
  map-side, one shuffle on customer_id;
* global "now"/span are scalar subqueries (one tiny job each), never a collect;
* a customer with more rows than one task should sort is found by counting (``functions/heavy.py``: at most 1,024 of
  them) and cut into slabs by time or amount; everybody else is one unit of bounded size;
* adjacency features (A8 min gap, A12 dormancy) look at neighbours inside a slab, then across the slabs' ends;
* the 7-day structuring cluster (A3) reads a running count at both ends of each window, slab totals added;
* the rapid-movement pair count (A11) is dominance counting (``functions/dominance.py``): no pair is listed;
* the exact median (A1) of a heavy customer is found by narrowing ranges, of everybody else in the one aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import KYC_STATUS_CODES, RISK_CATEGORY_CODES, RiskConfig
from .filters import by_customers
from ..functions.dominance import AFTER, BEFORE, OUT, count_pairs
from ..functions.heavy import CUTS, heavy_keys, of_heavy, of_others, slab, with_cuts
from ..functions.quantiles import exact_quantiles
from ..session import stored
from ..functions.exprs import attach_scalars, encode, hours_between, is_high_risk, known_number, whole_days

MICROS_PER_DAY = 86400 * 1_000_000


def _micros(ts: Column) -> Column:
    """Epoch microseconds of a timestamp (``unix_micros`` rejects NTZ)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts.cast("timestamp_ntz"))


def _ledger(tx: DataFrame) -> DataFrame:
    """pandas ``groupby`` drops NULL keys; so do we."""
    return tx.filter(F.col("customer_id").isNotNull())


def heavy_customers(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """The customers, 1,024 at most, with the most rows and more than ``cfg.heavy_rows``."""
    return heavy_keys(_ledger(tx), "customer_id", cfg.heavy_rows)


def near_ctr_flag(cfg: RiskConfig) -> Column:
    """F8 AND F9: cash rows in [structuring_lower, ctr_threshold)."""
    return (F.coalesce(F.col("is_cash"), F.lit(False))
            & (F.col("amount") >= cfg.structuring_lower) & (F.col("amount") < cfg.ctr_threshold))


def unusual_time_flag(ts: Column) -> Column:
    """hour < 6, hour > 22, or Saturday/Sunday (``weekday`` is Monday=0)."""
    return (F.hour(ts) < 6) | (F.hour(ts) > 22) | (F.weekday(ts) >= 5)


# ----------------------------------------------------------------- A1..A14 agg
def base_aggregates(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """One aggregation for all additive per-customer features."""
    df = _ledger(tx)
    has_cash = "is_cash" in df.columns
    has_country = "counterparty_country" in df.columns
    ts, amt = F.col("timestamp"), known_number(F.col("amount"))
    exact = cfg.median_accuracy is None
    if exact:   # heavy customers' amounts never fill a median buffer
        heavy = heavy_customers(tx, cfg)
        df = df.join(F.broadcast(heavy.withColumn("_heavy", F.lit(True))), "customer_id", "left")
    # ledger-wide "now" and first timestamp, of all rows (also those without a customer): one scalar subquery
    df = attach_scalars(df, tx, "_glob", F.max("timestamp").alias("now"), F.min("timestamp").alias("first"))
    now = F.col("_glob.now")

    if has_country:
        df = is_high_risk(df, cfg)
    near = near_ctr_flag(cfg) if has_cash else F.lit(False)
    aggs = [
        F.count("transaction_id").alias("total_transactions"),
        F.sum(amt).alias("total_amount"),
        F.avg(amt).alias("avg_amount"),
        F.coalesce(F.stddev_samp(amt), F.lit(0.0)).alias("std_amount"),
        F.max(amt).alias("max_amount"),
        F.min(amt).alias("min_amount"),
        (F.median(F.when(F.col("_heavy").isNull(), amt)) if exact
         else F.percentile_approx(amt, 0.5, cfg.median_accuracy).cast("double")).alias("median_amount"),
        # structuring
        F.count_if(near).alias("cash_near_ctr_count"),
        F.sum(F.when(near, amt)).alias("cash_near_ctr_total"),
        F.min(F.when(near, ts)).alias("_near_first"),
        F.max(F.when(near, ts)).alias("_near_last"),
        F.count_if(F.coalesce(F.col("is_cash"), F.lit(False)) if has_cash else F.lit(False))
         .alias("total_cash_transactions"),
        # velocity windows anchored on the ledger's own max timestamp
        *[x for d, lab in ((1, "1d"), (7, "7d"), (30, "30d")) for x in (
            F.count_if(ts >= now - F.make_interval(days=F.lit(d))).alias(f"txn_count_{lab}"),
            F.coalesce(F.sum(F.when(ts >= now - F.make_interval(days=F.lit(d)), amt)), F.lit(0.0))
             .alias(f"txn_volume_{lab}"))],
        F.min(ts).alias("_first"), F.max(ts).alias("_last"), F.count(ts).alias("_n_ts"),
        F.any_value("_glob").alias("_glob"),
        # a row without a timestamp counts as a usual time
        F.avg(F.when(unusual_time_flag(ts), 1.0).otherwise(0.0)).alias("unusual_time_pct"),
    ]
    if has_country:
        aggs += [
            F.count_if(F.col("_high_risk")).alias("high_risk_country_txns"),
            F.coalesce(F.sum(F.when(F.col("_high_risk"), amt)), F.lit(0.0)).alias("high_risk_country_volume"),
            # as many values as there are countries; a distinct count would shuffle every buffer twice
            F.size(F.collect_set("counterparty_country")).cast("long").alias("unique_countries"),
        ]
    g = df.groupBy("customer_id").agg(*aggs)
    if exact:
        split = exact_quantiles(of_heavy(_ledger(tx), "customer_id", heavy), "amount", [0.5], by=["customer_id"])
        g = g.join(F.broadcast(split.select("customer_id", F.col("q_0").alias("_split_median"))), "customer_id", "left").withColumn(
            "median_amount", F.coalesce("_split_median", "median_amount"))

    total = F.col("total_transactions")
    span_days = F.greatest(whole_days(F.col("_glob.first"), F.col("_glob.now")), F.lit(1))
    daily_avg = total / span_days
    daily_avg = F.when(daily_avg == 0, F.lit(0.001)).otherwise(daily_avg)
    n_near = F.col("cash_near_ctr_count")
    out = g.select(
        "customer_id", "total_transactions", "total_amount", "avg_amount", "std_amount",
        "max_amount", "min_amount", "median_amount",
        "cash_near_ctr_count",
        F.coalesce(F.col("cash_near_ctr_total"), F.lit(0.0)).alias("cash_near_ctr_total"),
        # mean of consecutive gaps telescopes to (last - first) / (n - 1)
        F.when(n_near == 0, F.lit(0.0)).when(n_near == 1, F.lit(999.0))
         .otherwise(hours_between(F.col("_near_first"), F.col("_near_last")) / (n_near - 1))
         .alias("near_ctr_avg_gap_hours"),
        "total_cash_transactions",
        F.coalesce(F.try_divide(F.col("total_cash_transactions"), total), F.lit(0.0)).alias("cash_transaction_pct"),
        "txn_count_1d", "txn_volume_1d", "txn_count_7d", "txn_volume_7d", "txn_count_30d", "txn_volume_30d",
        ((F.col("txn_count_7d") / 7) / daily_avg).alias("velocity_ratio_7d"),
        ((F.col("txn_count_30d") / 30) / daily_avg).alias("velocity_ratio_30d"),
        F.when(F.col("_n_ts") < 2, F.lit(999.0))
         .otherwise(hours_between(F.col("_first"), F.col("_last")) / (F.col("_n_ts") - 1)).alias("mean_gap_hours"),
        *([
            "high_risk_country_txns", "high_risk_country_volume",
            F.coalesce(F.try_divide(F.col("high_risk_country_txns"), total), F.lit(0.0)).alias("high_risk_country_pct"),
            "unique_countries"] if has_country else []),
        F.coalesce(F.col("unusual_time_pct"), F.lit(0.0)).alias("unusual_time_pct"),
        (F.col("std_amount") / F.when(F.col("avg_amount") == 0, F.lit(1.0)).otherwise(F.col("avg_amount")))
         .alias("amount_cv"),
        "_n_ts",
    )
    return out


# ------------------------------------------------------------ A8 / A12 (gaps)
def gap_units(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(customer_id, slab, us, n): the times that neighbour each other; a heavy customer's are distinct, with their number."""
    rows = _ledger(tx).filter(F.col("timestamp").isNotNull()).select("customer_id", _micros(F.col("timestamp")).alias("us"))
    heavy = heavy_customers(tx, cfg)
    one = F.lit(1).cast("long").alias("n")
    others = of_others(rows, "customer_id", heavy).select("customer_id", F.lit(0).alias("slab"), "us", one)
    hot = with_cuts(of_heavy(rows, "customer_id", heavy), "customer_id", cuts="us")
    hot = hot.groupBy("customer_id", slab(F.col("cuts"), F.col("us")).alias("slab"), "us").agg(F.count(F.lit(1)).alias("n"))
    return others.unionByName(hot)


def gap_extremes(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Per customer: smallest and largest gap (microseconds) between consecutive rows.

    Gaps inside each (customer, slab), then from each slab's last row to the next one's first. Only heavy customers
    have more than one slab, at most 256.
    """
    inside = Window.partitionBy("customer_id", "slab").orderBy("us")
    near = gap_units(tx, cfg).withColumn("gap", F.col("us") - F.lag("us").over(inside))
    ends = near.groupBy("customer_id", "slab").agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.max("gap").alias("max_in"),
        F.least(F.min("gap"), F.min(F.when(F.col("n") > 1, F.lit(0).cast("long")))).alias("min_in"))
    across = ends.withColumn("cross", F.col("first") - F.lag("last").over(Window.partitionBy("customer_id").orderBy("slab")))
    return across.groupBy("customer_id").agg(
        F.least(F.min("min_in"), F.min("cross")).alias("min_gap_us"),
        # rows at one and the same time have a gap of zero
        F.greatest(F.max("max_in"), F.max("cross"), F.min("min_in")).alias("max_gap_us"))


def timing_features(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """A8 min_gap_hours and A12 dormancy_flag (< 2 rows: 999 and 0)."""
    g = gap_extremes(tx, cfg)
    return g.select(
        "customer_id",
        (F.col("min_gap_us") / F.lit(3.6e9)).alias("min_gap_hours"),
        F.when(F.floor(F.col("max_gap_us") / F.lit(float(MICROS_PER_DAY))) >= cfg.dormancy_days, 1)
         .otherwise(0).alias("dormancy_flag"),
    )


# -------------------------------------------------------- A3 structuring cluster
ROW, PROBE = 0, 1


def cluster_points(tx: DataFrame, cfg: RiskConfig) -> tuple[DataFrame, DataFrame]:
    """(points, before): rows and probes (customer_id, slab, at, kind, anchor, w), and for heavy customers the rows in
    earlier slabs (customer_id, slab, before)."""
    width = cfg.structuring_window_days * MICROS_PER_DAY
    near = _ledger(tx).filter(near_ctr_flag(cfg) & F.col("timestamp").isNotNull()).select(
        "customer_id", _micros(F.col("timestamp")).alias("us"))
    heavy = heavy_customers(tx, cfg)
    point = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), F.col("us").alias("anchor"))
    both = F.explode(F.array(point(F.col("us"), ROW), point(F.col("us") + width, PROBE))).alias("p")
    one = of_others(near, "customer_id", heavy).select("customer_id", F.lit(0).alias("slab"), F.lit(1).cast("long").alias("w"), both).select(
        "customer_id", "slab", "w", "p.*")
    hot = of_heavy(near, "customer_id", heavy).groupBy("customer_id", "us").agg(F.count(F.lit(1)).alias("w"))
    # rows and probes are cut together, so that no slab is full of probes
    hot = with_cuts(hot.select("customer_id", "w", both).select("customer_id", "w", "p.*"), "customer_id", cuts="at")
    cut = hot.select("customer_id", slab(F.col("cuts"), F.col("at")).alias("slab"), "w", "at", "kind", "anchor")
    totals = cut.where(F.col("kind") == ROW).groupBy("customer_id", "slab").agg(F.sum("w").alias("w"))
    # a probe may lie in a slab without rows: every slab number gets its sum
    every = totals.groupBy("customer_id").agg(F.collect_list(F.struct("slab", "w")).alias("sums")).select(
        "customer_id", "sums", F.explode(F.sequence(F.lit(0), F.lit(CUTS))).alias("slab"))
    before = every.select("customer_id", "slab", F.aggregate(
        F.filter("sums", lambda x: x["slab"] < F.col("slab")), F.lit(0).cast("long"), lambda a, x: a + x["w"]).alias("before"))
    return one.unionByName(cut), before


def structuring_cluster(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Max number of near-threshold cash rows in any [t, t + window] (both ends
    inclusive), anchored at each such row. One row -> 1.

    The count is a difference of two running counts of the customer's rows: up to a probe at the window's end, and
    before the anchor. Heavy customers' running counts are made per slab and the earlier slabs' rows (at most 1,024
    customers by 256 slabs) added from a broadcast.
    """
    if "is_cash" not in tx.columns:
        return tx.filter(F.lit(False)).select("customer_id", F.lit(0).cast("bigint").alias("structuring_cluster_max"))
    points, before = cluster_points(tx, cfg)
    is_row = F.col("kind") == ROW
    running = Window.partitionBy("customer_id", "slab").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    counted = points.withColumn("n", F.sum(F.when(is_row, F.col("w")).otherwise(0)).over(running)).join(
        F.broadcast(before), ["customer_id", "slab"], "left").withColumn("n", F.col("n") + F.coalesce("before", F.lit(0)))
    each = counted.groupBy("customer_id", "anchor").agg(
        F.max(F.when(~is_row, F.col("n"))).alias("upto"), F.min(F.when(is_row, F.col("n") - F.col("w"))).alias("earlier"))
    return each.groupBy("customer_id").agg(F.max(F.col("upto") - F.col("earlier")).alias("structuring_cluster_max"))


# ------------------------------------------------------------ A11 rapid movement
def rapid_points(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """(customer_id, bucket, x, y, kind): outs, and what each deposit asks of its own and the next 24-hour bucket.

    In its own bucket a deposit counts the outs after it, in the next one those up to its time a bucket later; y is an
    out's amount or the least amount that a deposit counts.
    """
    width = cfg.rapid_hours * 3600 * 1_000_000
    amt, us = F.col("amount"), F.col("us")
    df = _ledger(tx).filter(F.col("timestamp").isNotNull() & ~F.isnan("amount"))
    is_dep = (F.col("transaction_type") == "deposit") & (amt >= cfg.rapid_min_deposit)
    # an out that any deposit counts is at least ratio * min_deposit (pushed to the scan)
    is_out = F.col("transaction_type").isin("transfer", "wire_transfer") & (amt >= cfg.rapid_ratio * cfg.rapid_min_deposit)
    bucket = F.floor(us / F.lit(width))
    point = lambda b, x, y, kind: F.struct(b.alias("bucket"), x.alias("x"), y.cast("double").alias("y"), F.lit(kind).alias("kind"))
    least = amt * F.lit(cfg.rapid_ratio)
    asks = F.when(is_dep, F.array(point(bucket, us, least, AFTER), point(bucket + 1, us + F.lit(width), least, BEFORE))).otherwise(
        F.array(point(bucket, us, amt, OUT)))
    return df.filter(is_dep | is_out).withColumn("us", _micros(F.col("timestamp"))).select("customer_id", F.explode(asks).alias("p")).select("customer_id", "p.*")


def rapid_movement(tx: DataFrame, cfg: RiskConfig) -> DataFrame:
    """Pairs (deposit >= rapid_min_deposit, transfer/wire out) of one customer with
    dep.ts < out.ts <= dep.ts + rapid_hours and out.amount >= rapid_ratio * dep.amount.

    Counted per (customer, 24-hour bucket) without listing pairs. A heavy customer's points are cut by time and by
    amount into slabs: pairs inside a time slab, pairs across time slabs inside an amount slab, and pairs across
    both, which need only the numbers of points per cell (at most 256 by 256 a bucket).
    """
    points = rapid_points(tx, cfg)
    heavy = heavy_customers(tx, cfg)
    one = F.lit(1).cast("long").alias("w")
    zero = F.lit(0).alias("slab")
    others = of_others(points, "customer_id", heavy).select("*", zero, one)
    hot = with_cuts(of_heavy(points, "customer_id", heavy), "customer_id", x_cuts="x", y_cuts="y").select(
        "customer_id", "bucket", "x", "y", "kind", slab(F.col("x_cuts"), F.col("x")).alias("xs"), slab(F.col("y_cuts"), F.col("y")).alias("ys"))
    near = others.unionByName(hot.select("customer_id", "bucket", "x", "y", "kind", F.col("xs").alias("slab"), one))
    wide = hot.select("customer_id", "bucket", F.col("ys").alias("slab"), F.col("xs").alias("x"), "y", "kind", one)
    cells = hot.groupBy("customer_id", "bucket", "xs", "ys", "kind").agg(F.count(F.lit(1)).alias("w")).select(
        "customer_id", "bucket", F.col("xs").alias("x"), F.col("ys").alias("y"), "kind", "w")
    unit = ["customer_id", "bucket"]
    found = count_pairs(near, [*unit, "slab"], "customer_id").unionByName(
        count_pairs(wide, [*unit, "slab"], "customer_id", strict_x=True)).unionByName(
        count_pairs(cells, unit, "customer_id", strict_x=True, strict_y=True))
    return found.groupBy("customer_id").agg(F.sum("pairs").alias("rapid_movement_count")).where("rapid_movement_count > 0")


# ------------------------------------------------------------- A19/A20 enrichment
def enrich_customers(feat: DataFrame, customers: DataFrame) -> DataFrame:
    """Left join the customer dimension (de-duplicated on the key) and encode."""
    cols = [c for c in ("risk_category", "pep_flag", "kyc_status", "account_type") if c in customers.columns]
    dim = customers.select("customer_id", *cols).dropDuplicates(["customer_id"])
    out = feat.join(dim.hint("shuffle_hash"), "customer_id", "left")
    if "risk_category" in cols:
        out = out.withColumn("risk_category_encoded", encode(F.col("risk_category"), RISK_CATEGORY_CODES))
    if "pep_flag" in cols:
        out = out.withColumn("pep_flag", F.coalesce(F.col("pep_flag").cast("int"), F.lit(0)))
    if "kyc_status" in cols:
        out = out.withColumn("kyc_status_encoded", encode(F.col("kyc_status"), KYC_STATUS_CODES))
    return out


# ------------------------------------------------------------------ A21 assemble
FAMILIES = ("structuring", "velocity", "geographic", "behavioral")
FOCUS_FAMILY = {"structuring": "structuring", "velocity_spike": "velocity",
                "geographic_risk": "geographic", "rapid_cashout": "behavioral",
                "dormant_activation": "behavioral", "layering": "behavioral"}

CORE = ["total_transactions", "total_amount", "avg_amount", "std_amount", "max_amount", "min_amount",
        "median_amount"]
STRUCT = ["cash_near_ctr_count", "cash_near_ctr_total", "structuring_cluster_max", "near_ctr_avg_gap_hours",
          "total_cash_transactions", "cash_transaction_pct"]
VELOC = ["txn_count_1d", "txn_volume_1d", "txn_count_7d", "txn_volume_7d", "txn_count_30d", "txn_volume_30d",
         "velocity_ratio_7d", "velocity_ratio_30d", "mean_gap_hours", "min_gap_hours"]
GEO = ["high_risk_country_txns", "high_risk_country_volume", "high_risk_country_pct", "unique_countries"]
BEHAV = ["rapid_movement_count", "dormancy_flag", "unusual_time_pct", "amount_cv"]
GRAPH = ["network_pagerank", "network_in_degree", "network_out_degree", "circular_flow_count"]


LEDGER_COLUMNS = ["customer_id", "timestamp", "amount", "transaction_type", "counterparty_id", "counterparty_country", "is_cash"]


#: the families that alone read a column; ``graph`` reads the two of its edges
COLUMN_READERS = {"transaction_type": {"behavioral", "graph"}, "counterparty_id": {"graph"},
                  "counterparty_country": {"geographic"}, "is_cash": {"structuring"}}


def read_once(tx: DataFrame, families: set[str]) -> DataFrame:
    """The columns that these families (``graph`` among them) need, read from the source once and stored; each feature
    then scans its own few. A ledger that is a join is so made, and shuffled, once."""
    needed = [c for c in LEDGER_COLUMNS if c in tx.columns and (c not in COLUMN_READERS or COLUMN_READERS[c] & families)]
    return stored(tx.select(F.when(F.col("transaction_id").isNotNull(), 1).alias("transaction_id"), *needed))


def engineer_features(tx: DataFrame, customers: DataFrame | None = None, cfg: RiskConfig = RiskConfig(),
                      feature_set: str = "all", pattern_focus: str | None = None,
                      graph: bool = True, customer_ids=None) -> DataFrame:
    """One row per customer, numeric NULLs filled with 0 (text columns kept).

    ``customer_ids`` (list or frame) restricts the ledger to these customers first. All features share one reading of
    the source (``read_once``), which runs when the plan is built, as PageRank does. Frames with a row per customer are
    joined by their hashed partitions: broadcasts would send them, as they grow with the customers, through the driver."""
    from .graph import graph_features  # local import: graph depends on this module

    tx = by_customers(tx, customer_ids)
    fams = set(FAMILIES) if feature_set == "all" else {feature_set} & set(FAMILIES)
    if pattern_focus in FOCUS_FAMILY:
        fams.add(FOCUS_FAMILY[pattern_focus])
    has_cash = "is_cash" in tx.columns
    has_country = "counterparty_country" in tx.columns
    tx = read_once(tx, fams | ({"graph"} if graph else set()))
    base = base_aggregates(tx, cfg)

    feat = base
    if fams & {"velocity", "behavioral"}:   # min gap (A8) and dormancy (A12) need adjacency
        feat = feat.join(timing_features(tx, cfg).hint("shuffle_hash"), "customer_id", "left")
        feat = feat.withColumn("min_gap_hours", F.when(F.col("_n_ts") < 2, F.lit(999.0))
                               .otherwise(F.col("min_gap_hours")))
        feat = feat.withColumn("dormancy_flag", F.when(F.col("_n_ts") < 2, F.lit(0))
                               .otherwise(F.col("dormancy_flag")))
    if "structuring" in fams and has_cash:
        feat = feat.join(structuring_cluster(tx, cfg).hint("shuffle_hash"), "customer_id", "left")
    if "behavioral" in fams:
        feat = feat.join(rapid_movement(tx, cfg).hint("shuffle_hash"), "customer_id", "left")
    cols = list(CORE)
    if "structuring" in fams:
        cols += STRUCT if has_cash else []
    if "velocity" in fams:
        cols += VELOC
    if "geographic" in fams and has_country:
        cols += GEO
    if "behavioral" in fams:
        cols += BEHAV
    if "structuring" in fams and not has_cash:
        feat = feat.select("*", *[F.lit(0).alias(c) for c in STRUCT if c not in feat.columns])
        cols += STRUCT
    feat = feat.select("customer_id", *cols)
    if graph:
        feat = feat.join(graph_features(tx, cfg).hint("shuffle_hash"), "customer_id", "left")
        cols += GRAPH
    if customers is not None:
        feat = enrich_customers(feat, customers)
    numeric = [n for n, t in feat.dtypes if n != "customer_id" and t in ("int", "bigint", "double", "float")]
    return feat.fillna(0, subset=numeric)


# ---------------------------------------------------------------- A22 alerts
def feature_alerts(feat: DataFrame, cfg: RiskConfig) -> DataFrame:
    return feat.agg(
        F.count_if(F.col("cash_near_ctr_count") >= cfg.structuring_count).alias("structuring_suspects"),
        F.count_if(F.col("rapid_movement_count") > 0).alias("rapid_suspects"),
        F.count_if(F.col("high_risk_country_pct") > cfg.geo_alert_cut).alias("geo_suspects"),
    )
