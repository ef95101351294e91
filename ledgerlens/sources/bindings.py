"""Fixture bindings: the ledger, customer and feedback views over the driver's tables.

Each binding exists twice, once as a Spark DataFrame and once as a DuckDB CTE, so
that every registered query can be checked against an independent SQL oracle.
See FIXTURES.md §2 for the column rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..session import stored

# Binding parameters from FIXTURES.md §3.
HIGH_RISK_REGION = "AFRICA"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: a country table of at most so many rows is broadcast
COUNTRY_ROWS = 1 << 20


def _customer_country(spark: SparkSession, sf_dir: str, keys: DataFrame) -> DataFrame:
    """(_cp_key, _cp_country) of the customers among the one column ``keys``, stored and counted.

    A ledger names far fewer counterparties than there are customers: up to ``COUNTRY_ROWS`` of them reach the ledger
    by a broadcast, so that it is not shuffled once more on a column of few frequent values; beyond it by a join."""
    cust = _t(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nat = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    named = keys.select(F.col(keys.columns[0]).alias("c_custkey")).distinct()
    cust = cust.join(named.hint("shuffle_hash"), "c_custkey", "left_semi")
    out = stored(cust.join(nat, cust.c_nationkey == nat.n_nationkey, "left").select(
        F.col("c_custkey").alias("_cp_key"), F.col("n_name").alias("_cp_country")))
    return F.broadcast(out) if out.count() <= COUNTRY_ROWS else out


def ledger_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding T: intra-day ledger derived from ``events``."""
    ev = _t(spark, sf_dir, "events")
    et = F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("bigint")
    base = ev.select(
        F.col("event_id").alias("transaction_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").alias("timestamp"),
        F.round(F.col("value") * 100, 2).alias("amount"),
        F.when(et.isin("click", "signup"), "deposit")
         .when(et == "error", "withdrawal")
         .when(et == "view", "transfer")
         .when(et == "purchase", "wire_transfer").alias("transaction_type"),
        F.element_at(F.array(*[F.lit(c) for c in ("branch", "online", "atm", "mobile")]),
                     (F.col("event_id") % 4 + 1).cast("int")).alias("channel"),
        F.when(et.isin("view", "purchase"), k).alias("counterparty_id"),
        k.alias("_k"),
        et.isin("signup", "error").alias("is_cash"),
        (F.col("value") >= 200).alias("ground_truth_flag"),
        F.when(F.col("value") >= 200, "LARGE").otherwise("none").alias("ground_truth_pattern"),
    )
    cc = _customer_country(spark, sf_dir, base.select("_k"))
    out = base.join(cc, base._k == cc._cp_key, "left")
    return out.select(
        "transaction_id", "customer_id", "timestamp", "amount", "transaction_type", "channel",
        "counterparty_id", F.col("_cp_country").alias("counterparty_country"), "is_cash",
        "ground_truth_flag", "ground_truth_pattern")


def ledger_l(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding L: long-history ledger from ``lineitem`` joined to ``orders``."""
    li = _t(spark, sf_dir, "lineitem")
    od = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    # orders are hashed, so that neither side is sorted (and spilled)
    j = li.join(od.hint("shuffle_hash"), li.l_orderkey == od.o_orderkey, "inner")
    base = j.select(
        F.concat_ws("-", *[F.col(c).cast("string") for c in
                           ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("l_shipdate").alias("timestamp"),
        F.col("l_extendedprice").alias("amount"),
        F.when(rf == "A", "deposit").when(rf == "N", "withdrawal")
         .when((rf == "R") & (ls == "F"), "transfer")
         .when((rf == "R") & (ls == "O"), "wire_transfer").alias("transaction_type"),
        F.col("o_orderpriority").alias("channel"),
        F.when(rf == "R", F.col("l_suppkey")).alias("counterparty_id"),
        F.col("l_suppkey").alias("_k"),
        ((ls == "O") & (rf != "R")).alias("is_cash"),
    )
    cc = _customer_country(spark, sf_dir, li.select("l_suppkey"))
    out = base.join(cc, base._k == cc._cp_key, "left")
    return out.select(
        "transaction_id", "customer_id", "timestamp", "amount", "transaction_type", "channel",
        "counterparty_id", F.col("_cp_country").alias("counterparty_country"), "is_cash")


def customers_c(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding C: customer dimension."""
    c = _t(spark, sf_dir, "customer")
    n = _t(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left")
    m10 = F.col("c_custkey") % 10
    return j.select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        F.lower("c_mktsegment").alias("account_type"),
        F.col("n_name").alias("country"),
        F.when(F.col("c_acctbal") < 0, "high").when(F.col("c_acctbal") < 2000, "medium")
         .otherwise("low").alias("risk_category"),
        (F.col("c_custkey") % 20 == 0).alias("pep_flag"),
        F.when(m10 == 0, "expired").when(m10 == 1, "pending").otherwise("verified").alias("kyc_status"),
    )


def feedback_fb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binding FB: analyst decisions derived from ``events``."""
    ev = _t(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "error"))
    return ev.select(
        F.col("ts").alias("timestamp"),
        F.col("user_id").alias("entity_id"),
        F.when(F.col("event_type") == "click", "Confirm").otherwise("False Positive").alias("decision"),
    )


def high_risk_nations(spark: SparkSession, sf_dir: str, region: str = HIGH_RISK_REGION) -> DataFrame:
    """One-column frame ``country`` of the nations in ``region``. Bounded by the
    nation dimension, so operators may broadcast it."""
    n = _t(spark, sf_dir, "nation")
    r = _t(spark, sf_dir, "region").filter(F.col("r_name") == region)
    return n.join(r, n.n_regionkey == r.r_regionkey, "left_semi").select(F.col("n_name").alias("country"))


def config_t(spark: SparkSession, sf_dir: str) -> RiskConfig:
    return RiskConfig(rapid_min_deposit=5000.0, dormancy_days=2, velocity_multiplier=1.2, pagerank_iterations=10,
                      high_risk_countries=high_risk_nations(spark, sf_dir))


def config_l(spark: SparkSession, sf_dir: str) -> RiskConfig:
    return RiskConfig(velocity_multiplier=1.2, pagerank_iterations=10, high_risk_countries=high_risk_nations(spark, sf_dir))


# ---------------------------------------------------------------- DuckDB twins
T_SQL = """
t AS (
  SELECT e.event_id AS transaction_id, e.user_id AS customer_id, e.ts AS "timestamp",
         round(e.value * 100, 2) AS amount,
         CASE WHEN e.event_type IN ('click','signup') THEN 'deposit'
              WHEN e.event_type = 'error' THEN 'withdrawal'
              WHEN e.event_type = 'view' THEN 'transfer'
              WHEN e.event_type = 'purchase' THEN 'wire_transfer' END AS transaction_type,
         CASE e.event_id % 4 WHEN 0 THEN 'branch' WHEN 1 THEN 'online' WHEN 2 THEN 'atm' ELSE 'mobile' END AS channel,
         CASE WHEN e.event_type IN ('view','purchase') THEN CAST(json_extract_string(e.props, '$.k') AS BIGINT) END AS counterparty_id,
         cn.n_name AS counterparty_country,
         e.event_type IN ('signup','error') AS is_cash,
         e.value >= 200 AS ground_truth_flag,
         CASE WHEN e.value >= 200 THEN 'LARGE' ELSE 'none' END AS ground_truth_pattern
  FROM events e
  LEFT JOIN customer cc ON cc.c_custkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
  LEFT JOIN nation cn ON cn.n_nationkey = cc.c_nationkey
)"""

L_SQL = """
l AS (
  SELECT concat_ws('-', li.l_orderkey, li.l_linenumber, li.l_partkey, li.l_suppkey) AS transaction_id,
         o.o_custkey AS customer_id, li.l_shipdate AS "timestamp", li.l_extendedprice AS amount,
         CASE WHEN li.l_returnflag = 'A' THEN 'deposit' WHEN li.l_returnflag = 'N' THEN 'withdrawal'
              WHEN li.l_returnflag = 'R' AND li.l_linestatus = 'F' THEN 'transfer'
              WHEN li.l_returnflag = 'R' AND li.l_linestatus = 'O' THEN 'wire_transfer' END AS transaction_type,
         o.o_orderpriority AS channel,
         CASE WHEN li.l_returnflag = 'R' THEN li.l_suppkey END AS counterparty_id,
         cn.n_name AS counterparty_country,
         (li.l_linestatus = 'O' AND li.l_returnflag <> 'R') AS is_cash
  FROM lineitem li JOIN orders o ON li.l_orderkey = o.o_orderkey
  LEFT JOIN customer cc ON cc.c_custkey = li.l_suppkey
  LEFT JOIN nation cn ON cn.n_nationkey = cc.c_nationkey
)"""

C_SQL = """
c AS (
  SELECT cu.c_custkey AS customer_id, cu.c_name AS name, lower(cu.c_mktsegment) AS account_type,
         n.n_name AS country,
         CASE WHEN cu.c_acctbal < 0 THEN 'high' WHEN cu.c_acctbal < 2000 THEN 'medium' ELSE 'low' END AS risk_category,
         (cu.c_custkey % 20 = 0) AS pep_flag,
         CASE cu.c_custkey % 10 WHEN 0 THEN 'expired' WHEN 1 THEN 'pending' ELSE 'verified' END AS kyc_status
  FROM customer cu LEFT JOIN nation n ON cu.c_nationkey = n.n_nationkey
)"""

FB_SQL = """
fb AS (
  SELECT ts AS "timestamp", user_id AS entity_id,
         CASE WHEN event_type = 'click' THEN 'Confirm' ELSE 'False Positive' END AS decision
  FROM events WHERE event_type IN ('click','error')
)"""

HR_SQL = f"""
hr AS (
  SELECT n_name AS country FROM nation
  WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = '{HIGH_RISK_REGION}')
)"""
