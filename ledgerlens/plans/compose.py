"""Compositions of the operators: what the reference's
stages do end to end, as lazy DataFrame chains."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import FilterSpec, RiskConfig
from ..operators.explain import flagged_entities
from ..operators.features import engineer_features
from ..operators.filters import apply_filters
from ..operators.risk import classify_risk
from ..functions.exprs import known_number, numeric_columns
from ..operators.scoring import detect_anomalies, rule_terms


def analyse(tx: DataFrame, customers: Optional[DataFrame], cfg: RiskConfig, method: str = "rules",
            forest: bool = True, spec: Optional[FilterSpec] = None, scope: str = "population",
            features: Optional[DataFrame] = None):
    """Q5: features -> scores -> levels. Returns (features, scores, classified).

    ``scope='population'`` scores everyone and leaves entity selection to the caller
    (filter last); ``scope='filtered'`` applies ``spec`` before the features, as the
    reference does."""
    if spec is not None and scope == "filtered":
        tx = apply_filters(tx, spec)
    if features is None:
        # one row per customer, read by scoring, classification and explanation:
        # persisted once (size bounded by the customer count, not the ledger)
        features = engineer_features(tx, customers, cfg).persist(StorageLevel.MEMORY_AND_DISK)
    feat = features
    scores = detect_anomalies(feat, cfg, method=method, forest=forest, ordered=False)
    classified = classify_risk(scores, feat, customers, cfg)
    return feat, scores, classified


def threshold_customers(tx: DataFrame, n: int, min_amount: Optional[float] = None,
                        max_amount: Optional[float] = None, cash_only: bool = False) -> DataFrame:
    """Q1: per customer rows with min <= amount < max (optional cash only), kept when >= n.
    0 is a real bound here (the reference treated it as unset). NaN amounts count as missing."""
    df = tx.filter(F.col("customer_id").isNotNull())
    if max_amount is not None:
        df = df.filter(F.col("amount") < max_amount)
    if min_amount is not None:
        df = df.filter((F.col("amount") >= min_amount) & ~F.isnan(F.col("amount").cast("double")))
    if cash_only:
        df = df.filter(F.coalesce(F.col("is_cash"), F.lit(False)))
    g = df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("txn_count"), F.sum(known_number(F.col("amount"))).alias("total_amount"))
    return g.filter(F.col("txn_count") >= n)


def entity_lookup(classified: DataFrame, features: DataFrame, customers: Optional[DataFrame],
                  ids: Sequence, cfg: RiskConfig) -> DataFrame:
    """Q3: evidence for the listed entities, scored against the whole population,
    every level kept (the lookup explains all)."""
    sel = classified.filter(F.col("customer_id").isin(list(ids)))
    return flagged_entities(sel, features, customers, cfg, top_n=None, level="low")


def entity_compare(features: DataFrame, ids: Sequence, cols: Optional[Sequence[str]] = None) -> DataFrame:
    """Q4: feature x customer long table for the listed customers, every numeric feature by default."""
    cols = list(cols or numeric_columns(features, exclude=("customer_id",)))
    sel = features.filter(F.col("customer_id").isin(list(ids))) \
        .select("customer_id", *[F.col(c).cast("double").alias(c) for c in cols])
    return sel.unpivot(["customer_id"], list(cols), "feature", "value")


PATTERN_RULES = {"structuring": "structuring", "rapid": "rapid_movement", "velocity": "velocity_spike",
                 "dormant": "dormancy_activation", "geographic": "geographic_risk",
                 "round_trip": "round_tripping"}


def pattern_search(features: DataFrame, classified: DataFrame, pattern: str, cfg: RiskConfig) -> DataFrame:
    """Q6: customers hit by one rule, with that rule's contribution and their level,
    ordered by the contribution then the overall score."""
    rule = PATTERN_RULES[pattern]
    hit, contrib = rule_terms(features, cfg)[rule]
    f = features.select("customer_id", hit.alias("hit"), contrib.alias("contribution")).filter("hit")
    # a row per customer on both sides: joined by hashed partitions, not sent through the driver
    out = f.join(classified.select("customer_id", "anomaly_score", "risk_level").hint("shuffle_hash"), "customer_id")
    return out.select("customer_id", "contribution", "anomaly_score", "risk_level") \
        .orderBy(F.col("contribution").desc(), F.col("anomaly_score").desc(), F.col("customer_id"))


def type_search(tx: DataFrame, customers: Optional[DataFrame], types: Sequence[str], cfg: RiskConfig) -> DataFrame:
    """Q6 by transaction type (e.g. wires only): features, rule scores and levels of the customers with such rows,
    computed from these rows alone; highest scores first."""
    feat, _, classified = analyse(tx, customers, cfg, spec=FilterSpec(transaction_types=tuple(types)), scope="filtered")
    out = classified.select("customer_id", "anomaly_score", "risk_level").join(
        feat.select("customer_id", "total_transactions", "total_amount", "network_out_degree"), "customer_id")
    return out.orderBy(F.col("anomaly_score").desc(), "customer_id")


def run_totals(tx: DataFrame, classified: DataFrame) -> DataFrame:
    """Q7: rows analysed and entities flagged (not low)."""
    flagged = classified.select(F.count_if(F.col("risk_level") != "low")).scalar()
    return tx.agg(F.count(F.lit(1)).alias("total_analyzed")).withColumn("total_flagged", flagged)
