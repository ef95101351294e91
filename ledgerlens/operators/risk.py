"""Risk levels and escalation."""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RiskConfig
from ..functions.exprs import action_of, actions_frame, level_of, levels_frame


def top_by_score(df: DataFrame, n: int, score: str = "anomaly_score") -> DataFrame:
    """Top-n by score; ties broken by customer_id (deterministic).
    Planned as TakeOrderedAndProject: each task keeps n rows, the driver merges n x tasks."""
    return df.orderBy(F.col(score).desc(), F.col("customer_id").asc()).limit(n)


def classify_risk(scores: DataFrame, features: Optional[DataFrame] = None,
                  customers: Optional[DataFrame] = None, cfg: RiskConfig = RiskConfig(),
                  score_column: str = "anomaly_score", top_n: Optional[int] = None) -> DataFrame:
    """R1-R4 (+R5, R6): level by cut, action by level, PEP and expired-KYC upgrades,
    customer columns added when not yet present."""
    df = scores
    if top_n:
        df = top_by_score(df, top_n, score_column)
    s = F.col(score_column)
    lvl = level_of(s, cfg)
    ctx_cols = []
    if features is not None:
        ctx_cols = [c for c in ("pep_flag", "kyc_status_encoded") if c in features.columns]
        if ctx_cols:
            ctx = features.select("customer_id", *[F.col(c).alias(f"_ctx_{c}") for c in ctx_cols])
            df = df.join(ctx.hint("shuffle_hash"), "customer_id", "left")   # rows per customer: no broadcast
    if "pep_flag" in ctx_cols:
        pep = F.coalesce(F.col("_ctx_pep_flag") == 1, F.lit(False))
        lvl = F.when(pep & (lvl == "medium"), "high").otherwise(lvl)
        lvl = F.when(pep & (lvl == "high") & (s > cfg.pep_critical_cut), "critical").otherwise(lvl)
    if "kyc_status_encoded" in ctx_cols:
        exp = F.coalesce(F.col("_ctx_kyc_status_encoded") == 2, F.lit(False))
        lvl = F.when(exp & (lvl == "low") & (s > cfg.kyc_medium_cut), "medium").otherwise(lvl)
    df = df.withColumn("risk_level", lvl).withColumn("escalation_action", action_of(F.col("risk_level")))
    df = df.drop(*[f"_ctx_{c}" for c in ctx_cols])
    if customers is not None:
        add = [c for c in ("name", "account_type", "country", "pep_flag")
               if c in customers.columns and c not in df.columns]
        if add:
            dim = customers.select("customer_id", *add).dropDuplicates(["customer_id"])
            df = df.join(dim.hint("shuffle_hash"), "customer_id", "left")
    return df


def risk_distribution(classified: DataFrame) -> DataFrame:
    """Count and share per level, zero-filled, fixed order."""
    spark = classified.sparkSession
    counts = classified.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    total = classified.select(F.count(F.lit(1))).scalar()
    out = levels_frame(spark).join(counts, "risk_level", "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return out.select("risk_level", "level_order", n.alias("customers"),
                      F.round(F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)), 4).alias("share_pct"))


def action_distribution(classified: DataFrame) -> DataFrame:
    """Count per action, zero-filled."""
    spark = classified.sparkSession
    counts = classified.groupBy("escalation_action").agg(F.count(F.lit(1)).alias("n"))
    return actions_frame(spark).join(counts, "escalation_action", "left").select(
        "escalation_action", "action_order", F.coalesce(F.col("n"), F.lit(0)).alias("customers"))


def score_histogram(classified: DataFrame, cfg: RiskConfig = RiskConfig(), bins: int = 29,
                    score: str = "anomaly_score") -> DataFrame:
    """Equal-width bins on [0, 1] (last bin closed), each with the level band of
    its left edge."""
    from .profile import histogram
    h = histogram(classified, score, bins, lo=0.0, hi=1.0)
    edge = F.col("bin_lo")
    band = (F.when(edge >= cfg.risk_high_upper, "critical").when(edge >= cfg.risk_medium_upper, "high")
            .when(edge >= cfg.risk_low_upper, "medium").otherwise("low"))
    return h.withColumn("band", band)
