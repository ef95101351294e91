"""Analyst feedback and evaluation (V1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import RISK_LEVELS

# Decision labels of the feedback log.
CONFIRM = "Confirm"
FALSE_POSITIVE = "False Positive"


def feedback_stats(fb: DataFrame) -> DataFrame:
    """H1: counts of confirmed and false-positive decisions."""
    return fb.agg(F.count_if(F.col("decision") == CONFIRM).alias("confirmed"),
                  F.count_if(F.col("decision") == FALSE_POSITIVE).alias("false_positives"))


def feedback_latest(fb: DataFrame) -> DataFrame:
    """H2: current verdict per entity -- the latest decision wins (one aggregate,
    map-side combinable; no window over a possibly hot entity)."""
    return fb.groupBy("entity_id").agg(F.max_by("decision", "timestamp").alias("decision"),
                                       F.max("timestamp").alias("decided_at"))


def risk_after_feedback(classified: DataFrame, fb: DataFrame) -> DataFrame:
    """H4 (and H3 when no feedback): flagged (not low) entities per level after
    striking those whose latest verdict is a false positive; zero-filled."""
    fp = feedback_latest(fb).filter(F.col("decision") == FALSE_POSITIVE).select(
        F.col("entity_id").alias("customer_id"))
    kept = classified.filter(F.col("risk_level") != "low").join(fp, "customer_id", "left_anti")
    counts = kept.groupBy("risk_level").agg(F.count(F.lit(1)).alias("n"))
    spark = classified.sparkSession
    levels = spark.createDataFrame([(lv,) for lv in RISK_LEVELS if lv != "low"], "risk_level string")
    return levels.join(counts, "risk_level", "left").select(
        "risk_level", F.coalesce(F.col("n"), F.lit(0)).alias("customers"))


def top_entities(classified: DataFrame, n: int = 8) -> DataFrame:
    """H5: side list of the n highest-scoring flagged entities."""
    return classified.filter(F.col("risk_level") != "low") \
        .orderBy(F.col("anomaly_score").desc(), F.col("customer_id").asc()).limit(n) \
        .select("customer_id", "anomaly_score", "risk_level")


def eval_metrics(classified: DataFrame, tx: DataFrame) -> DataFrame:
    """V1: precision / recall / F1 of 'flagged' (not low) against customers with
    any ground-truth-positive row."""
    truth = tx.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.max(F.coalesce(F.col("ground_truth_flag"), F.lit(False)).cast("int")).alias("actual"))
    j = classified.select("customer_id", (F.col("risk_level") != "low").cast("int").alias("pred")) \
        .join(truth, "customer_id", "full").fillna(0, subset=["pred", "actual"])
    m = j.agg(F.count_if((F.col("pred") == 1) & (F.col("actual") == 1)).alias("tp"),
              F.count_if((F.col("pred") == 1) & (F.col("actual") == 0)).alias("fp"),
              F.count_if((F.col("pred") == 0) & (F.col("actual") == 1)).alias("fn"),
              F.count_if((F.col("pred") == 0) & (F.col("actual") == 0)).alias("tn"))
    p = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp"))
    r = F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("tp", "fp", "fn", "tn", p.alias("precision"), r.alias("recall"),
                    F.try_divide(2 * p * r, p + r).alias("f1"))
