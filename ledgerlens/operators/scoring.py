"""Anomaly scores: z-score, weighted rules, ensemble, summaries.

Population statistics (means, standard deviations, min/max) are one aggregation
whose single row reaches the row-wise expressions as scalar subqueries; nothing
is collected to the driver.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import RULE_OWNED_COLUMNS, RiskConfig
from ..functions.exprs import attach, attach_scalars, clip, numeric_columns


def ml_features(feat: DataFrame) -> list[str]:
    """Numeric feature columns minus the rule-owned ones (schema only)."""
    num = numeric_columns(feat, exclude=("customer_id",))
    cols = [c for c in num if c not in RULE_OWNED_COLUMNS]
    return cols or num[:5]


def _with_stats(feat: DataFrame, cols: Sequence[str], std_fn, cfg: RiskConfig) -> tuple[DataFrame, list[tuple[Column, Column, Column]]]:
    """The frame with one struct of all means and deviations, and per column (x, mean, divisor).

    One wide aggregate; nothing is unpivoted or shuffled. A deviation that is rounding noise of a constant column
    counts as 0, and a zero deviation divides by 1."""
    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]
    aggs = [a for i, e in enumerate(x) for a in (F.avg(e).alias(f"m{i}"), std_fn(e).alias(f"s{i}"))]
    out = attach_scalars(feat, feat, "_stats", *aggs)
    terms = []
    for i, e in enumerate(x):
        m, s = F.col(f"_stats.m{i}"), F.col(f"_stats.s{i}")
        noise = s <= F.lit(cfg.noise_std) * F.greatest(F.lit(1.0), F.abs(m))
        terms.append((e, m, F.when(noise, F.lit(1.0)).otherwise(s)))
    return out, terms


def standardize(feat: DataFrame, cols: Sequence[str], cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """(x - mean) / population std; a zero std divides by 1 (scikit-learn)."""
    out, terms = _with_stats(feat, cols, F.stddev_pop, cfg)
    return out.select("customer_id", *[((x - m) / s).alias(c) for c, (x, m, s) in zip(cols, terms)])


def minmax_invert(df: DataFrame, col: str, out: str) -> DataFrame:
    """1 - (x - min) / (max - min + 1e-10), so 1 = most anomalous for a
    'lower is more anomalous' score."""
    d = attach_scalars(df, df, "_mm", F.min(col).alias("lo"), F.max(col).alias("hi"))
    lo, hi = F.col("_mm.lo"), F.col("_mm.hi")
    return d.withColumn(out, F.lit(1.0) - (F.col(col) - lo) / (hi - lo + F.lit(1e-10))).drop("_mm")


def contamination_cut(df: DataFrame, col: str, contamination: float) -> DataFrame:
    """Clamp contamination to [0.01, 0.3]; rows scoring below that quantile of
    ``col`` (lower = more anomalous) are anomalies. Returns (threshold, anomalies)."""
    c = min(max(contamination, 0.01), 0.3)
    from ..functions.quantiles import exact_quantiles
    d = attach(df, "_q", exact_quantiles(df, col, [c]).select(F.struct(F.col("q_0").alias("thr"))).scalar())
    return d.agg(F.count_if(F.col(col) < F.col("_q.thr")).alias("anomalies"),
                 F.any_value("_q.thr").alias("threshold")).select(
        "threshold", "anomalies", F.lit(c).alias("contamination"))


def zscore_columns(feat: DataFrame, cols: Sequence[str], cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """|x - mean| / sample std (0 std -> 1) per column; row max; capped / cap.
    A single-row population has no sample std: max_z is NULL (scored 0 later)."""
    out, terms = _with_stats(feat, cols, F.stddev_samp, cfg)
    z = [F.abs(x - m) / s for x, m, s in terms]
    z = [F.when(~F.isnan(e), e) for e in z] + [F.lit(None).cast("double")]   # greatest skips nulls
    return out.withColumn("max_z", F.greatest(F.lit(None).cast("double"), *z)).drop("_stats") \
        .withColumn("zscore_score", clip(F.col("max_z"), None, cfg.zscore_cap) / F.lit(cfg.zscore_cap))


def zscore_summary(scored: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    return scored.agg(F.count_if(F.col("max_z") > cfg.zscore_alert).alias("anomalies_above_3sigma"),
                      F.avg("max_z").alias("mean_max_zscore"))


# ---------------------------------------------------------------- rules D7-D14
def _has(df: DataFrame, c: str) -> bool:
    return c in df.columns


def rule_terms(df: DataFrame, cfg: RiskConfig) -> dict[str, tuple[Column, Column]]:
    """Per rule: (hit mask, weighted contribution), in the reference's order."""
    terms: dict[str, tuple[Column, Column]] = {}
    if _has(df, "cash_near_ctr_count"):
        hit = F.col("cash_near_ctr_count") >= cfg.structuring_count
        if _has(df, "structuring_cluster_max"):
            hit = hit | (F.col("structuring_cluster_max") >= cfg.structuring_count)
        terms["structuring"] = (hit, F.when(hit, clip(F.col("cash_near_ctr_count") / cfg.structuring_full, cfg.structuring_floor, 1.0))
                                .otherwise(0.0) * cfg.rule_structuring_w)
    if _has(df, "velocity_ratio_7d"):
        hit = F.col("velocity_ratio_7d") >= cfg.velocity_multiplier
        terms["velocity_spike"] = (hit, F.when(hit, clip(F.col("velocity_ratio_7d") / cfg.velocity_full, cfg.velocity_floor, 1.0))
                                   .otherwise(0.0) * cfg.rule_velocity_w)
    if _has(df, "rapid_movement_count"):
        hit = F.col("rapid_movement_count") > 0
        terms["rapid_movement"] = (hit, F.when(hit, clip(F.col("rapid_movement_count") / cfg.rapid_full, cfg.rapid_floor, 1.0))
                                   .otherwise(0.0) * cfg.rule_rapid_w)
    if _has(df, "high_risk_country_pct"):
        hit = F.col("high_risk_country_pct") > cfg.geo_rule_cut
        terms["geographic_risk"] = (hit, F.when(hit, clip(F.col("high_risk_country_pct"), None, 1.0))
                                    .otherwise(0.0) * cfg.rule_geo_w)
    if _has(df, "dormancy_flag"):
        hit = F.col("dormancy_flag") == 1
        terms["dormancy_activation"] = (hit, F.when(hit, F.lit(cfg.rule_dormancy_add)).otherwise(0.0))
    if _has(df, "circular_flow_count"):
        hit = F.col("circular_flow_count") > 0
        terms["round_tripping"] = (hit, F.when(hit, clip(F.col("circular_flow_count") / cfg.circular_full, cfg.circular_floor, 1.0))
                                   .otherwise(0.0) * cfg.rule_circular_w)
    return terms


def rule_score_expr(df: DataFrame, cfg: RiskConfig) -> Column:
    """Terms added in the reference's order, PEP amplifier after them,
    KYC add-on after that, then clipped to [0, 1]."""
    s = F.lit(0.0)
    for _, (_, contrib) in rule_terms(df, cfg).items():
        s = s + contrib
    if _has(df, "pep_flag"):
        s = F.when(F.col("pep_flag") == 1, s * cfg.pep_multiplier).otherwise(s)
    if _has(df, "kyc_status_encoded"):
        s = F.when(F.col("kyc_status_encoded") >= 1, s + cfg.kyc_add).otherwise(s)
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


def score_rules(feat: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    return feat.withColumn("rule_score", rule_score_expr(feat, cfg))


def single_rule(feat: DataFrame, rule: str, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """One rule's hit flag and weighted contribution (D7-D12 individually)."""
    hit, contrib = rule_terms(feat, cfg)[rule]
    return feat.select("customer_id", hit.alias("hit"), contrib.alias("contribution"))


def rule_hit_counts(scored: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Hits per rule plus customers with rule score above the low cut."""
    terms = rule_terms(scored, cfg)
    aggs = [F.count_if(hit).alias(name) for name, (hit, _) in terms.items()]
    if _has(scored, "pep_flag"):
        aggs.append(F.count_if(F.col("pep_flag") == 1).alias("pep_amplified"))
    aggs.append(F.count_if(F.col("rule_score") > cfg.risk_low_upper).alias("rule_anomalies"))
    wide = scored.agg(*aggs)
    names = [a for a in wide.columns]
    return wide.unpivot([], names, "rule", "hits")


def ensemble(scores: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Weighted mean of the score columns present, renormalised by the
    weights present; NULL (e.g. single-row std) -> 0 afterwards."""
    parts = [(c, w) for c, w in (("isolation_forest_score", cfg.w_forest), ("zscore_score", cfg.w_zscore),
                                 ("rule_score", cfg.w_rules)) if c in scores.columns]
    s = F.lit(0.0)
    total = 0.0
    for c, w in parts:
        s = s + F.col(c) * w
        total += w
    if total > 0:
        s = s / F.lit(total)
    out = scores.withColumn("ensemble_score", s).withColumn("anomaly_score", F.col("ensemble_score"))
    fill = [c for c, _ in parts] + ["ensemble_score", "anomaly_score"]
    return out.fillna(0.0, subset=fill)


def detect_anomalies(feat: DataFrame, cfg: RiskConfig = RiskConfig(), method: str = "ensemble",
                     forest: bool = True, ordered: bool = True) -> DataFrame:
    """D1-D18 composed: returns customer_id plus the score columns and ``anomaly_score``.

    ``method`` in {ensemble, isolation_forest, zscore, rules}; ``forest=False``
    drops the forest from the ensemble (legal: the weights renormalise). Highest scores first; ``ordered=False``
    for callers that join the scores on."""
    out = _scores(feat, cfg, method, forest)
    return out.orderBy(F.col("anomaly_score").desc(), "customer_id") if ordered else out


def _scores(feat: DataFrame, cfg: RiskConfig, method: str, forest: bool) -> DataFrame:
    cols = ml_features(feat)
    out = feat.select("customer_id", *[c for c in feat.columns if c != "customer_id"])
    keep = ["customer_id"]
    if method in ("isolation_forest", "ensemble") and forest:
        from .iforest import isolation_forest_scores
        ifs = isolation_forest_scores(feat, cols, cfg)
        out = out.join(ifs.hint("shuffle_hash"), "customer_id", "left")
        keep.append("isolation_forest_score")
    if method in ("zscore", "ensemble"):
        out = zscore_columns(out, cols, cfg)
        keep.append("zscore_score")
    if method in ("rules", "ensemble"):
        out = score_rules(out, cfg)
        keep.append("rule_score")
    out = out.select(*keep)
    if method == "ensemble":
        return ensemble(out, cfg)
    col = {"isolation_forest": "isolation_forest_score", "zscore": "zscore_score"}.get(method, "rule_score")
    return out.withColumn("anomaly_score", F.col(col)).fillna(0.0, subset=[c for c in keep[1:]] + ["anomaly_score"])


def anomaly_summary(scores: DataFrame, cfg: RiskConfig = RiskConfig()) -> DataFrame:
    """Analysed count and customers above the three level cuts."""
    s = F.col("anomaly_score")
    return scores.agg(F.count(F.lit(1)).alias("analyzed"),
                      F.count_if(s > cfg.risk_low_upper).alias("flagged"),
                      F.count_if(s > cfg.risk_medium_upper).alias("high_risk"),
                      F.count_if(s > cfg.risk_high_upper).alias("critical"))
