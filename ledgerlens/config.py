"""Run parameters.

Every threshold an operator uses comes from ``RiskConfig``; no operator body holds
a threshold constant, so fixtures can bind other values (FIXTURES.md §3).
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Optional, Sequence

# Fixed values that must equal the reference's defaults for identical results.
DEFAULT_HIGH_RISK_COUNTRIES = (
    "KY", "PA", "VG", "BS", "BZ", "MM", "KP", "IR", "SY", "AF", "YE", "SO", "MT", "CY",
)

# Ordinal encodings, level order and level -> action map.
RISK_CATEGORY_CODES = (("low", 0), ("medium", 1), ("high", 2))
KYC_STATUS_CODES = (("verified", 0), ("pending", 1), ("expired", 2))
RISK_LEVELS = ("low", "medium", "high", "critical")
LEVEL_ACTIONS = (
    ("low", "no_action"),
    ("medium", "monitor"),
    ("high", "flag_for_review"),
    ("critical", "file_sar"),
)

# Columns the anomaly scorer leaves to the rules.
RULE_OWNED_COLUMNS = (
    "risk_category_encoded", "kyc_status_encoded", "pep_flag",
    "dormancy_flag", "rapid_movement_count",
)


@dataclass(frozen=True)
class RiskConfig:
    median_accuracy: Optional[int] = None   # None = exact median; k = percentile_approx sketch (bounded per customer)
    # structuring
    ctr_threshold: float = 10000.0          # exclusive upper end of the near-CTR band
    structuring_lower: float = 8000.0       # inclusive lower end
    structuring_count: int = 3
    structuring_window_days: int = 7
    # velocity / movement / dormancy
    velocity_multiplier: float = 5.0
    rapid_hours: int = 24
    rapid_min_deposit: float = 20000.0
    rapid_ratio: float = 0.7
    dormancy_days: int = 90
    # levels
    risk_low_upper: float = 0.3
    risk_medium_upper: float = 0.6
    risk_high_upper: float = 0.8
    pep_critical_cut: float = 0.65
    kyc_medium_cut: float = 0.15
    high_risk_countries: Sequence[str] = DEFAULT_HIGH_RISK_COUNTRIES
    # the 1,024 customers at most with the most rows, all above this, are cut into slabs (results do not depend on it)
    heavy_rows: int = 100_000
    # graph
    pagerank_alpha: float = 0.85
    pagerank_tol: float = 1e-6              # iterate until the L1 change is below nodes * tol
    pagerank_iterations: Optional[int] = None   # set -> exactly so many steps (comparable with an unrolled oracle)
    pagerank_checkpoint_every: int = 1      # cut lineage every k iterations (reliable checkpoint)
    cycle_max_len: int = 4
    # forest
    forest_trees: int = 200
    forest_sample: int = 256
    forest_seed: int = 42
    contamination: float = 0.1
    # ensemble weights and rule weights
    w_forest: float = 0.30
    w_zscore: float = 0.25
    w_rules: float = 0.45
    geo_rule_cut: float = 0.2
    geo_alert_cut: float = 0.3
    rule_structuring_w: float = 0.35
    rule_velocity_w: float = 0.20
    rule_rapid_w: float = 0.25
    rule_geo_w: float = 0.15
    rule_dormancy_add: float = 0.20
    rule_circular_w: float = 0.25
    # a rule's strength: count / full, between floor and 1
    structuring_full: float = 10.0
    structuring_floor: float = 0.3
    velocity_full: float = 20.0
    velocity_floor: float = 0.3
    rapid_full: float = 5.0
    rapid_floor: float = 0.4
    circular_full: float = 2.0
    circular_floor: float = 0.5
    pep_multiplier: float = 1.3
    kyc_add: float = 0.05
    zscore_cap: float = 10.0
    zscore_alert: float = 3.0
    noise_std: float = 1e-12                # a deviation this small relative to the mean is rounding noise of a constant
    # explanation cuts (the explanation keeps its own velocity cut of 5)
    explain_velocity_cut: float = 5.0
    unusual_time_cut: float = 0.4
    unusual_time_base: float = 0.28
    amount_cv_cut: float = 3.0
    pagerank_cut: float = 0.05

    def with_(self, **kw) -> "RiskConfig":
        return replace(self, **kw)


@dataclass(frozen=True)
class FilterSpec:
    """Conjunction of row filters (F1-F5, F11). ``None``/empty means unset."""

    customer_ids: Sequence = field(default_factory=tuple)
    date_start: Optional[str] = None
    date_end: Optional[str] = None
    end_of_day: bool = True                 # False restores "date-only end = midnight"
    min_amount: Optional[float] = None
    max_amount: Optional[float] = None
    transaction_types: Sequence[str] = field(default_factory=tuple)
    countries: Sequence[str] = field(default_factory=tuple)
    channels: Sequence[str] = field(default_factory=tuple)
