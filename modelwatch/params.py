"""Parameters and their defaults (one place, passed explicitly to operators)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values that must equal the reference's defaults.
    threshold: float = 0.5            # decision threshold, inclusive
    selection_metric: str = "pr_auc"  # candidate ranking and promotion metric
    min_improvement: float = 0.0      # promotion margin (and improvement must be > 0)
    psi_threshold: float = 0.2        # DRIFT when psi > threshold
    psi_bins: int = 10                # interior PSI bins
    psi_smoothing: float = 0.5        # additive smoothing per bin count
    min_production_samples: int = 20  # below this a feature is "insufficient"
    drift_feature_limit: int = 2      # drifting features that recommend retraining
    train_fraction: float = 0.8       # tenure-ordered split
    iqr_multiplier: float = 1.5
    calibration_bins: int = 10
    high_risk: float = 0.7
    low_risk: float = 0.3
    low_confidence: float = 0.6
    high_confidence: float = 0.9
    class_balance_shift: float = 0.10
    background_size: int = 100
    seed: int = 42
    drivers_per_side: int = 5
    max_attempts: int = 5
    claim_batch: int = 50
    lease_seconds: int = 60           # max(6 * poll of 5 s, 60)
    roc_auc_floor: float = 0.55
    rate_limit_per_minute: int = 120
    error_rate_bound: float = 0.02
    p95_bound_seconds: float = 0.5


DEFAULTS = Params()

# Latency histogram bucket bounds (seconds), then +Inf.
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0, 5.0)

# Prediction-confidence histogram bucket bounds.
CONFIDENCE_BUCKETS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 1.0)

# Experiment directory name pattern.
EXPERIMENT_NAME_PATTERN = r"^churn_model_\d{8}_\d{6}$"
