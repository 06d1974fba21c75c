"""Settings for analysis and cleaning, checked when they are made."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Mapping, Optional, Sequence

IMPUTATION_STRATEGIES = ("mean", "median", "mode", "forward_fill", "backward_fill", "drop")
OUTLIER_METHODS = ("iqr", "zscore")


def _within(name: str, value: float, low: float, high: float) -> None:
    if not low <= value <= high:
        raise ValueError(f"{name} must lie in [{low}, {high}], got {value}")


def _one_of(name: str, value: str, allowed: Sequence[str]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")


@dataclass(frozen=True)
class AnalysisConfig:
    sensitive_columns: Sequence[str] = ()
    target_column: Optional[str] = None
    bias_threshold: float = 0.70
    outlier_method: str = "iqr"
    fuzzy_duplicate_threshold: float = 0.85
    run_nlp: bool = True

    def __post_init__(self) -> None:
        _within("bias_threshold", self.bias_threshold, 0.0, 1.0)
        _within("fuzzy_duplicate_threshold", self.fuzzy_duplicate_threshold, 0.0, 1.0)
        _one_of("outlier_method", self.outlier_method, OUTLIER_METHODS)

    @staticmethod
    def threshold_from_tolerance(tolerance_percent: float) -> float:
        """Bias threshold for a tolerance given in percent."""
        return 1.0 - tolerance_percent / 100.0


@dataclass(frozen=True)
class CleaningConfig:
    remove_exact_duplicates: bool = True
    remove_fuzzy_duplicates: bool = True
    fuzzy_threshold: float = 0.90
    impute_missing: bool = True
    imputation_strategy: str = "median"
    column_strategies: Mapping[str, str] = field(default_factory=dict)
    handle_outliers: bool = True
    outlier_method: str = "iqr"
    cap_outliers: bool = True
    iqr_multiplier: float = 1.5
    zscore_threshold: float = 3.0
    infer_types: bool = True
    apply_type_conversions: bool = True

    def __post_init__(self) -> None:
        _within("fuzzy_threshold", self.fuzzy_threshold, 0.0, 1.0)
        _within("iqr_multiplier", self.iqr_multiplier, 0.5, 5.0)
        _within("zscore_threshold", self.zscore_threshold, 1.0, 6.0)
        _one_of("imputation_strategy", self.imputation_strategy, IMPUTATION_STRATEGIES)
        _one_of("outlier_method", self.outlier_method, OUTLIER_METHODS)
        for column, strategy in self.column_strategies.items():
            _one_of(f"strategy of column {column}", strategy, IMPUTATION_STRATEGIES)
