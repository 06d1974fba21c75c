"""grainsift: dataset quality measurement and repair on Spark DataFrames."""

from grainsift.config import AnalysisConfig, CleaningConfig

__all__ = ["AnalysisConfig", "CleaningConfig"]
