"""Composite reports: sections of tidy rows, and all of them in one nested row."""

from __future__ import annotations

from functools import reduce
from typing import Mapping, Optional

from pyspark.sql import DataFrame, functions as F

from grainsift.config import AnalysisConfig
from grainsift.operators.materialize import materialize
from grainsift.operators import balance, bias, duplicates, nearpairs, noise, outliers, profile
from grainsift.operators.aggkit import tidy_schema_rows
from grainsift.operators.textscan import nlp_report
from grainsift.plans.scoring import Analysis, basic_score, classify_issues, quality_score


def as_sections(parts: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of several reports as (section, item), each item one JSON text."""
    frames = [frame.select(F.lit(name).alias("section"),
                           F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("item"))
              for name, frame in parts.items()]
    return reduce(DataFrame.unionByName, frames)


def _config_row(df: DataFrame, config: AnalysisConfig) -> DataFrame:
    return tidy_schema_rows(df, [(",".join(config.sensitive_columns), config.target_column, config.bias_threshold)],
                            "sensitive_columns string, target_column string, bias_threshold double")


def summary_sections(analysis: Analysis) -> dict[str, DataFrame]:
    """Figures of all sub-reports together with the description of the number columns."""
    parts = {
        "dataset": analysis.info,
        "constant_columns": analysis.constant,
        "high_cardinality_columns": analysis.high_cardinality,
        "formatting_errors": analysis.formatting,
        "outliers": analysis.outliers.filter("outlier_count > 0"),
        "duplicates": analysis.duplicates,
        "bias_details": analysis.bias,
        "bias": analysis.bias_summary,
        "imbalance": analysis.imbalance,
        "numeric_stats": analysis.describe,
        "config": _config_row(analysis.df, analysis.config),
    }
    if analysis.classes is not None:
        parts["class_distribution"] = analysis.classes
    return parts


def statistical_summary(df: DataFrame, config: AnalysisConfig, row_id: str) -> DataFrame:
    """All figures as rows (section, item)."""
    return as_sections(summary_sections(Analysis(df, config, row_id)))


def quality_sections(df: DataFrame, config: AnalysisConfig, row_id: str) -> DataFrame:
    """The whole quality report as (section, item) rows."""
    analysis = Analysis(df, config, row_id)
    parts = {"score": analysis.score, "issues": classify_issues(analysis), **summary_sections(analysis)}
    if config.run_nlp:
        parts["text"] = nlp_report(analysis.data)
    return as_sections(parts)


def quality_report(df: DataFrame, config: AnalysisConfig, row_id: str) -> DataFrame:
    return quality_sections(df, config, row_id)


def library_sections(df: DataFrame, row_id: str, target: Optional[str] = None) -> DataFrame:
    """Profile, basic score, noise, duplicates, redundancy and balance metrics of a table."""
    data = df.drop(row_id)
    pairs = materialize(nearpairs.near_duplicates(df, row_id))
    structure = noise.structural_noise(df, row_id)
    parts = {
        "profile": profile.profile_columns(data),
        "numeric_profile": profile.profile_numeric(data),
        "quality_score": basic_score(data),
        "outliers": outliers.outliers_iqr(data),
        "datatype_noise": noise.datatype_noise(data),
        "value_noise": noise.value_noise(data),
        "structural_noise": structure.filter("kind <> 'empty_row'"),
        "empty_rows": structure.agg(F.count_if(F.col("kind") == "empty_row").alias("n_rows")),
        "exact_duplicates": duplicates.exact_duplicates(data),
        "near_duplicates": pairs,
        "redundant_columns": bias.redundant_columns(data),
    }
    if target and target in data.columns:
        parts["imbalance"] = balance.imbalance_metrics(data, target)
    return as_sections(parts)


def library_report(df: DataFrame, row_id: str, target: Optional[str] = None) -> DataFrame:
    return library_sections(df, row_id, target)


def compare(left: DataFrame, right: DataFrame, left_config: AnalysisConfig, right_config: AnalysisConfig,
            left_id: Optional[str] = None, right_id: Optional[str] = None) -> DataFrame:
    """Scores of two tables side by side."""
    def metrics(df: DataFrame, config: AnalysisConfig, row_id: Optional[str], value: str) -> DataFrame:
        score = quality_score(df, config, row_id)
        return score.unpivot([], [c for c in score.columns if c != "grade"], "metric", value)

    a = metrics(left, left_config, left_id, "left_value")
    b = metrics(right, right_config, right_id, "right_value")
    return a.join(b, "metric", "full").withColumn("difference", F.round(F.col("right_value") - F.col("left_value"), 2))
