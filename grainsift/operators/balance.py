"""Class balance of a target column."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import band, cell_text
from grainsift.operators.aggkit import tidy_schema_rows


def class_counts(df: DataFrame, target: str) -> DataFrame:
    return (df.select(cell_text(df, target).alias("label")).filter("label IS NOT NULL")
            .groupBy("label").agg(F.count("*").alias("n")))


REBALANCE_ADVICE = {
    "SMOTE": {"when_to_use": "The features are continuous numbers.", "pros": "New rows lie between known ones and repeat none.",
              "cons": "It can add noise and suits many categories badly."},
    "Class Weights": {"when_to_use": "The learner takes costs per class.", "pros": "The data stay as they are.",
                      "cons": "Only some learners can use it."},
}


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Rows and share per class, most frequent first."""
    total = df.agg(F.count(cell_text(df, target))).first()[0]
    return (class_counts(df, target)
            .select("label", "n", F.round(F.col("n") / F.lit(max(total, 1)), 4).alias("fraction"))
            .orderBy(F.desc("n"), "label"))


def class_stats(df: DataFrame, target: str) -> DataFrame:
    """One row of figures over the class counts, without the shares as an extra step.

    With N rows the entropy is log2 N - sum(n log2 n) / N and the impurity 1 - sum(n^2) / N^2.
    """
    counts = class_counts(df, target)
    n = F.col("n").cast("double")
    total = F.sum(n)
    return counts.agg(
        F.count("*").alias("n_classes"), F.sum("n").alias("n_rows"),
        F.max("n").alias("majority_count"), F.min("n").alias("minority_count"),
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("majority_label"),
        F.max_by("label", F.struct(-F.col("n"), F.col("label"))).alias("minority_label"),
        (F.max(n) / F.min(n)).alias("raw_ratio"),
        F.greatest(F.lit(0.0), F.log2(total) - F.sum(n * F.log2(n)) / total).alias("shannon_entropy"),
        (1.0 - F.sum(n * n) / (total * total)).alias("gini_impurity"))


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    """Majority over minority: the report form is 0 for a single class, the metric form 1."""
    return class_stats(df, target).select(
        F.when(F.col("n_classes") < 2, F.lit(0.0)).otherwise(F.round("raw_ratio", 2)).alias("report_ratio"),
        F.round("raw_ratio", 6).alias("metric_ratio"))


def imbalance_report(df: DataFrame, target: str | None) -> DataFrame:
    """Ratio, verdict and advice for the target."""
    if not target or target not in df.columns:
        return tidy_schema_rows(df, [(None, 0.0, False, fixed.STRATEGY_NO_TARGET)],
                                "target_column string, imbalance_ratio double, is_imbalanced boolean, "
                                "recommended_strategy string")
    ratio = F.col("report_ratio")
    return imbalance_ratio(df, target).select(
        F.lit(target).alias("target_column"), F.coalesce(ratio, F.lit(0.0)).alias("imbalance_ratio"),
        F.coalesce(ratio >= 3, F.lit(False)).alias("is_imbalanced"),
        F.when(ratio >= 10, F.lit(fixed.STRATEGY_SEVERE)).when(ratio >= 3, F.lit(fixed.STRATEGY_MODERATE))
        .otherwise(F.lit(fixed.STRATEGY_NONE)).alias("recommended_strategy"))


def imbalance_metrics(df: DataFrame, target: str) -> DataFrame:
    return class_stats(df, target).select(
        "n_classes", "n_rows", "majority_count", "minority_count",
        F.round("raw_ratio", 6).alias("imbalance_ratio"),
        F.round("shannon_entropy", 6).alias("shannon_entropy"),
        F.round("gini_impurity", 6).alias("gini_impurity"))


def class_percentages(df: DataFrame, target: str) -> DataFrame:
    """Count, share and effective samples per class."""
    return class_distribution(df, target).select(
        "label", "n", "fraction", F.col("n").cast("double").alias("effective_samples"))


def imbalance_severity(df: DataFrame, target: str, display: bool = False) -> DataFrame:
    bands = fixed.IMBALANCE_BANDS_DISPLAY if display else fixed.IMBALANCE_BANDS
    return class_stats(df, target).select(
        F.lit(target).alias("target_column"), F.round("raw_ratio", 6).alias("imbalance_ratio"),
        band(F.col("raw_ratio"), bands).alias("severity"))


def drift_vulnerability(df: DataFrame, target: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("raw_ratio") / 10.0 + (1.0 - F.col("shannon_entropy")))
    return class_stats(df, target).filter("n_classes > 0").select(F.round(score, 6).alias("drift_vulnerability"))


def rebalance_plan(df: DataFrame, target: str) -> DataFrame:
    """Advice rows for a target that is out of balance: what to do, how many rows it makes, when it fits, for and against."""
    made = {"SMOTE": F.col("majority_count") - F.col("minority_count"), "Class Weights": F.lit(0).cast("long")}
    options = F.array(*[F.struct(F.lit(name).alias("strategy"), made[name].alias("samples_generated"),
                                 *[F.lit(text).alias(field) for field, text in advice.items()])
                        for name, advice in REBALANCE_ADVICE.items()])
    return class_stats(df, target).filter("raw_ratio > 1.5").select(F.inline(options))


def rebalance_simulate(df: DataFrame, target: str) -> DataFrame:
    """Size of the minority class for every whole target ratio."""
    highest = F.greatest(F.lit(20), (F.ceil("raw_ratio") + 5).cast("int"))
    return (class_stats(df, target)
            .select("majority_count", F.explode(F.sequence(F.lit(1), highest)).alias("ratio"))
            .select(F.col("ratio").cast("long").alias("target_ratio"),
                    F.greatest(F.lit(1).cast("long"), F.round(F.col("majority_count") / F.col("ratio")).cast("long"))
                    .alias("minority_size")))


def entropy_percent(df: DataFrame, target: str) -> DataFrame:
    most = F.log2(F.greatest(F.col("n_classes"), F.lit(2)).cast("double"))
    return class_stats(df, target).select(
        "majority_label", "minority_label",
        F.round(100.0 * F.col("shannon_entropy") / most, 4).alias("entropy_pct"))


def majority_baseline(df: DataFrame, target: str) -> DataFrame:
    """Accuracy in percent of always naming the most frequent class."""
    return class_stats(df, target).select(
        F.round(100.0 * F.col("majority_count") / F.col("n_rows")).cast("long").alias("baseline_accuracy"))
