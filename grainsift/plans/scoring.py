"""Quality scores, grades and issues."""

from __future__ import annotations

from functools import reduce
from typing import Callable, Optional

from pyspark.sql import Column, DataFrame, Row, functions as F, types as T

from grainsift.config import AnalysisConfig
from grainsift.functions import fixed_values as fixed
from grainsift.operators import balance, bias, duplicates, noise, outliers, profile
from grainsift.operators.aggkit import tidy_schema_rows

DIMENSIONS = ("completeness", "uniqueness", "consistency", "validity", "balance")

MEASURE_SCHEMA = ("missing_fraction double, max_outlier_fraction double, duplicate_fraction double, "
                  "bias_score double, imbalance_ratio double, is_imbalanced boolean, format_error_columns long")


def grade(score: Column) -> Column:
    label = F.lit(fixed.LOWEST_GRADE)
    for name, low in reversed(fixed.GRADES):
        label = F.when(score >= low, F.lit(name)).otherwise(label)
    return label


def basic_score(df: DataFrame, row_id: Optional[str] = None) -> DataFrame:
    """Completeness and uniqueness measured, the other dimensions constant."""
    data = df.drop(row_id) if row_id else df
    missing = profile.missing_by_column(data).agg(
        F.sum("missing_count").cast("double").alias("missing"), F.sum("n_rows").cast("double").alias("cells")).first()
    dupes = duplicates.exact_duplicates(data).first()
    schema = "completeness double, uniqueness double, consistency double, validity double, balance double"
    if not dupes["n_rows"]:
        return tidy_schema_rows(df, [(0.0,) * 5], schema).select(
            "*", F.lit(0.0).alias("overall"), F.lit(fixed.LOWEST_GRADE).alias("grade"))
    row = (max(0.0, 100.0 * (1.0 - missing["missing"] / missing["cells"])),
           max(0.0, 100.0 * (1.0 - dupes["duplicate_rows"] / dupes["n_rows"])),
           fixed.BASIC_CONSISTENCY, fixed.BASIC_VALIDITY, fixed.BASIC_BALANCE)
    overall = sum((F.lit(w) * F.col(d) for d, w in fixed.BASIC_WEIGHTS.items()), F.lit(0.0))
    return tidy_schema_rows(df, [row], schema).select(
        *[F.round(d, 4).alias(d) for d in DIMENSIONS], F.round(overall, 4).alias("overall"),
        grade(overall).alias("grade"))


class Analysis:
    """Sub-reports of one table, each computed once on first use.

    A report has one row per column, class or metric; its rows are kept by the driver so that the
    composite reports do not read the table again.
    """

    def __init__(self, df: DataFrame, config: AnalysisConfig, row_id: Optional[str] = None):
        self.df, self.config, self.row_id = df, config, row_id
        self.data = df.drop(row_id) if row_id else df
        self._done: dict[str, tuple[list[Row], T.StructType]] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        self._rows(name, make)
        rows, schema = self._done[name]
        return self.df.sparkSession.createDataFrame(rows, schema)

    def _rows(self, name: str, make: Callable[[], DataFrame]) -> list[Row]:
        if name not in self._done:
            report = make()
            self._done[name] = (report.collect(), report.schema)
        return self._done[name][0]

    def _facts(self) -> list[Row]:
        return self._rows("facts", lambda: noise.column_facts(self.data))

    def _details(self) -> list[Row]:
        return self._rows("outliers", lambda: outliers.outlier_details(
            self.data, self.config.outlier_method, sizes={r["column_name"]: r["present_count"] for r in self._facts()}))

    def _findings(self) -> list[Row]:
        return self._rows("findings", lambda: tidy_schema_rows(
            self.df, noise.noise_findings(self.data, self._facts(), self._details()), noise.FINDING_SCHEMA))

    def _found(self, finding: str, column: str) -> DataFrame:
        rows = [(r["column_name"], r["value"]) for r in self._findings() if r["finding"] == finding]
        return tidy_schema_rows(self.df, rows, f"column_name string, {column} double")

    @property
    def info(self) -> DataFrame:
        """Type, rows and missing share of every column."""
        rows = [(f["column_name"], self.data.schema[f["column_name"]].dataType.simpleString(), f["n_rows"],
                 len(self.data.columns), f["n_rows"] - f["present_count"],
                 (f["n_rows"] - f["present_count"]) / max(f["n_rows"], 1)) for f in self._facts()]
        return tidy_schema_rows(
            self.df, rows, "column_name string, dtype string, n_rows long, n_columns int, missing_count long, "
                           "missing_fraction double").withColumn("missing_fraction", F.round("missing_fraction", 4))

    @property
    def describe(self) -> DataFrame:
        return self._once("describe", lambda: profile.describe_numeric(self.data))

    @property
    def outliers(self) -> DataFrame:
        self._details()
        return self._once("outliers", lambda: self.data)

    @property
    def formatting(self) -> DataFrame:
        return self._found("formatting_errors", "error_count")

    @property
    def constant(self) -> DataFrame:
        return self._found("constant_column", "value")

    @property
    def high_cardinality(self) -> DataFrame:
        return self._found("high_cardinality_column", "value")

    def _exact(self) -> list[Row]:
        return self._rows("exact", lambda: duplicates.exact_duplicates(self.data))

    @property
    def exact_duplicates(self) -> DataFrame:
        return self._once("exact", lambda: duplicates.exact_duplicates(self.data))

    @property
    def duplicates(self) -> DataFrame:
        if self.row_id is None:
            raise ValueError("the duplicate report needs a row_id column")
        return self._once("duplicates", lambda: duplicates.duplicate_report(
            self.df, self.row_id, self.config.fuzzy_duplicate_threshold, exact=self._exact()[0]))

    def _bias(self) -> DataFrame:
        c = self.config
        return bias.bias_details(self.data, c.sensitive_columns, c.target_column, c.bias_threshold)

    @property
    def bias(self) -> DataFrame:
        return self._once("bias", self._bias)

    @property
    def bias_summary(self) -> DataFrame:
        return self._once("bias_summary", lambda: bias.bias_report(self.bias))

    @property
    def imbalance(self) -> DataFrame:
        return self._once("imbalance", lambda: balance.imbalance_report(self.data, self.config.target_column))

    @property
    def classes(self) -> Optional[DataFrame]:
        target = self.config.target_column
        if not target or target not in self.data.columns:
            return None
        # a target may have many classes, so they stay with the executors
        return balance.class_distribution(self.data, target)

    @property
    def measures(self) -> DataFrame:
        """The figures the score is made of, in one row."""
        facts, details = self._facts(), self._details()
        cells = sum(f["n_rows"] for f in facts)
        missing = sum(f["n_rows"] - f["present_count"] for f in facts)
        scores = [r["bias_score"] for r in self._rows("bias", self._bias)]
        classes = self._rows("imbalance", lambda: balance.imbalance_report(self.data, self.config.target_column))[0]
        row = (missing / max(cells, 1), max((r["outlier_fraction"] for r in details), default=0.0),
               self._exact()[0]["duplicate_fraction"], sum(scores) / len(scores) if scores else 0.0,
               classes["imbalance_ratio"], classes["is_imbalanced"],
               sum(r["finding"] == "formatting_errors" for r in self._findings()))
        return (tidy_schema_rows(self.df, [row], MEASURE_SCHEMA)
                .withColumn("missing_fraction", F.round("missing_fraction", 4))
                .withColumn("bias_score", F.round("bias_score", 2)))

    @property
    def score(self) -> DataFrame:
        return score_measures(self.measures)


def score_measures(measures: DataFrame) -> DataFrame:
    """Dimension scores, overall score and grade from the measured figures."""
    def capped(value: Column, most: float) -> Column:
        return F.least(value, F.lit(most))

    def score(value: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), value), 2)

    lost = {
        "missing": capped(F.col("missing_fraction") * 100.0, 30.0),
        "outlier": capped(F.col("max_outlier_fraction") * 100.0, 20.0),
        "duplicate": capped(F.col("duplicate_fraction") * 100.0, 20.0),
        "bias": capped(F.col("bias_score") / 5.0, 20.0),
        "imbalance": F.when(F.col("is_imbalanced"), capped(F.col("imbalance_ratio"), 10.0)).otherwise(F.lit(0.0)),
    }
    overall = score(100.0 - sum(lost.values(), F.lit(0.0)))
    return measures.select(
        overall.alias("overall"), grade(overall).alias("grade"),
        score(100.0 - 3.33 * lost["missing"]).alias("completeness"),
        score(100.0 - 5.0 * lost["duplicate"]).alias("uniqueness"),
        score(100.0 - 5.0 * F.col("format_error_columns")).alias("consistency"),
        score(100.0 - 5.0 * lost["outlier"]).alias("validity"),
        score(100.0 - 10.0 * lost["imbalance"]).alias("balance"))


def quality_score(df: DataFrame, config: AnalysisConfig, row_id: Optional[str] = None) -> DataFrame:
    return Analysis(df, config, row_id).score


def score_bands(score: DataFrame) -> DataFrame:
    """Display band of each dimension."""
    value = F.col("score")
    label = F.when(value >= 80, F.lit("good")).when(value >= 60, F.lit("fair")).otherwise(F.lit("poor"))
    return score.unpivot([], list(DIMENSIONS), "dimension", "score").withColumn("band", label)


# --- issues ---------------------------------------------------------------------------

def _rule(value: Column, critical: Optional[float], warning: Optional[float],
          warning_inclusive: bool = True) -> tuple[Column, Column]:
    """Severity and the bound that decided it."""
    severity, bound = F.lit("INFO"), F.lit(0.0)
    if warning is not None:
        hit = value >= warning if warning_inclusive else value > warning
        severity = F.when(hit, F.lit("WARNING")).otherwise(severity)
        bound = F.when(hit, F.lit(warning)).otherwise(bound)
    if critical is not None:
        severity = F.when(value > critical, F.lit("CRITICAL")).otherwise(severity)
        bound = F.when(value > critical, F.lit(critical)).otherwise(bound)
    return severity, bound


def _issues(frame: DataFrame, category: str, metric: str, column: Column, value: Column,
            rule: tuple[Column, Column], advice: str) -> DataFrame:
    severity, bound = rule
    return frame.select(
        F.concat_ws("-", F.lit(category), F.lit(metric), column).alias("issue_id"),
        F.lit(category).alias("category"), severity.alias("severity"), column.alias("column_name"),
        F.lit(metric).alias("metric"), value.cast("double").alias("metric_value"),
        bound.cast("double").alias("threshold"), F.lit(advice).alias("recommendation"))


def classify_issues(analysis: Analysis) -> DataFrame:
    """Issues of a table with severity by fixed rules."""
    name, none = F.col("column_name"), F.lit(None).cast("string")
    missing, fraction = F.col("missing_fraction"), F.col("outlier_fraction")
    same, score, ratio = F.col("duplicate_fraction"), F.col("bias_score"), F.col("imbalance_ratio")
    parts = [
        _issues(analysis.info.filter(missing > 0), "noise", "missing_fraction", name, missing,
                _rule(missing, 0.20, 0.05), "Fill the missing values or drop the column."),
        _issues(analysis.outliers.filter("outlier_count > 0"), "noise", "outlier_fraction", name, fraction,
                _rule(fraction, None, 0.05, warning_inclusive=False), "Check the extreme values and cap them at the fences."),
        _issues(analysis.formatting, "noise", "formatting_errors", name, F.col("error_count"),
                _rule(F.col("error_count"), None, None), "Bring the values to one number format."),
        _issues(analysis.constant, "noise", "constant_column", name, F.lit(1.0),
                _rule(F.lit(1.0), None, None), "Drop the column: it carries no information."),
        _issues(analysis.high_cardinality, "noise", "high_cardinality_column", name, F.lit(1.0),
                _rule(F.lit(1.0), None, None), "Drop the column or group its values before it is encoded."),
        _issues(analysis.exact_duplicates.filter(same > 0), "duplicate", "duplicate_fraction", none, same,
                _rule(same, 0.10, None), "Remove the repeated rows."),
        _issues(analysis.bias.filter(score > 0), "bias", "bias_score", name, score,
                _rule(score, 60.0, 30.0), "Reweight or resample the groups of this column."),
        _issues(analysis.imbalance.filter("is_imbalanced"), "imbalance", "imbalance_ratio", F.col("target_column"), ratio,
                _rule(ratio, 10.0, 3.0), "Resample the classes or use class weights."),
    ]
    return reduce(DataFrame.unionByName, parts)


def issue_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("category", "severity").agg(F.count("*").alias("n_issues"))


def top_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """The most severe issues, a top-k report."""
    rank = F.when(F.col("severity") == "CRITICAL", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    return issues.orderBy(rank, F.desc("metric_value"), "issue_id").limit(k)
