"""Scores, issues and composite reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.config import AnalysisConfig
from grainsift.operators import values
from grainsift.operators.ordering import with_position
from grainsift.plans import report, scoring
from grainsift.plans.scoring import Analysis
from grainsift.registry import register
from grainsift.registry.bias import DETAILS_CTE
from grainsift.registry.duplicates import GROUPS_CTE
from grainsift.registry.noise import NOISE_CTE
from grainsift.registry.views import PEOPLE_COLUMNS, PEOPLE_CTE, people, table

_CONFIG = AnalysisConfig(target_column="score")


def _without(cte: str) -> str:
    """The common tables of a clause after the first one (``people``)."""
    return cte[len(PEOPLE_CTE):]


_ALL_CTE = f"{PEOPLE_CTE}{_without(GROUPS_CTE)}{_without(NOISE_CTE)}{_without(DETAILS_CTE)}"
_GRADE = ("CASE WHEN overall >= 90 THEN 'A' WHEN overall >= 80 THEN 'B' WHEN overall >= 70 THEN 'C' "
          "WHEN overall >= 60 THEN 'D' ELSE 'F' END")

_BASIC = f"""{PEOPLE_CTE}{_without(GROUPS_CTE)}, cells AS (SELECT {' + '.join(f'count(*) - count({c})' for c in PEOPLE_COLUMNS)}
AS missing, count(*) * {len(PEOPLE_COLUMNS)} AS cells FROM people),
dims AS (SELECT 100 * (1 - missing / CAST(cells AS DOUBLE)) AS completeness,
(SELECT 100 * (1 - sum(n - 1) / CAST(sum(n) AS DOUBLE)) FROM g) AS uniqueness FROM cells),
basic AS (SELECT *, completeness * 0.3::DOUBLE + uniqueness * 0.2::DOUBLE + 95 * 0.2::DOUBLE + 90 * 0.15::DOUBLE + 85 * 0.15::DOUBLE
AS overall FROM dims)"""


@register("quality_score_basic", f"""
WITH {_BASIC} SELECT round(completeness, 4) AS completeness, round(uniqueness, 4) AS uniqueness, 95.0::DOUBLE AS consistency,
90.0::DOUBLE AS validity, 85.0::DOUBLE AS balance, round(overall, 4) AS overall, {_GRADE} AS grade FROM basic""")
def quality_score_basic(spark, sf):
    return scoring.basic_score(people(spark, sf), "row_id")


_MEASURES = f"""{_ALL_CTE}, measures AS (SELECT
(SELECT round(({' + '.join(f'(count(*) - count({c}))' for c in PEOPLE_COLUMNS)}) / CAST(count(*) * {len(PEOPLE_COLUMNS)} AS DOUBLE), 4)
 FROM people) AS missing_fraction,
(SELECT coalesce(max(value), 0) FROM findings WHERE finding = 'outlier_fraction') AS outlier_fraction,
(SELECT round(sum(n - 1) / CAST(sum(n) AS DOUBLE), 4) FROM g) AS duplicate_fraction,
(SELECT round(avg(bias_score), 2) FROM details) AS bias_score,
(SELECT round(max(n) / CAST(min(n) AS DOUBLE), 2) FROM (SELECT count(*) AS n FROM people GROUP BY score)) AS ratio,
(SELECT count(*) FROM findings WHERE finding = 'formatting_errors') AS format_columns),
lost AS (SELECT least(missing_fraction * 100, 30) AS l_missing, least(outlier_fraction * 100, 20) AS l_outlier,
least(duplicate_fraction * 100, 20) AS l_duplicate, least(bias_score / 5, 20) AS l_bias,
CASE WHEN ratio >= 3 THEN least(ratio, 10) ELSE 0 END AS l_imbalance, format_columns FROM measures),
scored AS (SELECT round(greatest(0, 100 - l_missing - l_outlier - l_duplicate - l_bias - l_imbalance), 2) AS overall,
round(greatest(0, 100 - 3.33::DOUBLE * l_missing), 2) AS completeness, round(greatest(0, 100 - 5 * l_duplicate), 2) AS uniqueness,
round(greatest(0, 100 - 5.0::DOUBLE * format_columns), 2) AS consistency, round(greatest(0, 100 - 5 * l_outlier), 2) AS validity,
round(greatest(0, 100 - 10 * l_imbalance), 2) AS balance FROM lost)"""


@register("quality_score", f"WITH {_MEASURES} SELECT *, {_GRADE} AS grade FROM scored")
def quality_score(spark, sf):
    return scoring.quality_score(people(spark, sf), _CONFIG, "row_id")


@register("quality_grade", f"WITH {_MEASURES} SELECT overall, {_GRADE} AS grade FROM scored")
def quality_grade(spark, sf):
    return scoring.quality_score(people(spark, sf), _CONFIG, "row_id").select("overall", "grade")


@register("score_bands", f"""
WITH {_MEASURES}, d AS (UNPIVOT (SELECT completeness, uniqueness, consistency, validity, balance FROM scored)
ON COLUMNS(*) INTO NAME dimension VALUE score)
SELECT dimension, score, CASE WHEN score >= 80 THEN 'good' WHEN score >= 60 THEN 'fair' ELSE 'poor' END AS band FROM d""")
def score_bands(spark, sf):
    return scoring.score_bands(scoring.quality_score(people(spark, sf), _CONFIG, "row_id"))


_ISSUES = f"""{_MEASURES}, issues AS (
SELECT 'noise' AS category, 'missing_fraction' AS metric, column_name, round(value / (SELECT count(*) FROM people), 4) AS v,
  0.2::DOUBLE AS critical, 0.05::DOUBLE AS warning FROM findings WHERE finding = 'missing_cells'
UNION ALL SELECT 'noise', 'outlier_fraction', f.column_name, f.value, 1e9::DOUBLE, 0.0500000001::DOUBLE FROM findings f
  JOIN findings c ON c.column_name = f.column_name AND c.finding = 'outliers' AND c.value > 0 WHERE f.finding = 'outlier_fraction'
UNION ALL SELECT 'noise', 'formatting_errors', column_name, value, 1e18::DOUBLE, 1e18::DOUBLE FROM findings WHERE finding = 'formatting_errors'
UNION ALL SELECT 'noise', 'constant_column', column_name, 1, 1e9, 1e9 FROM findings WHERE finding = 'constant_column'
UNION ALL SELECT 'noise', 'high_cardinality_column', column_name, 1, 1e9, 1e9 FROM findings WHERE finding = 'high_cardinality_column'
UNION ALL SELECT 'duplicate', 'duplicate_fraction', NULL, duplicate_fraction, 0.1, 1e9 FROM measures WHERE duplicate_fraction > 0
UNION ALL SELECT 'bias', 'bias_score', column_name, bias_score, 60, 30 FROM details WHERE bias_score > 0
UNION ALL SELECT 'imbalance', 'imbalance_ratio', 'score', ratio, 10, 3 FROM measures WHERE ratio >= 3),
graded AS (SELECT concat_ws('-', category, metric, column_name) AS issue_id, category, metric, column_name, v AS metric_value,
CASE WHEN v > critical THEN 'CRITICAL' WHEN v >= warning THEN 'WARNING' ELSE 'INFO' END AS severity FROM issues)"""


def _issues(spark, sf):
    return scoring.classify_issues(Analysis(people(spark, sf), _CONFIG, "row_id"))


@register("classify_issues", f"WITH {_ISSUES} SELECT * FROM graded")
def classify_issues(spark, sf):
    return _issues(spark, sf).select("issue_id", "category", "severity", "column_name", "metric", "metric_value")


@register("issue_counts", f"WITH {_ISSUES} SELECT category, severity, count(*) AS n_issues FROM graded GROUP BY category, severity")
def issue_counts(spark, sf):
    return scoring.issue_counts(_issues(spark, sf))


@register("top_issues", f"""
WITH {_ISSUES} SELECT issue_id, severity, metric_value FROM graded ORDER BY CASE severity WHEN 'CRITICAL' THEN 0
WHEN 'WARNING' THEN 1 ELSE 2 END, metric_value DESC, issue_id LIMIT 5""")
def top_issues(spark, sf):
    return scoring.top_issues(_issues(spark, sf)).select("issue_id", "severity", "metric_value")


@register("statistical_summary")
def statistical_summary(spark, sf):
    return report.statistical_summary(people(spark, sf), _CONFIG, "row_id")


@register("quality_report")
def quality_report(spark, sf):
    return report.quality_sections(people(spark, sf), _CONFIG, "row_id")


@register("library_report")
def library_report(spark, sf):
    return report.library_sections(people(spark, sf), "row_id", "score")


@register("compare_join", f"""
WITH {_MEASURES}, people_side AS (UNPIVOT (SELECT overall, completeness, uniqueness, consistency, validity, balance FROM scored)
ON COLUMNS(*) INTO NAME metric VALUE left_value),
parts AS (SELECT p_size, p_retailprice FROM part),
fence AS (SELECT quantile_cont(p_size, 0.25) AS a1, quantile_cont(p_size, 0.75) AS a3,
  quantile_cont(p_retailprice, 0.25) AS b1, quantile_cont(p_retailprice, 0.75) AS b3, quantile_cont(p_partkey, 0.25) AS c1,
  quantile_cont(p_partkey, 0.75) AS c3 FROM part),
worst AS (SELECT greatest(round(count(*) FILTER (WHERE p_size < a1 - 1.5 * (a3 - a1) OR p_size > a3 + 1.5 * (a3 - a1)) / CAST(count(*) AS DOUBLE), 4),
  round(count(*) FILTER (WHERE p_retailprice < b1 - 1.5 * (b3 - b1) OR p_retailprice > b3 + 1.5 * (b3 - b1)) / CAST(count(*) AS DOUBLE), 4),
  round(count(*) FILTER (WHERE p_partkey < c1 - 1.5 * (c3 - c1) OR p_partkey > c3 + 1.5 * (c3 - c1)) / CAST(count(*) AS DOUBLE), 4)) AS f
  FROM part, fence),
part_score AS (SELECT round(greatest(0, 100 - least(f * 100, 20)), 2) AS overall, 100.0::DOUBLE AS completeness, 100.0::DOUBLE AS uniqueness,
  100.0::DOUBLE AS consistency, round(greatest(0, 100 - 5 * least(f * 100, 20)), 2) AS validity, 100.0::DOUBLE AS balance FROM worst),
part_side AS (UNPIVOT part_score ON COLUMNS(*) INTO NAME metric VALUE right_value)
SELECT metric, left_value, right_value, round(right_value - left_value, 2) AS difference
FROM people_side FULL JOIN part_side USING (metric)""")
def compare_join(spark, sf):
    return report.compare(people(spark, sf), table(spark, sf, "part"), _CONFIG, AnalysisConfig(), "row_id", None)


@register("sample_rows")
def sample_rows(spark, sf):
    # a sampling operator: the first rows in hash order
    return values.sample_rows(table(spark, sf, "orders"), "o_orderkey", 2000)


@register("row_positions", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def row_positions(spark, sf):
    # small buckets, so that the offsets between them are part of the check
    return with_position(table(spark, sf, "orders"), ["o_orderdate", "o_orderkey"], rows_per_bucket=1_000).select(
        "o_orderkey", "position")
