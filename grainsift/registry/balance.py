"""Class balance of the order status and of the quality labels."""

from __future__ import annotations

from grainsift.functions import fixed_values as fixed
from grainsift.operators import balance
from grainsift.registry import register
from grainsift.registry.views import table

_STATS = """counts AS (SELECT CAST(quality AS STRING) AS label, count(*) AS n FROM labels
WHERE quality IS NOT NULL GROUP BY quality),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM counts),
stats AS (SELECT count(*) AS n_classes, CAST(sum(n) AS BIGINT) AS n_rows, max(n) AS majority_count, min(n) AS minority_count,
  max(n) / CAST(min(n) AS DOUBLE) AS ratio, -sum(n / total * log2(n / total)) AS shannon,
  1 - sum((n / total) * (n / total)) AS gini FROM counts, total)"""


def _labels(spark, sf):
    return table(spark, sf, "labels")


@register("class_distribution", """
SELECT o_orderstatus AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS fraction
FROM orders GROUP BY o_orderstatus""")
def class_distribution(spark, sf):
    return balance.class_distribution(table(spark, sf, "orders"), "o_orderstatus")


@register("imbalance_ratio", f"""
WITH {_STATS} SELECT CASE WHEN n_classes < 2 THEN 0.0::DOUBLE ELSE round(ratio, 2) END AS report_ratio,
round(ratio, 6) AS metric_ratio FROM stats""")
def imbalance_ratio(spark, sf):
    return balance.imbalance_ratio(_labels(spark, sf), "quality")


@register("imbalance_report", f"""
WITH {_STATS}, r AS (SELECT CASE WHEN n_classes < 2 THEN 0.0::DOUBLE ELSE round(ratio, 2) END AS ratio FROM stats)
SELECT 'quality' AS target_column, ratio AS imbalance_ratio, ratio >= 3 AS is_imbalanced,
CASE WHEN ratio >= 10 THEN '{fixed.STRATEGY_SEVERE.replace("'", "''")}' WHEN ratio >= 3 THEN '{fixed.STRATEGY_MODERATE}'
ELSE '{fixed.STRATEGY_NONE}' END AS recommended_strategy FROM r""")
def imbalance_report(spark, sf):
    return balance.imbalance_report(_labels(spark, sf), "quality")


@register("imbalance_metrics", f"""
WITH {_STATS} SELECT n_classes, n_rows, majority_count, minority_count, round(ratio, 6) AS imbalance_ratio,
round(shannon, 6) AS shannon_entropy, round(gini, 6) AS gini_impurity FROM stats""")
def imbalance_metrics(spark, sf):
    return balance.imbalance_metrics(_labels(spark, sf), "quality")


@register("class_percentages", """
SELECT CAST(toxic AS STRING) AS label, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 4) AS fraction,
CAST(count(*) AS DOUBLE) AS effective_samples FROM labels GROUP BY toxic""")
def class_percentages(spark, sf):
    return balance.class_percentages(_labels(spark, sf), "toxic")


@register("imbalance_severity", f"""
WITH {_STATS} SELECT 'quality' AS target_column, round(ratio, 6) AS imbalance_ratio, CASE WHEN ratio < 1.5 THEN 'BALANCED'
WHEN ratio < 3 THEN 'MILD' WHEN ratio < 10 THEN 'MODERATE' WHEN ratio < 100 THEN 'SEVERE' ELSE 'EXTREME' END AS severity
FROM stats""")
def imbalance_severity(spark, sf):
    return balance.imbalance_severity(_labels(spark, sf), "quality")


@register("imbalance_severity_ui", f"""
WITH {_STATS} SELECT 'quality' AS target_column, round(ratio, 6) AS imbalance_ratio, CASE WHEN ratio >= 10 THEN 'EXTREME'
WHEN ratio >= 3 THEN 'MODERATE' WHEN ratio >= 1.5 THEN 'MILD' ELSE 'BALANCED' END AS severity FROM stats""")
def imbalance_severity_ui(spark, sf):
    return balance.imbalance_severity(_labels(spark, sf), "quality", display=True)


@register("drift_vulnerability", f"""
WITH {_STATS} SELECT round(least(1.0::DOUBLE, ratio / 10 + (1 - shannon)), 6) AS drift_vulnerability FROM stats""")
def drift_vulnerability(spark, sf):
    return balance.drift_vulnerability(_labels(spark, sf), "quality")


@register("rebalance_plan", f"""
WITH {_STATS}, advice(strategy, made, when_to_use, pros, cons) AS (VALUES
('SMOTE', 1, 'The features are continuous numbers.', 'New rows lie between known ones and repeat none.',
 'It can add noise and suits many categories badly.'),
('Class Weights', 0, 'The learner takes costs per class.', 'The data stay as they are.', 'Only some learners can use it.'))
SELECT strategy, made * (majority_count - minority_count) AS samples_generated, when_to_use, pros, cons FROM stats, advice
WHERE ratio > 1.5""")
def rebalance_plan(spark, sf):
    return balance.rebalance_plan(_labels(spark, sf), "quality")


@register("rebalance_simulate", f"""
WITH {_STATS}, r AS (SELECT majority_count, unnest(range(1, greatest(20, CAST(ceil(ratio) AS BIGINT) + 5) + 1)) AS target_ratio
FROM stats) SELECT target_ratio, greatest(1, CAST(round(majority_count / CAST(target_ratio AS DOUBLE)) AS BIGINT))
AS minority_size FROM r""")
def rebalance_simulate(spark, sf):
    return balance.rebalance_simulate(_labels(spark, sf), "quality")


@register("entropy_pct", f"""
WITH {_STATS} SELECT (SELECT label FROM counts ORDER BY n DESC, label LIMIT 1) AS majority_label,
(SELECT label FROM counts ORDER BY n, label DESC LIMIT 1) AS minority_label,
round(100 * shannon / log2(greatest(n_classes, 2)), 4) AS entropy_pct FROM stats""")
def entropy_pct(spark, sf):
    return balance.entropy_percent(_labels(spark, sf), "quality")


@register("majority_baseline", f"""
WITH {_STATS} SELECT CAST(round(100.0::DOUBLE * majority_count / n_rows) AS BIGINT) AS baseline_accuracy FROM stats""")
def majority_baseline(spark, sf):
    return balance.majority_baseline(_labels(spark, sf), "quality")
