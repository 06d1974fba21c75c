"""Outlier reports and capping."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.operators import outliers
from grainsift.operators.forest import outliers_isolation_forest
from grainsift.registry import register
from grainsift.registry.views import LINEITEM_NUMBERS, PEOPLE_CTE, PEOPLE_NUMBERS, each, people, table

_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_FENCE = "(SELECT quantile_cont(@, 0.25) AS q1, quantile_cont(@, 0.75) AS q3, quantile_cont(@, 0.99) AS p99 FROM %s)"
_OUT = "@ < q1 - 1.5 * (q3 - q1) OR @ > q3 + 1.5 * (q3 - q1)"
_BOUNDS = ("round(CAST(any_value(q1 - 1.5 * (q3 - q1)) AS DOUBLE), 4) AS lower_bound, "
           "round(CAST(any_value(q3 + 1.5 * (q3 - q1)) AS DOUBLE), 4) AS upper_bound")


def _people(spark, sf):
    return people(spark, sf).drop("row_id")


def _lines(spark, sf):
    return table(spark, sf, "lineitem")


@register("outliers_iqr", f"WITH {PEOPLE_CTE} " + each(
    f"SELECT '@' AS column_name, 'iqr' AS method, count(*) FILTER (WHERE {_OUT}) AS outlier_count, "
    f"round(count(*) FILTER (WHERE {_OUT}) / CAST(count(*) AS DOUBLE), 4) AS outlier_fraction, {_BOUNDS} "
    f"FROM people, {_FENCE % 'people'}", PEOPLE_NUMBERS))
def outliers_iqr(spark, sf):
    return outliers.outliers_iqr(_people(spark, sf))


_DETAILS = (f"SELECT '@' AS column_name, 'iqr' AS method, count(*) FILTER (WHERE {_OUT}) AS outlier_count, "
            f"round(count(*) FILTER (WHERE {_OUT}) / CAST(count(@) AS DOUBLE), 4) AS outlier_fraction, {_BOUNDS}, "
            f"CASE WHEN count(*) FILTER (WHERE {_OUT}) > 0 THEN round(CAST(any_value(p99) AS DOUBLE), 4) END "
            f"AS suggested_cap FROM %s, {_FENCE}")


@register("outlier_report_all", each(_DETAILS % ("lineitem", "lineitem"), LINEITEM_NUMBERS))
def outlier_report_all(spark, sf):
    return outliers.outlier_details(_lines(spark, sf))


@register("suggest_cap", f"WITH {PEOPLE_CTE}, d AS (" + each(_DETAILS % ("people", "people"), PEOPLE_NUMBERS)
          + ") SELECT column_name, suggested_cap FROM d WHERE outlier_count > 0")
def suggest_cap(spark, sf):
    return outliers.suggest_cap(_people(spark, sf))


def _z(table_name: str, spread: str, whole: str) -> str:
    return (f"SELECT '@' AS column_name, 'zscore' AS method, count(*) FILTER (WHERE abs((@ - m) / s) > 3) AS outlier_count, "
            f"round(count(*) FILTER (WHERE abs((@ - m) / s) > 3) / CAST(count({whole}) AS DOUBLE), 4) AS outlier_fraction, "
            f"round(any_value(m), 4) AS mean, round(any_value(s), 4) AS std "
            f"FROM {table_name}, (SELECT avg(@) AS m, {spread}(@) AS s FROM {table_name})")


@register("outliers_zscore_sample", f"WITH {PEOPLE_CTE} " + each(_z("people", "stddev_samp", "*"), PEOPLE_NUMBERS))
def outliers_zscore_sample(spark, sf):
    return outliers.outliers_zscore(_people(spark, sf))


@register("outliers_zscore_pop", f"WITH {PEOPLE_CTE} " + each(_z("people", "stddev_pop", "@"), PEOPLE_NUMBERS))
def outliers_zscore_pop(spark, sf):
    return outliers.outliers_zscore(_people(spark, sf), population=True)


_MAD = ("SELECT '@' AS column_name, 'modified_zscore' AS method, "
        "count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * (@ - med) / mad) > 3) AS outlier_count, "
        "round(count(*) FILTER (WHERE mad > 0 AND abs(0.6745 * (@ - med) / mad) > 3) / CAST(count(*) AS DOUBLE), 4) "
        "AS outlier_fraction, round(any_value(med), 4) AS median, round(any_value(mad), 4) AS mad FROM %(t)s, "
        "(SELECT any_value(med) AS med, CAST(quantile_cont(abs(@ - med), 0.5) AS DOUBLE) AS mad FROM %(t)s, "
        "(SELECT CAST(quantile_cont(@, 0.5) AS DOUBLE) AS med FROM %(t)s))")


@register("outliers_modified_zscore", f"WITH {PEOPLE_CTE} " + each(_MAD % {"t": "people"}, PEOPLE_NUMBERS))
def outliers_modified_zscore(spark, sf):
    return outliers.outliers_modified_zscore(_people(spark, sf))


@register("outliers_isolation_forest")
def q_outliers_isolation_forest(spark, sf):
    return outliers_isolation_forest(table(spark, sf, "orders"), "o_totalprice", "o_orderkey")


_CAP = """SELECT row_id, CASE WHEN age IS NULL THEN NULL ELSE round(greatest(lo, least(hi, age)), 4) END AS age,
CAST(id AS BIGINT) AS id FROM people, (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM
(SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM people))"""


@register("cap_outliers", f"WITH {PEOPLE_CTE} {_CAP}")
def cap_outliers(spark, sf):
    capped, _ = outliers.cap_outliers(people(spark, sf), columns=PEOPLE_NUMBERS)
    return capped.select("row_id", F.round("age", 4).alias("age"), "id")


@register("cap_outliers_report", each(
    "SELECT '@' AS column_name, 'zscore' AS method, round(any_value(m - 2.0 * s), 4) AS lower_bound, "
    "round(any_value(m + 2.0 * s), 4) AS upper_bound, "
    "count(*) FILTER (WHERE @ < m - 2.0 * s OR @ > m + 2.0 * s) AS outliers_detected, "
    "count(*) FILTER (WHERE @ < m - 2.0 * s OR @ > m + 2.0 * s) AS outliers_capped "
    "FROM lineitem, (SELECT avg(@) AS m, stddev_samp(@) AS s FROM lineitem)", _MEASURES))
def cap_outliers_report(spark, sf):
    _, report = outliers.cap_outliers(_lines(spark, sf).select(*_MEASURES), "zscore", zscore_threshold=2.0)
    return report


@register("boxplot_stats", each(
    f"SELECT '@' AS column_name, CAST(min(@) AS DOUBLE) AS min, round(CAST(any_value(q1) AS DOUBLE), 4) AS q1, "
    f"round(CAST(any_value(q2) AS DOUBLE), 4) AS median, round(CAST(any_value(q3) AS DOUBLE), 4) AS q3, "
    f"CAST(max(@) AS DOUBLE) AS max, CAST(min(@) FILTER (WHERE NOT ({_OUT})) AS DOUBLE) AS whisker_low, "
    f"CAST(max(@) FILTER (WHERE NOT ({_OUT})) AS DOUBLE) AS whisker_high, count(*) FILTER (WHERE {_OUT}) AS outlier_count "
    f"FROM lineitem, (SELECT quantile_cont(@, 0.25) AS q1, quantile_cont(@, 0.5) AS q2, quantile_cont(@, 0.75) AS q3 "
    f"FROM lineitem)", LINEITEM_NUMBERS))
def boxplot_stats(spark, sf):
    return outliers.boxplot_stats(_lines(spark, sf))


@register("outliers_ranked", f"WITH {PEOPLE_CTE}, d AS (" + each(_DETAILS % ("people", "people"), PEOPLE_NUMBERS)
          + ") SELECT column_name, outlier_count, round(outlier_count / CAST(max(outlier_count) OVER () AS DOUBLE), 4) "
            "AS bar FROM d WHERE outlier_count > 0 ORDER BY outlier_count DESC, column_name")
def outliers_ranked(spark, sf):
    return outliers.outliers_ranked(_people(spark, sf))
