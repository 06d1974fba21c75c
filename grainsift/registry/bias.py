"""Bias, fairness and association on the faulty customer table."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.operators import bias
from grainsift.registry import register
from grainsift.registry.views import (
    LINEITEM_NUMBERS, PEOPLE_COLUMNS, PEOPLE_CTE, PEOPLE_NUMBERS, PEOPLE_TEXTS, each, people, table)

SENSITIVE = ["age", "gender", "income"]


def _data(spark, sf):
    return people(spark, sf).drop("row_id")


@register("sensitive_columns", "SELECT * FROM (VALUES ('age'), ('gender'), ('income')) t(column_name)")
def sensitive_columns(spark, sf):
    return bias.sensitive_columns(_data(spark, sf))


@register("class_membership", f"""
WITH {PEOPLE_CTE} SELECT coalesce(CAST(age AS STRING) IN ('20.0', '33.0', '46.0'), FALSE) AS member,
count(*) AS n FROM people GROUP BY 1""")
def class_membership(spark, sf):
    df = _data(spark, sf)
    return df.groupBy(bias.is_member(df, "age", ["20.0", "33.0", "46.0"]).alias("member")).agg(F.count("*").alias("n"))


_DOMINANT = """SELECT '@' AS column_name,
(SELECT CAST(@ AS STRING) FROM people WHERE @ IS NOT NULL GROUP BY @ ORDER BY count(*) DESC, CAST(@ AS STRING) LIMIT 1) AS dominant_value,
(SELECT max(n) / CAST(sum(n) AS DOUBLE) FROM (SELECT count(*) AS n FROM people WHERE @ IS NOT NULL GROUP BY @)) AS fraction"""
_ALL_DOMINANT = "dominant AS (" + each(_DOMINANT, PEOPLE_COLUMNS) + ")"


@register("dominant_value", f"""
WITH {PEOPLE_CTE}, {_ALL_DOMINANT} SELECT column_name, dominant_value, round(fraction, 4) AS dominant_fraction FROM dominant""")
def dominant_value(spark, sf):
    return bias.dominant_values(_data(spark, sf), PEOPLE_COLUMNS).select(
        "column_name", "dominant_value", F.round("dominant_fraction", 4).alias("dominant_fraction"))


@register("positive_label", f"""
WITH {PEOPLE_CTE} SELECT CAST(score AS STRING) AS positive_label FROM people GROUP BY score
ORDER BY count(*) DESC, CAST(score AS STRING) LIMIT 1""")
def positive_label(spark, sf):
    return bias.positive_label(_data(spark, sf), "score")


def _member(c: str) -> str:
    if c == "gender":
        return "gender IN ('male', 'm', 'man')"
    return f"coalesce(CAST({c} AS STRING) = (SELECT dominant_value FROM dominant WHERE column_name = '{c}'), FALSE)"


_RATES = "rates AS (" + " UNION ALL ".join(f"""SELECT '{c}' AS column_name,
avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE p) AS p_privileged,
avg(CASE WHEN y THEN 1.0::DOUBLE ELSE 0 END) FILTER (WHERE NOT p) AS p_other
FROM (SELECT {_member(c)} AS p, coalesce(CAST(score AS STRING) = (SELECT dominant_value FROM dominant
WHERE column_name = 'score'), FALSE) AS y FROM people)""" for c in SENSITIVE) + ")"
_FAIR = f"{PEOPLE_CTE}, {_ALL_DOMINANT}, {_RATES}"


@register("disparate_impact", f"""
WITH {_FAIR} SELECT column_name, round(p_other / nullif(p_privileged, 0), 4) AS disparate_impact FROM rates""")
def disparate_impact(spark, sf):
    return bias.fairness_rates(_data(spark, sf), SENSITIVE, "score").select("column_name", "disparate_impact")


@register("statistical_parity", f"""
WITH {_FAIR} SELECT column_name, round(p_privileged, 6) AS p_privileged, round(p_other, 6) AS p_other,
round(p_other - p_privileged, 4) AS parity_difference FROM rates""")
def statistical_parity(spark, sf):
    return bias.fairness_rates(_data(spark, sf), SENSITIVE, "score").select(
        "column_name", "p_privileged", "p_other", "parity_difference")


@register("privileged_values", f"""
WITH {PEOPLE_CTE}, {_ALL_DOMINANT} SELECT column_name, CASE column_name WHEN 'gender' THEN 'male,m,man'
ELSE dominant_value END AS privileged FROM dominant WHERE column_name IN ('age', 'gender', 'income')""")
def privileged_values(spark, sf):
    groups = bias.privileged_values(_data(spark, sf), SENSITIVE)
    return spark.createDataFrame([(c, ",".join(v)) for c, v in groups.items()], "column_name string, privileged string")


_SCORE = ("CASE WHEN fraction <= 0.7 THEN 0.0::DOUBLE ELSE "
          "round(least(100.0::DOUBLE, 100.0::DOUBLE * (fraction - 0.7::DOUBLE) / (1.0::DOUBLE - 0.7::DOUBLE)), 2) END")


@register("bias_score", f"""
WITH {PEOPLE_CTE}, {_ALL_DOMINANT} SELECT column_name, dominant_value, round(fraction, 4) AS dominant_fraction,
{_SCORE} AS bias_score FROM dominant""")
def bias_score(spark, sf):
    return bias.bias_scores(_data(spark, sf), PEOPLE_COLUMNS, 0.70)


# --- proxies ------------------------------------------------------------------------------

def _numeric_sql(s: str, x: str) -> str:
    return (f"SELECT '{s}' AS sensitive, '{x}' AS column_name, coalesce(abs(corr({x}, code)), 0) AS correlation FROM "
            f"(SELECT CAST({x} AS DOUBLE) AS {x}, CAST(CASE WHEN {s} IS NULL THEN -1 ELSE dense_rank() OVER "
            f"(ORDER BY {s} NULLS LAST) - 1 END AS DOUBLE) AS code FROM (SELECT {', '.join(sorted({s, x}))} FROM people)) "
            f"WHERE {x} IS NOT NULL")


def _cramer_sql(s: str, y: str) -> str:
    return f"""SELECT '{s}' AS sensitive, '{y}' AS column_name,
coalesce(sqrt(greatest(0, sum(o * o / (r * c)) - 1) / nullif(least(any_value(nr), any_value(nc)) - 1, 0)), 0) AS correlation
FROM (SELECT CAST(o AS DOUBLE) AS o, CAST(sum(o) OVER (PARTITION BY a) AS DOUBLE) AS r,
CAST(sum(o) OVER (PARTITION BY b) AS DOUBLE) AS c FROM
(SELECT coalesce(CAST({s} AS STRING), 'nan') AS a, coalesce({y}, 'nan') AS b, count(*) AS o FROM people GROUP BY 1, 2)),
(SELECT count(DISTINCT coalesce(CAST({s} AS STRING), 'nan')) AS nr, count(DISTINCT coalesce({y}, 'nan')) AS nc FROM people)"""


_PAIRS = [(s, o) for s in SENSITIVE for o in PEOPLE_NUMBERS + PEOPLE_TEXTS if s != o]
_NUMERIC = " UNION ALL ".join(_numeric_sql(s, o) for s, o in _PAIRS if o in PEOPLE_NUMBERS)
_CRAMER = " UNION ALL ".join(_cramer_sql(s, o) for s, o in _PAIRS if o in PEOPLE_TEXTS)
_MATRIX = f"matrix AS ({_NUMERIC} UNION ALL {_CRAMER})"


@register("proxy_numeric", f"""
WITH {PEOPLE_CTE}, m AS ({_NUMERIC}) SELECT sensitive, column_name, round(correlation, 6) AS correlation FROM m
WHERE sensitive = 'income'""")
def proxy_numeric(spark, sf):
    return bias.numeric_proxies(_data(spark, sf), ["income"], PEOPLE_NUMBERS).withColumn(
        "correlation", F.round("correlation", 6))


@register("proxy_categorical", f"""
WITH {PEOPLE_CTE}, m AS ({_CRAMER}) SELECT sensitive, column_name, round(correlation, 6) AS correlation FROM m
WHERE sensitive = 'gender'""")
def proxy_categorical(spark, sf):
    others = [c for c in PEOPLE_TEXTS if c != "gender"]
    return bias.categorical_proxies(_data(spark, sf), ["gender"], others).withColumn(
        "correlation", F.round("correlation", 6))


@register("proxy_matrix", f"""
WITH {PEOPLE_CTE}, {_MATRIX} SELECT sensitive, column_name, round(correlation, 6) AS correlation FROM matrix""")
def proxy_matrix(spark, sf):
    return bias.proxy_matrix(_data(spark, sf), SENSITIVE).withColumn("correlation", F.round("correlation", 6))


_ORDER = ", ".join(f"('{s}', '{o}', {i})" for i, (s, o) in enumerate(_PAIRS))
DETAILS_CTE = f"""{_FAIR}, {_MATRIX},
hits AS (SELECT m.column_name, arg_min(m.correlation, p.pos) AS hit FROM matrix m
  JOIN (VALUES {_ORDER}) p(sensitive, column_name, pos) USING (sensitive, column_name)
  WHERE m.correlation >= 0.65 GROUP BY m.column_name),
details AS (SELECT d.column_name, CASE WHEN d.column_name IN ('age', 'gender', 'income') THEN 'demographic' ELSE 'proxy' END
  AS bias_type, dominant_value, round(fraction, 4) AS dominant_fraction,
  round(p_other / nullif(p_privileged, 0), 4) AS disparate_impact, round(p_other - p_privileged, 4) AS parity_difference,
  round(hit, 4) AS proxy_correlation, hit IS NOT NULL AS is_proxy,
  CASE WHEN d.column_name IN ('age', 'gender', 'income') THEN {_SCORE}
       ELSE round(least(100.0::DOUBLE, 100.0::DOUBLE * hit), 2) END AS bias_score
  FROM dominant d LEFT JOIN rates USING (column_name) LEFT JOIN hits USING (column_name)
  WHERE d.column_name IN ('age', 'gender', 'income') OR hit IS NOT NULL)"""


def details(spark, sf):
    return bias.bias_details(_data(spark, sf), target="score")


@register("bias_details", f"WITH {DETAILS_CTE} SELECT * FROM details")
def bias_details(spark, sf):
    return details(spark, sf)


@register("bias_report", f"""
WITH {DETAILS_CTE} SELECT round(avg(bias_score), 2) AS overall_bias_score,
string_agg(column_name, ',' ORDER BY column_name) FILTER (WHERE bias_type = 'proxy' OR bias_score > 0) AS affected_columns,
string_agg(concat(column_name, ':', coalesce(CAST(disparate_impact AS STRING), '-'), ':',
  coalesce(CAST(parity_difference AS STRING), '-')), ',' ORDER BY column_name)
  FILTER (WHERE disparate_impact IS NOT NULL OR parity_difference IS NOT NULL) AS fairness FROM details""")
def bias_report(spark, sf):
    return bias.bias_report(details(spark, sf))


@register("fairness_scorecard", f"""
WITH {DETAILS_CTE}, m AS (SELECT coalesce(avg(bias_score), 60) AS b, coalesce(avg(disparate_impact), 0.8) AS d FROM details),
axes AS (SELECT 'demographic_parity' AS axis, 100 - b AS v FROM m UNION ALL SELECT 'equal_opportunity', 85 - 0.3::DOUBLE * b FROM m
UNION ALL SELECT 'disparate_impact', 100 * least(d, 1 / greatest(d, 0.01::DOUBLE)) FROM m
UNION ALL SELECT 'statistical_parity', 100 - 0.8::DOUBLE * b FROM m UNION ALL SELECT 'calibration', 100 - 0.25::DOUBLE * b FROM m
UNION ALL SELECT 'treatment_equality', 100 - 0.6::DOUBLE * b FROM m)
SELECT axis, greatest(0.0::DOUBLE, least(100.0::DOUBLE, round(v))) AS score FROM axes""")
def fairness_scorecard(spark, sf):
    return bias.fairness_scorecard(details(spark, sf))


@register("crosstab_marginal_join", """
WITH c AS (SELECT l_returnflag AS x, l_linestatus AS y, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT x, y, n, CAST(sum(n) OVER (PARTITION BY x) AS BIGINT) AS row_total, CAST(sum(n) OVER (PARTITION BY y) AS BIGINT)
AS column_total, round(sum(n) OVER (PARTITION BY x) * CAST(sum(n) OVER (PARTITION BY y) AS DOUBLE) / sum(n) OVER (), 4)
AS expected FROM c""")
def crosstab_marginal_join(spark, sf):
    return bias.crosstab_totals(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


# --- number columns -----------------------------------------------------------------------

_EXTRA = "quantity_cents"
_LINES = f"lines AS (SELECT {', '.join(LINEITEM_NUMBERS)}, l_quantity * 100 + 1 AS {_EXTRA} FROM lineitem)"
_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, coalesce(abs(corr({a}, {b})), 0) AS correlation FROM lines"
    for i, a in enumerate(LINEITEM_NUMBERS + [_EXTRA]) for b in (LINEITEM_NUMBERS + [_EXTRA])[i + 1:])


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(*LINEITEM_NUMBERS, (F.col("l_quantity") * 100 + 1).alias(_EXTRA))


@register("correlation_matrix", f"""
WITH {_LINES}, c AS ({_CORR}) SELECT column_a, column_b, round(correlation, 6) AS correlation FROM c""")
def correlation_matrix(spark, sf):
    return bias.correlation_matrix(_lines(spark, sf)).withColumn("correlation", F.round("correlation", 6))


@register("redundant_columns", f"WITH {_LINES}, c AS ({_CORR}) SELECT column_a, column_b FROM c WHERE correlation > 0.98")
def redundant_columns(spark, sf):
    return bias.redundant_columns(_lines(spark, sf))


@register("correlation_bands", f"""
WITH {_LINES}, c AS ({_CORR}) SELECT column_a, column_b, round(correlation, 6) AS correlation,
CASE WHEN correlation > 0.9 THEN 'very high' WHEN correlation > 0.8 THEN 'high' WHEN correlation > 0.7 THEN 'moderate'
ELSE 'low' END AS band FROM c ORDER BY correlation DESC, column_a, column_b""")
def correlation_bands(spark, sf):
    return bias.correlation_bands(_lines(spark, sf))
