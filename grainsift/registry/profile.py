"""Profiles and missing values."""

from __future__ import annotations

from grainsift.operators import profile
from grainsift.registry import register
from grainsift.registry.sources import MISSING_SQL
from grainsift.registry.views import (
    LINEITEM_NUMBERS, PEOPLE_COLUMNS, PEOPLE_CTE, each, people, people_holes, table)
from grainsift.operators.noise import empty_rows
from grainsift.registry.views import HOLES_CTE

_PEOPLE_TYPES = {"id": "bigint", "age": "double", "gender": "string", "income": "string", "category": "string",
                 "score": "int", "email": "string", "notes": "string", "flag": "string"}
_KINDS = {"bigint": "integer", "int": "integer", "double": "floating", "string": "string"}


def _typed(template: str) -> str:
    return " UNION ALL ".join("(" + template.replace("@T", t).replace("@K", _KINDS[t]).replace("@", c) + ")"
                              for c, t in _PEOPLE_TYPES.items())


@register("profile_columns", f"WITH {PEOPLE_CTE} " + _typed(
    "SELECT '@' AS column_name, '@T' AS dtype, '@K' AS inferred_type, count(DISTINCT @) AS unique_count, "
    "count(DISTINCT @) / CAST(count(*) AS DOUBLE) AS unique_ratio, count(*) - count(@) AS missing_count, "
    "(count(*) - count(@)) / CAST(count(*) AS DOUBLE) AS missing_fraction FROM people"))
def profile_columns(spark, sf):
    return profile.profile_columns(people(spark, sf).drop("row_id"))


def _round(df, places, *names):
    from pyspark.sql import functions as F
    return df.withColumns({n: F.round(n, places) for n in names})


@register("profile_numeric", each(
    "SELECT '@' AS column_name, round(avg(@), 5) AS mean, round(stddev_samp(@), 5) AS std, "
    "CAST(min(@) AS DOUBLE) AS min, CAST(max(@) AS DOUBLE) AS max, round(skewness(@), 5) AS skew FROM lineitem",
    LINEITEM_NUMBERS))
def profile_numeric(spark, sf):
    return _round(profile.profile_numeric(table(spark, sf, "lineitem").select(*LINEITEM_NUMBERS)),
                  5, "mean", "std", "skew")


@register("inferred_dtype", f"WITH {PEOPLE_CTE} " + _typed(
    "SELECT '@' AS column_name, '@T' AS dtype, CASE WHEN count(@) = 0 THEN 'empty' ELSE '@K' END AS inferred_type "
    "FROM people"))
def inferred_dtype(spark, sf):
    return profile.inferred_kinds(people(spark, sf).drop("row_id"))


@register("describe_numeric", each(
    "SELECT '@' AS column_name, count(@) AS n, round(avg(@), 4) AS mean, round(stddev_samp(@), 4) AS std, "
    "round(CAST(min(@) AS DOUBLE), 4) AS min, round(CAST(quantile_cont(@, 0.25) AS DOUBLE), 4) AS p25, "
    "round(CAST(quantile_cont(@, 0.5) AS DOUBLE), 4) AS p50, round(CAST(quantile_cont(@, 0.75) AS DOUBLE), 4) AS p75, "
    "round(CAST(max(@) AS DOUBLE), 4) AS max FROM lineitem", LINEITEM_NUMBERS))
def describe_numeric(spark, sf):
    return profile.describe_numeric(table(spark, sf, "lineitem"))


_MISSING_TOTALS = " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) AS n, count(*) - count({c}) AS m FROM people" for c in PEOPLE_COLUMNS)


@register("missing_summary", f"""
WITH {PEOPLE_CTE}, totals AS ({_MISSING_TOTALS})
SELECT CAST(sum(m) AS BIGINT) AS total_missing, round(sum(m) / CAST(sum(n) AS DOUBLE), 4) AS missing_fraction,
       string_agg(c, ',' ORDER BY c) FILTER (WHERE m > 0) AS missing_columns FROM totals""")
def missing_summary(spark, sf):
    return profile.missing_summary(people(spark, sf).drop("row_id"))


@register("dataset_info", f"WITH {PEOPLE_CTE} " + _typed(
    "SELECT '@' AS column_name, '@T' AS dtype, count(*) AS n_rows, CAST(9 AS BIGINT) AS n_columns, "
    "round((count(*) - count(@)) / CAST(count(*) AS DOUBLE), 4) AS missing_fraction FROM people"))
def dataset_info(spark, sf):
    return profile.dataset_info(people(spark, sf).drop("row_id"))


@register("missing_by_column", MISSING_SQL)
def missing_by_column(spark, sf):
    return profile.missing_by_column(people(spark, sf).drop("row_id"))


@register("empty_rows", f"""
WITH {HOLES_CTE} SELECT row_id FROM holes
WHERE age IS NULL AND gender IS NULL AND category IS NULL""")
def q_empty_rows(spark, sf):
    return empty_rows(people_holes(spark, sf), "row_id", ["age", "gender", "category"])
