"""Type inference, filling and the cleaning run."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.config import CleaningConfig
from grainsift.operators import dates, impute, typeinfer
from grainsift.plans.cleaning import clean, clean_summary
from grainsift.registry import register
from grainsift.registry.duplicates import GROUPS_CTE
from grainsift.registry.views import (
    EVENTS_CTE, HOLES_CTE, PEOPLE_CTE, TYPED_CTE, each, events_gappy, people, people_holes, typed_text)

_TYPED_TEXTS = ["flag_text", "whole_text", "decimal_text", "date_text", "priority", "free_text", "time_text", "seat_text",
                "gap_text", "no_date_text", "day_text", "half_text", "slip_text", "both_text", "nothing"]
_DATE_COLUMNS = ["date_text", "time_text", "no_date_text", "day_text", "half_text", "slip_text", "both_text"]
_YEAR_FIRST = ("try_strptime(@, ['%Y-%m-%d', '%Y/%m/%d', '%Y%m%d', '%Y-%m-%dT%H:%M:%SZ', '%Y-%m-%dT%H:%M:%S.%g', "
               "'%Y-%m-%d %H:%M'])")
_MONTH_FIRST = "try_strptime(@, ['%m/%d/%Y', '%m-%d-%Y', '%m/%d/%Y %H:%M', '%m-%d-%Y %H:%M'])"
_DAY_FIRST = "try_strptime(@, ['%d/%m/%Y', '%d-%m-%Y', '%d/%m/%Y %H:%M', '%d-%m-%Y %H:%M'])"
_SHARES = each(
    r"SELECT '@' AS column_name, count(@) AS n, count(DISTINCT @) AS d, "
    r"count(*) FILTER (WHERE regexp_matches(lower(@), '^(true|false|yes|no|1|0|t|f|y|n)$')) AS b, "
    r"count(*) FILTER (WHERE regexp_matches(@, '^-?\d+$')) AS i, "
    r"count(*) FILTER (WHERE regexp_matches(@, '^-?\d+(\.\d+)?([eE][+-]?\d+)?$')) AS f, "
    r"count(*) FILTER (WHERE regexp_matches(@, '^\d{4}[-/]\d{2}[-/]\d{2}|^\d{2}[-/]\d{2}[-/]\d{4}|^\d{8}$')) AS t, "
    f"count({_YEAR_FIRST}) AS year_first, count({_MONTH_FIRST}) AS month_first, count({_DAY_FIRST}) AS day_first, "
    r"count(TRY_CAST(@ AS DOUBLE)) AS x, count(*) FILTER (WHERE TRY_CAST(@ AS DOUBLE) % 1 = 0) AS w FROM typed",
    _TYPED_TEXTS)
_KINDS = f"""{TYPED_CTE}, s AS ({_SHARES}), kinds AS (SELECT *, CASE WHEN n = 0 THEN 'unknown'
WHEN b >= 0.9 * n THEN 'boolean' WHEN i >= 0.9 * n THEN 'integer' WHEN f >= 0.9 * n THEN 'float'
WHEN t >= 0.85 * n AND year_first + greatest(month_first, day_first) >= 0.85 * n THEN 'datetime'
WHEN x >= 0.9 * n THEN CASE WHEN w = x THEN 'integer' ELSE 'float' END
WHEN d < 0.1 * n AND d <= 30 THEN 'categorical' ELSE 'string' END AS inferred_type FROM s)"""


@register("infer_types", f"WITH {_KINDS} SELECT column_name, inferred_type FROM kinds")
def infer_types(spark, sf):
    return typeinfer.infer_types(typed_text(spark, sf))


def _micros(column: str, *readings: str) -> str:
    return f"epoch_us(coalesce({', '.join(readings)})) AS {column}".replace("@", column)


@register("convert_types", f"""
WITH {TYPED_CTE} SELECT row_id, flag_text = 'yes' AS flag_text, CAST(whole_text AS BIGINT) AS whole_text,
TRY_CAST(decimal_text AS DOUBLE) AS decimal_text, {_micros('date_text', _YEAR_FIRST, _MONTH_FIRST)}, priority, free_text,
{_micros('time_text', _YEAR_FIRST, _DAY_FIRST)}, seat_text, gap_text = 'yes' AS gap_text, no_date_text,
{_micros('day_text', _YEAR_FIRST, _DAY_FIRST)}, half_text, {_micros('slip_text', _YEAR_FIRST, _MONTH_FIRST)}, both_text, nothing
FROM typed""")
def convert_types(spark, sf):
    converted, _ = typeinfer.convert_types(typed_text(spark, sf))
    return converted.withColumns({c: F.unix_micros(c) for c in ("date_text", "time_text", "day_text", "slip_text")})


@register("convert_report", f"""
WITH {_KINDS}
SELECT column_name, 'string' AS original_type, inferred_type, CASE inferred_type WHEN 'integer' THEN 'bigint' WHEN 'float' THEN 'double'
  WHEN 'boolean' THEN 'boolean' WHEN 'datetime' THEN 'timestamp' WHEN 'categorical' THEN 'category' END AS converted_to,
  CASE WHEN inferred_type IN ('string', 'categorical') AND t > 0 AND t >= 0.85 * n
    THEN 'looks like dates that cannot be read in one order' END AS failure,
  CASE inferred_type WHEN 'integer' THEN n - x WHEN 'float' THEN n - x WHEN 'boolean' THEN n - b
    WHEN 'datetime' THEN n - year_first - greatest(month_first, day_first) ELSE 0 END AS values_lost,
  CASE WHEN inferred_type = 'datetime' AND greatest(month_first, day_first) > 0
    THEN CASE WHEN day_first > month_first THEN 'day first' ELSE 'month first' END END AS date_order FROM kinds
UNION ALL SELECT 'row_id', 'bigint', 'bigint', NULL, NULL, 0, NULL""")
def convert_report(spark, sf):
    _, report = typeinfer.convert_types(typed_text(spark, sf))
    return report


_FORMS = {"yyyy-MM-dd": ["%Y-%m-%d"], "yyyy-MM-dd HH:mm": ["%Y-%m-%d %H:%M", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%g"],
          "yyyyMMdd": ["%Y%m%d"], "MM/dd/yyyy": ["%m/%d/%Y"], "dd/MM/yyyy": ["%d/%m/%Y"],
          "MM-dd-yyyy": ["%m-%d-%Y", "%m-%d-%Y %H:%M"], "dd-MM-yyyy": ["%d-%m-%Y", "%d-%m-%Y %H:%M"]}


def _formed(patterns: list[str]) -> str:
    return f"try_strptime(text, {patterns}) IS NOT NULL"


@register("date_formats", f"""
WITH {TYPED_CTE},
v AS ({each("SELECT '@' AS column_name, @ AS text, count(*) AS n FROM typed WHERE @ IS NOT NULL GROUP BY @", _DATE_COLUMNS)}),
hits AS ({" UNION ALL ".join(f"SELECT column_name, '{form}' AS date_format, n FROM v WHERE {_formed(p)}" for form, p in _FORMS.items())}
  UNION ALL SELECT column_name, 'none', n FROM v WHERE NOT ({_formed(sum(_FORMS.values(), []))}))
SELECT column_name, date_format, CAST(sum(n) AS BIGINT) AS n FROM hits GROUP BY 1, 2""")
def date_formats(spark, sf):
    return dates.date_formats(typed_text(spark, sf), _DATE_COLUMNS)


# --- filling --------------------------------------------------------------------------------

def _median(c: str) -> str:
    return f"(SELECT CAST(quantile_cont({c}, 0.5) AS DOUBLE) FROM people)"


def _mode(c: str, source: str = "people") -> str:
    return (f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)")


@register("impute_mean", f"""
WITH {PEOPLE_CTE} SELECT row_id, round(coalesce(age, (SELECT avg(age) FROM people)), 4) AS age,
coalesce(email, {_mode('email')}) AS email FROM people""")
def impute_mean(spark, sf):
    filled, _ = impute.impute(people(spark, sf), "mean")
    return filled.select("row_id", F.round("age", 4).alias("age"), "email")


@register("impute_median", f"""
WITH {PEOPLE_CTE} SELECT row_id, round(coalesce(age, {_median('age')}), 4) AS age,
coalesce(email, {_mode('email')}) AS email FROM people""")
def impute_median(spark, sf):
    filled, _ = impute.impute(people(spark, sf), "median")
    return filled.select("row_id", F.round("age", 4).alias("age"), "email")


@register("impute_mode", f"""
WITH {HOLES_CTE} SELECT row_id, coalesce(age, {_mode('age', 'holes')}) AS age,
coalesce(gender, {_mode('gender', 'holes')}) AS gender, coalesce(category, {_mode('category', 'holes')}) AS category FROM holes""")
def impute_mode(spark, sf):
    filled, _ = impute.impute(people_holes(spark, sf), "mode")
    return filled.select("row_id", "age", "gender", "category")


_DIRECTION = """SELECT event_id, user_id, round(%s(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
ROWS BETWEEN %s), 4) AS value FROM gappy"""


@register("impute_ffill", f"WITH {EVENTS_CTE} " + _DIRECTION % ("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def impute_ffill(spark, sf):
    filled = impute.fill_directional(events_gappy(spark, sf), ["value"], ["ts", "event_id"], ["user_id"])
    return filled.select("event_id", "user_id", F.round("value", 4).alias("value"))


@register("impute_bfill", f"WITH {EVENTS_CTE} " + _DIRECTION % ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"))
def impute_bfill(spark, sf):
    filled = impute.fill_directional(events_gappy(spark, sf), ["value"], ["ts", "event_id"], ["user_id"], forward=False)
    return filled.select("event_id", "user_id", F.round("value", 4).alias("value"))


@register("impute_ffill_global", f"WITH {EVENTS_CTE} " + _DIRECTION.replace("PARTITION BY user_id ", "")
          % ("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"))
def impute_ffill_global(spark, sf):
    # small stretches, so that the hand-over between them is part of the check
    filled = impute.fill_directional(events_gappy(spark, sf), ["value"], ["ts", "event_id"], rows_per_bucket=1_000)
    return filled.select("event_id", "user_id", F.round("value", 4).alias("value"))


@register("impute_drop", f"WITH {HOLES_CTE} SELECT row_id, age, gender, category FROM holes "
                         "WHERE age IS NOT NULL AND gender IS NOT NULL AND category IS NOT NULL")
def impute_drop(spark, sf):
    kept, _ = impute.impute(people_holes(spark, sf), "drop")
    return kept.select("row_id", "age", "gender", "category")


@register("impute_report", f"""
WITH {HOLES_CTE}, left_over AS (SELECT * FROM holes WHERE gender IS NOT NULL)
SELECT 'age' AS column_name, 'mean' AS strategy_used, (SELECT count(*) - count(age) FROM holes) AS cells_filled,
  CAST((SELECT round(avg(age), 4) FROM holes) AS STRING) AS fill_value
UNION ALL SELECT 'gender', 'drop', (SELECT count(*) - count(gender) FROM holes), NULL
UNION ALL SELECT 'category', 'mode (fallback)', (SELECT count(*) - count(category) FROM left_over), {_mode('category', 'left_over')}
UNION ALL SELECT 'active', 'mode (fallback)', (SELECT count(*) FROM left_over WHERE row_id % 30 = 0),
  (SELECT CASE WHEN count(*) FILTER (WHERE row_id % 3 = 0) > count(*) FILTER (WHERE row_id % 3 <> 0) THEN 'True' ELSE 'False' END
   FROM left_over WHERE row_id % 30 <> 0)
UNION ALL SELECT 'never', 'failed', CAST(0 AS BIGINT), NULL""")
def impute_report(spark, sf):
    rows = people_holes(spark, sf).withColumns({
        "active": F.when(F.col("row_id") % 30 != 0, F.col("row_id") % 3 == 0), "never": F.lit(None).cast("timestamp")})
    _, report = impute.impute(rows, "mean", {"gender": "drop"})
    return report


# --- the whole run --------------------------------------------------------------------------

_EXACT_ONLY = CleaningConfig(remove_fuzzy_duplicates=False)
_CLEAN_CTE = rf"""{PEOPLE_CTE},
typed AS (SELECT row_id, id, age, gender, CAST(CASE WHEN regexp_matches(income, '^-?\d+$') THEN income END AS BIGINT) AS income,
  category, score = 1 AS unused, score, email, notes, flag FROM people),
one AS (SELECT min(row_id) AS row_id, id, age, gender, income, category, score, email, notes, flag FROM typed
  GROUP BY id, age, gender, income, category, score, email, notes, flag),
@two@
filled AS (SELECT row_id, CAST(id AS DOUBLE) AS id, coalesce(age, (SELECT quantile_cont(age, 0.5) FROM one)) AS age, gender,
  coalesce(CAST(income AS DOUBLE), (SELECT CAST(quantile_cont(income, 0.5) AS DOUBLE) FROM one)) AS income, category, score,
  coalesce(email, (SELECT email FROM one WHERE email IS NOT NULL GROUP BY email ORDER BY count(*) DESC, email LIMIT 1)) AS email,
  notes, flag FROM one),
fences AS (SELECT quantile_cont(id, 0.25) - 1.5 * (quantile_cont(id, 0.75) - quantile_cont(id, 0.25)) AS id_lo,
  quantile_cont(id, 0.75) + 1.5 * (quantile_cont(id, 0.75) - quantile_cont(id, 0.25)) AS id_hi,
  quantile_cont(age, 0.25) - 1.5 * (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) AS age_lo,
  quantile_cont(age, 0.75) + 1.5 * (quantile_cont(age, 0.75) - quantile_cont(age, 0.25)) AS age_hi,
  quantile_cont(income, 0.25) - 1.5 * (quantile_cont(income, 0.75) - quantile_cont(income, 0.25)) AS income_lo,
  quantile_cont(income, 0.75) + 1.5 * (quantile_cont(income, 0.75) - quantile_cont(income, 0.25)) AS income_hi FROM filled)"""
# all texts but the e-mails become categories, so near duplicates are rows with the same e-mail or with none
_ALIKE = "two AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY email ORDER BY row_id) = 1),"
_CLEAN_ALL_CTE = _CLEAN_CTE.replace("@two@", _ALIKE).replace("FROM one)", "FROM two)").replace("FROM one W", "FROM two W").replace(
    "notes, flag FROM one", "notes, flag FROM two")
_CLEAN_CTE = _CLEAN_CTE.replace("@two@", "")


@register("clean_table", f"""
WITH {_CLEAN_CTE} SELECT row_id, round(greatest(age_lo, least(age_hi, age)), 4) AS age,
round(greatest(income_lo, least(income_hi, income)), 4) AS income, gender, category, score, email, notes, flag
FROM filled, fences""")
def clean_table(spark, sf):
    table = clean(people(spark, sf), _EXACT_ONLY, "row_id").table
    return table.select("row_id", F.round("age", 4).alias("age"), F.round("income", 4).alias("income"),
                        "gender", "category", "score", "email", "notes", "flag")


@register("clean_table_default", f"""
WITH {_CLEAN_ALL_CTE} SELECT row_id, round(CASE WHEN age_lo = age_hi THEN age ELSE greatest(age_lo, least(age_hi, age)) END, 4) AS age,
round(greatest(income_lo, least(income_hi, income)), 4) AS income, gender, category, score, email, notes, flag
FROM filled, fences""")
def clean_table_default(spark, sf):
    table = clean(people(spark, sf), CleaningConfig(), "row_id").table
    return table.select("row_id", F.round("age", 4).alias("age"), F.round("income", 4).alias("income"),
                        "gender", "category", "score", "email", "notes", "flag")


_AGE_CAPPED = "(age_lo <> age_hi AND (age < age_lo OR age > age_hi))"


@register("clean_summary", f"""
WITH {_CLEAN_ALL_CTE}, c AS (SELECT (SELECT count(*) FROM people) AS before, (SELECT count(*) FROM one) AS exact,
(SELECT count(*) FROM two) AS after, (SELECT count(*) * 3 - count(age) - count(income) - count(email) FROM two) AS filled_cells,
(SELECT count(*) FILTER (WHERE {_AGE_CAPPED}) + count(*) FILTER (WHERE income < income_lo OR income > income_hi)
 + count(*) FILTER (WHERE id < id_lo OR id > id_hi) FROM filled, fences) AS capped)
SELECT before - after AS rows_removed, filled_cells + capped AS cells_cleaned, round(100.0::DOUBLE * after / before, 4)
AS retention_pct, round(100.0::DOUBLE * (before - exact) / before, 4) AS exact_duplicate_pct FROM c""")
def q_clean_summary(spark, sf):
    return clean_summary(clean(people(spark, sf), CleaningConfig(), "row_id"))


@register("change_log", rf"""
WITH {_CLEAN_CTE}, lost AS (SELECT row_id, income AS old FROM people WHERE income IS NOT NULL AND NOT regexp_matches(income, '^-?\d+$')),
same AS (SELECT p.row_id, o.row_id AS kept FROM typed p JOIN one o ON p.id IS NOT DISTINCT FROM o.id AND p.row_id <> o.row_id)
SELECT row_id, 'types' AS stage, 'income' AS column_name, old AS old_value, NULL AS new_value, NULL AS kept_id FROM lost
UNION ALL SELECT row_id, 'exact_duplicate', NULL, NULL, NULL, CAST(kept AS STRING) FROM same
UNION ALL SELECT row_id, 'missing', 'age', NULL, CAST(CAST(f.age AS DECIMAL(18, 2)) AS STRING), NULL FROM one o JOIN filled f USING (row_id) WHERE o.age IS NULL
UNION ALL SELECT row_id, 'missing', 'income', NULL, CAST(CAST(f.income AS DECIMAL(18, 2)) AS STRING), NULL FROM one o JOIN filled f USING (row_id) WHERE o.income IS NULL
UNION ALL SELECT row_id, 'missing', 'email', NULL, f.email, NULL FROM one o JOIN filled f USING (row_id) WHERE o.email IS NULL
UNION ALL SELECT row_id, 'outliers', 'age', CAST(CAST(age AS DECIMAL(18, 2)) AS STRING),
  CAST(CAST(greatest(age_lo, least(age_hi, age)) AS DECIMAL(18, 2)) AS STRING), NULL FROM filled, fences WHERE {_AGE_CAPPED}
UNION ALL SELECT row_id, 'outliers', 'income', CAST(CAST(income AS DECIMAL(18, 2)) AS STRING),
  CAST(CAST(greatest(income_lo, least(income_hi, income)) AS DECIMAL(18, 2)) AS STRING), NULL
  FROM filled, fences WHERE income < income_lo OR income > income_hi""")
def change_log(spark, sf):
    changes = clean(people(spark, sf), _EXACT_ONLY, "row_id").changes.drop("similarity")
    number = F.col("column_name").isin("age", "income") & (F.col("stage") != "types")
    return changes.withColumns({c: F.when(number, F.col(c).cast("decimal(18,2)").cast("string")).otherwise(F.col(c))
                                for c in ("old_value", "new_value")})
