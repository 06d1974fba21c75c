"""Noise findings, placeholders and spellings."""

from __future__ import annotations

from pyspark.sql import functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.similarity import indel_ratio, levenshtein_similarity
from grainsift.operators import noise, semantic, values
from grainsift.operators.outliers import outlier_rows
from grainsift.registry import register
from grainsift.registry.views import (
    HOLES_CTE, PEOPLE_COLUMNS, PEOPLE_CTE, PEOPLE_NUMBERS, PEOPLE_TEXTS, each, people, people_holes, table)

_SENTINELS = ", ".join(f"'{s}'" for s in fixed.SENTINELS)
_BLANK = r"regexp_matches(@, '^\s|\s$')"


def _data(spark, sf):
    return people(spark, sf).drop("row_id")


@register("sentinel_filter", f"WITH {PEOPLE_CTE} SELECT row_id, category AS value FROM people "
                             f"WHERE lower(category) IN ({_SENTINELS})")
def sentinel_filter(spark, sf):
    return noise.sentinel_rows(people(spark, sf), "category", "row_id")


@register("whitespace_filter", f"WITH {PEOPLE_CTE} SELECT row_id, category AS value FROM people "
                               f"WHERE {_BLANK.replace('@', 'category')}")
def whitespace_filter(spark, sf):
    return noise.whitespace_rows(people(spark, sf), "category", "row_id")


@register("outlier_rows", f"""
WITH {PEOPLE_CTE}, q AS (SELECT quantile_cont(age, 0.25) AS q1, quantile_cont(age, 0.75) AS q3 FROM people)
SELECT row_id, age AS value FROM people, q WHERE age < q1 - 1.5 * (q3 - q1) OR age > q3 + 1.5 * (q3 - q1)""")
def q_outlier_rows(spark, sf):
    return outlier_rows(people(spark, sf), "age", "row_id")


_CONSTANT = each("SELECT '@' AS column_name, count(DISTINCT @) AS d FROM people", PEOPLE_COLUMNS)


@register("constant_columns", f"WITH {PEOPLE_CTE}, d AS ({_CONSTANT}) SELECT column_name FROM d WHERE d <= 1")
def constant_columns(spark, sf):
    return noise.constant_columns(_data(spark, sf))


_HOLE_COLUMNS = ["row_id", "age", "gender", "category", "mostly"]
_TOP = each("SELECT '@' AS column_name, max(n) AS top, CAST(sum(n) AS BIGINT) AS n, count(*) AS d FROM "
            "(SELECT @, count(*) AS n FROM holes WHERE @ IS NOT NULL GROUP BY @)", _HOLE_COLUMNS)


@register("low_variance_columns", f"""
WITH {HOLES_CTE}, t AS ({_TOP})
SELECT column_name, round(top / CAST(n AS DOUBLE), 4) AS top_fraction FROM t WHERE d > 1 AND top > 0.95 * n""")
def low_variance_columns(spark, sf):
    return noise.low_variance_columns(people_holes(spark, sf))


_DISTINCT_TEXT = each("SELECT '@' AS column_name, count(DISTINCT @) AS d, count(*) AS n FROM customer",
                      ["c_name", "c_mktsegment"])


@register("high_cardinality_columns", f"""
WITH d AS ({_DISTINCT_TEXT}) SELECT column_name FROM d WHERE d > 0.5 * n AND d > 20""")
def high_cardinality_columns(spark, sf):
    return noise.high_cardinality_columns(table(spark, sf, "customer"))


_NUMERIC_TEXT = each(r"SELECT '@' AS column_name, count(@) AS n, "
                     r"count(*) FILTER (WHERE regexp_matches(@, '^-?\d+(\.\d+)?$')) AS k FROM people", PEOPLE_TEXTS)


@register("formatting_errors", f"""
WITH {PEOPLE_CTE}, t AS ({_NUMERIC_TEXT})
SELECT column_name, n - k AS error_count FROM t WHERE k > 0 AND k < n""")
def formatting_errors(spark, sf):
    return noise.formatting_errors(_data(spark, sf))


_LIKE_NUMBERS = each(r"SELECT '@' AS column_name, count(@) AS n, count(*) FILTER (WHERE regexp_matches(@, "
                     r"'^[\$€£]?\s*-?[\d,]+(?:\.\d+)?\s*[kKmMbB]?\s*$')) AS k FROM people", PEOPLE_TEXTS)


@register("datatype_noise", f"""
WITH {PEOPLE_CTE}, t AS ({_LIKE_NUMBERS})
SELECT column_name, k AS mismatch_count, CASE WHEN k < n THEN 'Mixed numeric and string types'
ELSE 'Numeric values stored as strings' END AS issue FROM t WHERE k > 0""")
def datatype_noise(spark, sf):
    return noise.datatype_noise(_data(spark, sf))


# longest common subsequence by rows of a table, one per character of the first string
_LCS = """CAST(list_reduce(list_prepend(list_transform(range(0, length(b) + 1), lambda z: CAST(0 AS BIGINT)),
  list_transform(range(1, length(a) + 1), lambda i: [CAST(i AS BIGINT)])),
  lambda prev, ci: list_reduce(list_prepend([CAST(0 AS BIGINT)],
    list_transform(range(1, length(b) + 1), lambda j: [CAST(j AS BIGINT)])),
    lambda row, cj: list_append(row, CASE WHEN substr(a, ci[1], 1) = substr(b, cj[1], 1) THEN prev[cj[1]] + 1
                                     ELSE greatest(prev[cj[1] + 1], row[cj[1]]) END)))[-1] AS BIGINT)"""

_SPELLINGS = each("SELECT DISTINCT '@' AS column_name, lower(regexp_replace(@, '^\\s+|\\s+$', '', 'g')) AS v "
                  "FROM people WHERE @ IS NOT NULL", PEOPLE_TEXTS)
_FUZZY_CTE = f"""{PEOPLE_CTE}, spelled AS ({_SPELLINGS}),
pairs AS (SELECT x.column_name, x.v AS a, y.v AS b FROM spelled x JOIN spelled y
          ON x.column_name = y.column_name AND x.v < y.v
          AND 200.0 * least(length(x.v), length(y.v)) / (length(x.v) + length(y.v)) >= 85
          AND levenshtein(x.v, y.v) <= 0.15 * (length(x.v) + length(y.v))),
scored AS (SELECT column_name, a, b, CAST(200.0 * {_LCS} / (length(a) + length(b)) AS DOUBLE) AS score FROM pairs),
fuzzy AS (SELECT * FROM scored WHERE score >= 85)"""


@register("indel_theta_join", f"""
WITH {_FUZZY_CTE} SELECT column_name, a AS value_a, b AS value_b, round(score, 6) AS score FROM fuzzy""")
def indel_theta_join(spark, sf):
    pairs = noise.fuzzy_pairs(_data(spark, sf))
    return pairs.select("column_name", "value_a", "value_b", F.round("score", 6).alias("score"))


_CATEGORIES = """SELECT column_name, a AS value, b AS match FROM fuzzy UNION ALL SELECT column_name, b, a FROM fuzzy"""


@register("fuzzy_categories", f"WITH {_FUZZY_CTE} {_CATEGORIES}")
def fuzzy_categories(spark, sf):
    return noise.fuzzy_categories(_data(spark, sf))


_VALUE_COUNTS = each(
    f"SELECT '@' AS column_name, count(*) FILTER (WHERE lower(@) IN ({_SENTINELS})) AS s, "
    f"count(*) FILTER (WHERE {_BLANK}) AS w FROM people", PEOPLE_TEXTS)


@register("value_noise", f"""
WITH {_FUZZY_CTE}, categories AS ({_CATEGORIES}), counts AS ({_VALUE_COUNTS}),
g AS (SELECT column_name, count(DISTINCT value) AS k FROM categories GROUP BY column_name)
SELECT column_name, s AS sentinel_count, w AS whitespace_count, coalesce(k, 0) AS fuzzy_values,
       s + w AS noisy_count, s > 0 OR w > 0 OR coalesce(k, 0) > 0 AS affected
FROM counts LEFT JOIN g USING (column_name)""")
def value_noise(spark, sf):
    return noise.value_noise(_data(spark, sf))


_STRUCT_COLUMNS = ["age", "gender", "category", "blank"]
_HOLES_BLANK = f"{HOLES_CTE}, wide AS (SELECT row_id, age, gender, category, CAST(NULL AS STRING) AS blank FROM holes)"
_STRUCT_TOP = each("SELECT '@' AS c, coalesce(max(n), 0) AS top, CAST(coalesce(sum(n), 0) AS BIGINT) AS n, "
                   "count(*) AS d FROM (SELECT @, count(*) AS n FROM wide WHERE @ IS NOT NULL GROUP BY @)", _STRUCT_COLUMNS)


@register("structural_noise", f"""
WITH {_HOLES_BLANK}, t AS ({_STRUCT_TOP})
SELECT 'empty_row' AS kind, CAST(row_id AS STRING) AS item FROM wide
WHERE age IS NULL AND gender IS NULL AND category IS NULL
UNION ALL SELECT 'constant_column', c FROM t WHERE d <= 1
UNION ALL SELECT 'low_variance_column', c FROM t WHERE d > 1 AND top > 0.95 * n""")
def structural_noise(spark, sf):
    wide = people_holes(spark, sf).select("row_id", "age", "gender", "category", F.lit(None).cast("string").alias("blank"))
    return noise.structural_noise(wide, "row_id")


_OUTLIERS = each("SELECT '@' AS c, count(@) AS n, count(*) FILTER (WHERE @ < q1 - 1.5 * (q3 - q1) OR "
                 "@ > q3 + 1.5 * (q3 - q1)) AS k FROM people, (SELECT quantile_cont(@, 0.25) AS q1, "
                 "quantile_cont(@, 0.75) AS q3 FROM people)", PEOPLE_NUMBERS)
_MISSING = each("SELECT '@' AS c, count(*) - count(@) AS m FROM people", PEOPLE_COLUMNS)
_CARD = each("SELECT '@' AS c, count(DISTINCT @) AS d, count(*) AS n FROM people", PEOPLE_TEXTS)
NOISE_CTE = f"""{PEOPLE_CTE}, o AS ({_OUTLIERS}), m AS ({_MISSING}), f AS ({_NUMERIC_TEXT}),
k AS ({_CONSTANT}), h AS ({_CARD}), findings AS (
SELECT 'missing_cells' AS finding, c AS column_name, CAST(m AS DOUBLE) AS value FROM m WHERE m > 0
UNION ALL SELECT 'outliers', c, CAST(k AS DOUBLE) FROM o
UNION ALL SELECT 'outlier_fraction', c, round(k / CAST(n AS DOUBLE), 4) FROM o
UNION ALL SELECT 'formatting_errors', column_name, CAST(n - k AS DOUBLE) FROM f WHERE k > 0 AND k < n
UNION ALL SELECT 'constant_column', column_name, 1.0::DOUBLE FROM k WHERE d <= 1
UNION ALL SELECT 'high_cardinality_column', c, 1.0::DOUBLE FROM h WHERE d > 0.5 * n AND d > 20)"""


@register("noise_report", f"WITH {NOISE_CTE} SELECT * FROM findings")
def noise_report(spark, sf):
    return noise.noise_report(_data(spark, sf))


@register("noise_breakdown", f"""
WITH {NOISE_CTE}, s AS (SELECT CASE finding WHEN 'outliers' THEN 'Outliers' WHEN 'formatting_errors' THEN 'Formatting errors'
  WHEN 'missing_cells' THEN 'Missing cells' WHEN 'constant_column' THEN 'Constant columns' END AS slice, value
  FROM findings WHERE value > 0),
t AS (SELECT slice, CAST(sum(value) AS BIGINT) AS n FROM s WHERE slice IS NOT NULL GROUP BY slice)
SELECT * FROM t UNION ALL SELECT 'Clean', 1 WHERE NOT EXISTS (SELECT 1 FROM t)""")
def noise_breakdown(spark, sf):
    return noise.noise_breakdown(_data(spark, sf))


# --- spelled almost alike --------------------------------------------------------------

_SPELLED = "(SELECT *, concat(p_name, ' ', p_type, ' ', p_brand) AS p_full FROM part)"
_PART_TEXTS = ["p_name", "p_type", "p_brand", "p_full"]
_VALUES = each(f"SELECT '@' AS column_name, @ AS v, count(*) AS n FROM {_SPELLED} GROUP BY @", _PART_TEXTS)
_SIMILAR = f"""vals AS ({_VALUES}),
sem AS (SELECT x.column_name, x.v AS a, y.v AS b, x.n + y.n AS n,
  CAST(1 AS DOUBLE) - levenshtein(x.v, y.v) / CAST(greatest(length(x.v), length(y.v)) AS DOUBLE) AS score
  FROM vals x JOIN vals y ON x.column_name = y.column_name AND x.v < y.v
    AND least(length(x.v), length(y.v)) >= 0.85 * greatest(length(x.v), length(y.v)) - 1e-9),
hits AS (SELECT * FROM sem WHERE score >= 0.85)"""


def _part(spark, sf):
    """Parts with a text that has more than a thousand spellings."""
    return table(spark, sf, "part").withColumn("p_full", F.concat_ws(" ", "p_name", "p_type", "p_brand"))


@register("levenshtein_theta_join", f"""
WITH {_SIMILAR} SELECT column_name, a AS value_a, b AS value_b, round(score, 6) AS score FROM hits""")
def levenshtein_theta_join(spark, sf):
    pairs = semantic.semantic_pairs(_part(spark, sf), _PART_TEXTS)
    return pairs.select("column_name", "value_a", "value_b", F.round("score", 6).alias("score"))


@register("semantic_duplicates", f"""
WITH {_SIMILAR} SELECT column_name, a AS value_a, b AS value_b, round(score, 6) AS score, n AS n_rows FROM hits""")
def semantic_duplicates(spark, sf):
    return semantic.semantic_duplicates(_part(spark, sf), _PART_TEXTS)


@register("rows_of_pair_semijoin", f"""
WITH {_SIMILAR} SELECT p_partkey, p_brand FROM part WHERE p_brand IN
(SELECT a FROM hits WHERE column_name = 'p_brand' UNION SELECT b FROM hits WHERE column_name = 'p_brand')""")
def rows_of_pair_semijoin(spark, sf):
    part = table(spark, sf, "part")
    return semantic.rows_of_pairs(part, semantic.semantic_pairs(part, ["p_brand"]), "p_brand", "p_partkey").select(
        "p_partkey", "p_brand")


@register("indel_ratio", f"""
WITH pairs AS (SELECT n_nationkey, n_name AS a, r_name AS b FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT n_nationkey, round(CAST(200.0 * {_LCS} / (length(a) + length(b)) AS DOUBLE), 6) AS ratio FROM pairs""")
def q_indel_ratio(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
        "n_nationkey", F.round(indel_ratio(F.col("n_name"), F.col("r_name")), 6).alias("ratio"))


@register("levenshtein_similarity", """
SELECT p_partkey, round(1 - levenshtein(p_name, p_type) / CAST(greatest(length(p_name), length(p_type)) AS DOUBLE), 6)
AS similarity FROM part""")
def q_levenshtein_similarity(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", F.round(levenshtein_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@register("distinct_values", "SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL")
def distinct_values(spark, sf):
    return values.distinct_values(table(spark, sf, "part"), "p_name")


_TOP_COLUMNS = ["p_name", "p_type", "p_size", "p_partkey"]


@register("value_counts_topk", f"""
WITH c AS ({each("SELECT '@' AS column_name, CAST(@ AS STRING) AS value, count(*) AS n FROM part WHERE @ IS NOT NULL GROUP BY @", _TOP_COLUMNS)})
SELECT column_name, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS INTEGER) AS rank, value, n FROM c
QUALIFY rank <= 10""")
def value_counts_topk(spark, sf):
    return values.top_values(table(spark, sf, "part"), _TOP_COLUMNS, 10)
