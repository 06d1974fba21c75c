"""Text findings on documents, pages and conversations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.text import syllable_count, word_count
from grainsift.operators import textscan
from grainsift.registry import register
from grainsift.registry.views import PEOPLE_CTE, PEOPLE_TEXTS, each, people, table

_SOURCES = [("documents", "text"), ("pages", "html"), ("conversations", "text")]


def _each_source(spark, sf, operator) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        operator(table(spark, sf, t), [c]).withColumn("source_table", F.lit(t)) for t, c in _SOURCES])


def _sources(template: str) -> str:
    return " UNION ALL ".join(template.replace("#", t).replace("@", c) for t, c in _SOURCES)


@register("text_columns", f"WITH {PEOPLE_CTE}, l AS (" + each(
    "SELECT '@' AS column_name, avg(length(@)) AS m FROM people", PEOPLE_TEXTS)
    + ") SELECT column_name, round(m, 4) AS mean_length FROM l WHERE m >= 20")
def text_columns(spark, sf):
    return textscan.text_columns(people(spark, sf))


_PII = " UNION ALL ".join(
    f"SELECT '{t}' AS source_table, '{c}' AS column_name, '{kind}' AS pii_type, "
    f"count(*) FILTER (WHERE regexp_matches({c}, '{pattern}')) AS n_rows FROM {t}"
    for t, c in _SOURCES for kind, pattern in fixed.PII_PATTERNS.items())


@register("pii_scan", f"WITH p AS ({_PII}) SELECT *, n_rows > 0 AS detected FROM p")
def pii_scan(spark, sf):
    return _each_source(spark, sf, textscan.pii_scan)


_WORDS = r"regexp_extract_all(lower(@), '[\p{L}\p{N}_]+')"
_STOPS = {lang: "[" + ", ".join(f"'{w}'" for w in ws) + "]" for lang, ws in fixed.STOPWORDS.items()}
_LANGUAGE = f"""SELECT '#' AS source_table, '@' AS column_name, CASE WHEN greatest(en, es, fr) = 0 THEN 'other'
WHEN en = greatest(en, es, fr) THEN 'en' WHEN es = greatest(en, es, fr) THEN 'es' ELSE 'fr' END AS language FROM
(SELECT {', '.join(f"len(list_intersect(list_distinct({_WORDS}), {stops})) AS {lang}" for lang, stops in _STOPS.items())} FROM #)"""


@register("language_mix", f"""
WITH l AS ({_sources(_LANGUAGE)}) SELECT source_table, column_name, language, count(*) AS n_rows,
round(count(*) / CAST(sum(count(*)) OVER (PARTITION BY source_table) AS DOUBLE), 4) AS fraction
FROM l GROUP BY source_table, column_name, language""")
def language_mix(spark, sf):
    return _each_source(spark, sf, textscan.language_mix)


_SYLLABLES = (f"coalesce(list_sum(list_transform({_WORDS}, lambda w: greatest(1, "
              "len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND "
              "len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END))), 0)")
_SENTENCES = r"len(list_filter(string_split_regex(@, '[.!?]+'), lambda s: regexp_matches(s, '\S')))"
_EASE = f"""SELECT '#' AS source_table, '@' AS column_name, CASE WHEN w > 0 AND s > 0 THEN
round(greatest(0::DOUBLE, least(100::DOUBLE, 206.835::DOUBLE - 1.015::DOUBLE * w / CAST(s AS DOUBLE) - 84.6::DOUBLE * y / CAST(w AS DOUBLE))), 2) END AS ease
FROM (SELECT len({_WORDS}) AS w, {_SENTENCES} AS s, {_SYLLABLES} AS y FROM #)"""


# the mean in whole hundredths, half up, so that the order of summing cannot change it
_MEAN = ("CAST((2 * CAST(sum(CAST(round(ease * 100) AS BIGINT)) AS BIGINT) + count(ease)) // nullif(2 * count(ease), 0) "
         "AS DOUBLE) / 100")


@register("readability", f"""
WITH e AS ({_sources(_EASE)}) SELECT source_table, column_name, count(ease) AS n_scored, {_MEAN} AS avg_readability
FROM e GROUP BY source_table, column_name""")
def readability(spark, sf):
    return _each_source(spark, sf, textscan.readability)


@register("syllables", f"""
SELECT doc_id, CAST(len({_WORDS.replace('@', 'text')}) AS BIGINT) AS n_words,
CAST({_SYLLABLES.replace('@', 'text')} AS BIGINT) AS n_syllables FROM documents""")
def syllables(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", word_count(F.col("text")).cast("long").alias("n_words"),
        syllable_count(F.col("text")).cast("long").alias("n_syllables"))


_ENCODING = r"SELECT '#' AS source_table, '@' AS column_name, count(*) FILTER (WHERE regexp_matches(@, '[%s\x7F-\x{9F}\x{FFFD}]')) AS n_rows FROM #"


@register("encoding_issues", _sources(_ENCODING % r"\x00-\x1F"))
def encoding_issues(spark, sf):
    return _each_source(spark, sf, textscan.encoding_issues)


@register("encoding_issues_no_ws", _sources(_ENCODING % r"\x00-\x08\x0B\x0C\x0E-\x1F"))
def encoding_issues_no_ws(spark, sf):
    return _each_source(spark, sf, lambda df, c: textscan.encoding_issues(df, c, ignore_ws=True))


_LETTERS = """letters AS (SELECT c_custkey, concat('Letter from ', n_name, ' (', r_name, ') about ', c_mktsegment, ' goods')
AS letter FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_ENTITIES = r"""names AS (SELECT lower(n_name) AS term, 'GPE' AS entity_type FROM nation
UNION ALL SELECT lower(r_name), 'LOC' FROM region),
spaced AS (SELECT concat(' ', regexp_replace(lower(letter), '[^\p{L}\p{N}_]+', ' ', 'g'), ' ') AS words FROM letters),
found AS (SELECT 'letter' AS column_name, entity_type, term, count(*) AS n_rows FROM spaced JOIN names
ON contains(words, concat(' ', term, ' ')) GROUP BY entity_type, term)"""


def letters(spark, sf) -> DataFrame:
    customer, nation, region = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("c_custkey", F.concat(F.lit("Letter from "), "n_name", F.lit(" ("), "r_name", F.lit(") about "),
                                          "c_mktsegment", F.lit(" goods")).alias("letter")))


def place_names(spark, sf) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.col("n_name").alias("term"), F.lit("GPE").alias("entity_type"))
    return nations.union(table(spark, sf, "region").select("r_name", F.lit("LOC")))


@register("entity_leakage", f"WITH {_LETTERS}, {_ENTITIES} SELECT * FROM found")
def entity_leakage(spark, sf):
    return textscan.entity_leakage(letters(spark, sf), place_names(spark, sf))


@register("entity_extractor", f"WITH {_LETTERS}, {_ENTITIES} SELECT * FROM found")
def entity_extractor(spark, sf):
    """Place names by an extractor of the caller's, here one regular expression."""
    names = {r["term"].lower(): r["entity_type"] for r in place_names(spark, sf).collect()}
    pattern = re.compile(r"(?<!\w)(" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)")
    return textscan.entity_leakage(letters(spark, sf), lambda texts: ([(names[t], t) for t in pattern.findall(x.lower())] for x in texts))


_LANGUAGES = ["en", "es", "fr", "other"]
_DOC_ENTITIES = _ENTITIES.replace("letter", "text").replace("FROM texts", "FROM documents")


@register("nlp_report", f"""
WITH {_DOC_ENTITIES}, lang AS ({_LANGUAGE.replace('#', 'documents').replace('@', 'text')}),
ease AS ({_EASE.replace('#', 'documents').replace('@', 'text')})
SELECT 'text' AS column_name, count(text) AS n_texts,
{", ".join(f"count(*) FILTER (WHERE regexp_matches(text, '{p}')) AS pii_{k}" for k, p in fixed.PII_PATTERNS.items())},
{", ".join(f"(SELECT round(count(*) FILTER (WHERE language = '{x}') / CAST(count(*) AS DOUBLE), 4) FROM lang) AS share_{x}" for x in _LANGUAGES)},
(SELECT count(ease) FROM ease) AS n_scored, (SELECT {_MEAN} FROM ease) AS avg_readability,
count(*) FILTER (WHERE regexp_matches(text, '[\\x00-\\x1F\\x7F-\\x{{9F}}\\x{{FFFD}}]')) AS encoding_issues,
(SELECT count(*) > 0 FROM found) AS entity_leakage, (SELECT count(DISTINCT entity_type) FROM found) AS n_entity_types,
(SELECT count(*) FROM found) AS n_terms FROM documents""")
def nlp_report(spark, sf):
    return textscan.nlp_report(table(spark, sf, "documents"), ["text"], place_names(spark, sf))
