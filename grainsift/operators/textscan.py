"""Personal data, language, readability, encoding faults and named places in text columns."""

from __future__ import annotations

from typing import Optional, Sequence, Union

from pyspark.sql import Column, DataFrame, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import object_columns
from grainsift.functions.text import has_encoding_issue, language, reading_ease, words
from grainsift.operators.aggkit import spread, tidy_aggregate, tidy_schema_rows
from grainsift.operators.extractors import Extractor, extract_entities, listed_names
from grainsift.operators.values import sampled_columns

Columns = Union[str, Sequence[str]]
LANGUAGES = [*fixed.STOPWORDS, "other"]


def text_lengths(df: DataFrame) -> DataFrame:
    return tidy_aggregate(df, [
        {"column_name": F.lit(c), "mean_length": F.avg(F.length(c))} for c in object_columns(df)])


def text_columns(df: DataFrame, min_mean_length: float = fixed.TEXT_MIN_MEAN_LENGTH) -> DataFrame:
    """Text columns whose values are long on average."""
    return text_lengths(df).filter(F.col("mean_length") >= min_mean_length).select(
        "column_name", F.round("mean_length", 4).alias("mean_length"))


def resolve_columns(df: DataFrame, columns: Columns) -> list[str]:
    """``text`` for long text columns, ``all`` for every text column, or the names given."""
    if columns == "all":
        return object_columns(df)
    if columns == "text":
        if not object_columns(df):
            return []
        long = {r["column_name"] for r in text_columns(df).collect()}
        return [c for c in object_columns(df) if c in long]
    return list(columns)


def sample_texts(df: DataFrame, row_id: str, k: int, columns: Columns = "text") -> DataFrame:
    """A sample of ``k`` present texts of each column, to be scanned in place of the table."""
    return sampled_columns(df, row_id, resolve_columns(df, columns), k)


def pii_scan(df: DataFrame, columns: Columns = "text") -> DataFrame:
    """Rows that match each personal-data pattern, per text column, in one scan."""
    names = resolve_columns(df, columns)
    rows = [{"column_name": F.lit(c), "pii_type": F.lit(kind), "n_rows": F.count_if(F.col(c).rlike(pattern))}
            for c in names for kind, pattern in fixed.PII_PATTERNS.items()]
    if not rows:
        return tidy_schema_rows(df, [], "column_name string, pii_type string, n_rows long, detected boolean")
    return tidy_aggregate(spread(df.select(*names)), rows).withColumn("detected", F.col("n_rows") > 0)


def language_mix(df: DataFrame, columns: Columns = "text") -> DataFrame:
    """Share of texts per language; languages without a text are left out."""
    names = resolve_columns(df, columns)
    empty = "column_name string, language string, n_rows long, fraction double"
    if not names:
        return tidy_schema_rows(df, [], empty)
    labels = spread(df.select(*names)).select(*[language(F.col(c)).alias(c) for c in names])
    rows = [{"column_name": F.lit(c), "language": F.lit(lang), "n_rows": F.count_if(F.col(c) == lang),
             "total": F.count(c)} for c in names for lang in LANGUAGES]
    return (tidy_aggregate(labels, rows).filter("n_rows > 0")
            .select("column_name", "language", "n_rows", F.round(F.col("n_rows") / F.col("total"), 4).alias("fraction")))


def _mean_score(name: str) -> Column:
    """Mean of scores of two places, rounded to two places in whole hundredths: exact in any order."""
    return F.expr(f"CAST((2 * sum(CAST(round({name} * 100) AS BIGINT)) + count({name})) "
                  f"div nullif(2 * count({name}), 0) AS DOUBLE) / 100")


def readability(df: DataFrame, columns: Columns = "text") -> DataFrame:
    """Mean reading ease of the texts that have words."""
    names = resolve_columns(df, columns)
    if not names:
        return tidy_schema_rows(df, [], "column_name string, n_scored long, avg_readability double")
    scores = spread(df.select(*names)).select(*[reading_ease(F.col(c)).alias(f"r{i}") for i, c in enumerate(names)])
    return tidy_aggregate(scores, [
        {"column_name": F.lit(c), "n_scored": F.count(f"r{i}"), "avg_readability": _mean_score(f"r{i}")}
        for i, c in enumerate(names)])


def encoding_issues(df: DataFrame, columns: Columns = "text", ignore_ws: bool = False) -> DataFrame:
    names = resolve_columns(df, columns)
    if not names:
        return tidy_schema_rows(df, [], "column_name string, n_rows long")
    return tidy_aggregate(df, [
        {"column_name": F.lit(c), "n_rows": F.count_if(has_encoding_issue(F.col(c), ignore_ws))} for c in names])


def _runs(found: Column, n: int) -> Column:
    """All runs of ``n`` neighbouring words."""
    starts = F.when(F.size(found) >= n, F.sequence(F.lit(1), F.size(found) - (n - 1))).otherwise(
        F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(found, i, F.lit(n)), " "))


def _phrases(text: Column, longest: int) -> Column:
    """Distinct runs of up to ``longest`` lower-cased words."""
    found = words(F.lower(text))
    return F.array_distinct(F.concat(found, *[_runs(found, n) for n in range(2, longest + 1)]))


def entity_leakage(df: DataFrame, gazetteer: Union[DataFrame, Extractor], columns: Columns = "text") -> DataFrame:
    """Names found in texts, with the number of texts per term.

    ``gazetteer`` is a list of names (``term``, ``entity_type``) or an extractor of the caller's. A list goes to the
    tasks as one automaton; one too long for that is joined with the texts' phrases.
    """
    names = resolve_columns(df, columns)
    if not names:
        return tidy_schema_rows(df, [], "column_name string, entity_type string, term string, n_rows long")
    if not isinstance(gazetteer, DataFrame):
        return extract_entities(df, gazetteer, names)
    found = listed_names(df, gazetteer, names)
    return found if found is not None else joined_names(df, gazetteer, names)


def joined_names(df: DataFrame, gazetteer: DataFrame, names: Sequence[str]) -> DataFrame:
    """As ``entity_leakage`` by a join of the names with all phrases of the texts.

    Phrases are counted before the join, so a word found everywhere is one row per task; the join
    keeps only the names.
    """
    terms = gazetteer.select(F.lower("term").alias("phrase"), "entity_type").distinct()
    longest = terms.agg(F.max(F.size(F.split("phrase", " ")))).first()[0] or 1
    texts = df.select(*names).unpivot([], names, "column_name", "text").filter("text IS NOT NULL")
    phrases = (texts.select("column_name", F.explode(_phrases(F.col("text"), longest)).alias("phrase"))
               .groupBy("column_name", "phrase").agg(F.count("*").alias("n_rows")))
    return phrases.join(terms, "phrase").select("column_name", "entity_type", F.col("phrase").alias("term"), "n_rows")


def nlp_report(df: DataFrame, columns: Columns = "text", gazetteer: Union[DataFrame, Extractor, None] = None) -> DataFrame:
    """All text findings, one row per column: texts, texts with each kind of personal data, share of each language,
    scored texts and their mean reading ease, texts with encoding faults, names found and texts that hold each on average.
    One scan, plus one for names when a list or an extractor is given."""
    names = resolve_columns(df, columns)
    counts = ["n_texts", *[f"pii_{kind}" for kind in fixed.PII_PATTERNS]]
    shares = [f"share_{lang}" for lang in LANGUAGES]
    if not names:
        return tidy_schema_rows(df, [], ", ".join(
            ["column_name string", *[f"{c} long" for c in counts], *[f"{c} double" for c in shares], "n_scored long",
             "avg_readability double", "encoding_issues long", "entity_leakage boolean", "n_entity_types long", "n_terms long"]))
    prepared = spread(df.select(*names)).select(*[e for i, c in enumerate(names) for e in (
        F.col(c).alias(f"t{i}"), language(F.col(c)).alias(f"l{i}"), reading_ease(F.col(c)).alias(f"r{i}"))])
    rows = []
    for i, c in enumerate(names):
        text, label = F.col(f"t{i}"), F.col(f"l{i}")
        rows.append({"column_name": F.lit(c), "n_texts": F.count(text),
                     **{f"pii_{kind}": F.count_if(text.rlike(p)) for kind, p in fixed.PII_PATTERNS.items()},
                     **{f"share_{lang}": F.round(F.count_if(label == lang) / F.greatest(F.count(label), F.lit(1)), 4) for lang in LANGUAGES},
                     "n_scored": F.count(f"r{i}"), "avg_readability": _mean_score(f"r{i}"),
                     "encoding_issues": F.count_if(has_encoding_issue(text))})
    report = tidy_aggregate(prepared, rows)
    if gazetteer is None:
        return report.withColumns({"entity_leakage": F.lit(False), "n_entity_types": F.lit(0).cast("long"), "n_terms": F.lit(0).cast("long")})
    kinds = (entity_leakage(df, gazetteer, names).groupBy("column_name")
             .agg(F.countDistinct("entity_type").alias("n_entity_types"), F.countDistinct("entity_type", "term").alias("n_terms")))
    return (report.join(kinds, "column_name", "left").withColumn("entity_leakage", F.col("n_terms").isNotNull())
            .na.fill(0, ["n_entity_types", "n_terms"]))
