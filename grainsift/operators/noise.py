"""Missing values, placeholders, mixed formats and columns without information."""

from __future__ import annotations

from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import (
    cell_sql, cell_text, object_columns, present_sql, quoted, strip, text_literal)
from grainsift.operators.aggkit import (
    cells, distinct_counts, distinct_sketch, few_valued, tidy_aggregate, tidy_schema_rows)
from grainsift.operators.outliers import outlier_details
from grainsift.operators.stringpairs import indel_pairs

_STARTS_OR_ENDS_BLANK = r"(?U)\A\s|\s\z"


def is_sentinel(text: Column) -> Column:
    return F.lower(text).isin(fixed.SENTINELS)


def has_outer_blank(text: Column) -> Column:
    return text.rlike(_STARTS_OR_ENDS_BLANK)


def column_facts(df: DataFrame) -> DataFrame:
    """What one scan tells about every column, one row per column.

    Rows, present cells, whether all present cells are equal, plain numbers in text columns and a
    sketch of the distinct values of text columns.
    """
    text = set(object_columns(df))
    rows = []
    for c in df.columns:
        cell = cell_sql(df, c)
        rows.append({
            "column_name": text_literal(c), "n_rows": "count(1)", "present_count": f"count({present_sql(df, c)})",
            "constant": f"min({cell}) <=> max({cell})",
            "plain_numbers": (f"count_if({quoted(c)} RLIKE {text_literal(fixed.PLAIN_NUMBER_PATTERN)})"
                              if c in text else "CAST(NULL AS BIGINT)"),
            "distinct_sketch": distinct_sketch(quoted(c)) if c in text else "CAST(NULL AS BIGINT)"})
    return tidy_aggregate(df, rows)


def empty_rows(df: DataFrame, row_id: str, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Rows in which every column is missing."""
    columns = columns or [c for c in df.columns if c != row_id]
    return df.filter(" AND ".join(f"({present_sql(df, c)}) IS NULL" for c in columns)).select(row_id)


def sentinel_rows(df: DataFrame, column: str, row_id: str) -> DataFrame:
    return df.filter(is_sentinel(F.col(column))).select(row_id, F.col(column).alias("value"))


def whitespace_rows(df: DataFrame, column: str, row_id: str) -> DataFrame:
    return df.filter(has_outer_blank(F.col(column))).select(row_id, F.col(column).alias("value"))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with at most one distinct value; the smallest equals the largest."""
    return (tidy_aggregate(df, [
        {"column_name": text_literal(c), "constant": f"min({cell_sql(df, c)}) <=> max({cell_sql(df, c)})"}
        for c in df.columns]).filter("constant").select("column_name"))


def low_variance_columns(df: DataFrame, threshold: float = fixed.LOW_VARIANCE_THRESHOLD) -> DataFrame:
    """Non-constant columns whose most frequent value exceeds the threshold share.

    A value with more than half of the rows is the median in any order of the values, so one
    scan finds the only possible value per column and a second one counts it. Nothing is shuffled.
    """
    if threshold < 0.75:
        raise ValueError("the threshold must be at least 0.75")
    columns = df.columns
    texts = df.select(*[cell_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)])
    keyed = {i: F.shiftright(F.xxhash64(f"t{i}"), 12) for i in range(len(columns))}
    middle = texts.agg(*[F.percentile_approx(F.when(F.col(f"t{i}").isNotNull(), keyed[i]), 0.5).alias(f"m{i}")
                         for i in keyed]).first()
    candidates = texts.agg(*[F.min(F.when(keyed[i] == F.lit(middle[i]), F.col(f"t{i}"))).alias(f"v{i}")
                             for i in keyed]).first()
    rows = [{"column_name": F.lit(c),
             "n": F.count(f"t{i}"),
             "top": F.count_if(F.col(f"t{i}") == F.lit(candidates[i]))} for i, c in enumerate(columns)]
    return (tidy_aggregate(texts, rows)
            .filter((F.col("top") < F.col("n")) & (F.col("top") > threshold * F.col("n")))
            .select("column_name", F.round(F.col("top") / F.col("n"), 4).alias("top_fraction")))


def high_cardinality_columns(df: DataFrame) -> DataFrame:
    """Text columns whose distinct values exceed half of the rows (and twenty).

    A sketch settles columns far from the bound; only the others are counted exactly.
    """
    names = object_columns(df)
    if not names:
        return tidy_schema_rows(df, [], "column_name string")
    row = df.agg(F.count(F.lit(1)).alias("n"),
                 *[F.expr(f"{distinct_sketch(quoted(c))} AS d{i}") for i, c in enumerate(names)]).first()
    return _high_cardinality(df, row["n"], {c: row[f"d{i}"] for i, c in enumerate(names)})


def _high_cardinality(df: DataFrame, n_rows: int, sketches: dict[str, int]) -> DataFrame:
    n = max(n_rows, 1)
    chosen = [c for c, d in sketches.items() if d / n > 0.6 and d > 100]
    unsure = [c for c, d in sketches.items() if c not in chosen and d / n > 0.4]
    if unsure:
        chosen += [r["column_name"] for r in distinct_counts(df, unsure).collect()
                   if r["unique_count"] > fixed.HIGH_CARDINALITY_RATIO * n
                   and r["unique_count"] > fixed.HIGH_CARDINALITY_MIN]
    return tidy_schema_rows(df, [(c,) for c in chosen], "column_name string")


def formatting_errors(df: DataFrame, sample_rows: Optional[int] = None,
                      order_by: Optional[Sequence[str]] = None) -> DataFrame:
    """Text columns that hold numbers only in part, with the number of other values.

    The whole column counts; ``sample_rows`` looks at the first values in ``order_by`` instead.
    """
    names = object_columns(df)
    if sample_rows is not None:
        frames = []
        for c in names:
            head = df.filter(F.col(c).isNotNull()).orderBy(*(order_by or [c])).limit(sample_rows)
            frames.append(_formatting(head, [c]))
        return reduce(DataFrame.unionByName, frames)
    return _formatting(df, names)


def _formatting(df: DataFrame, names: Sequence[str]) -> DataFrame:
    if not names:
        return tidy_schema_rows(df, [], "column_name string, error_count long")
    return (tidy_aggregate(df, [
        {"column_name": text_literal(c), "n": f"count({quoted(c)})",
         "plain": f"count_if({quoted(c)} RLIKE {text_literal(fixed.PLAIN_NUMBER_PATTERN)})"} for c in names])
        .filter("plain > 0 AND plain < n")
        .selectExpr("column_name", "n - plain AS error_count"))


def datatype_noise(df: DataFrame) -> DataFrame:
    """Text columns that hold numbers, in part or throughout."""
    names = object_columns(df)
    if not names:
        return tidy_schema_rows(df, [], "column_name string, mismatch_count long, issue string")
    counted = tidy_aggregate(df, [
        {"column_name": text_literal(c), "n": f"count({quoted(c)})",
         "mismatch_count": f"count_if({quoted(c)} RLIKE {text_literal(fixed.NUMERIC_LIKE_PATTERN)})"} for c in names])
    return counted.filter("mismatch_count > 0").selectExpr(
        "column_name", "mismatch_count", "CASE WHEN mismatch_count < n THEN 'Mixed numeric and string types' "
                                         "ELSE 'Numeric values stored as strings' END AS issue")


def fuzzy_pairs(df: DataFrame, max_distinct: Optional[int] = None) -> DataFrame:
    """Pairs of similar spellings in text columns; ``max_distinct`` leaves out columns with as many spellings."""
    names = object_columns(df)
    cleaned = df.select(*[F.lower(strip(F.col(c))).alias(c) for c in names])
    few = names if max_distinct is None else list(few_valued(cleaned, names, max_distinct))
    if not few:
        return tidy_schema_rows(df, [], "column_name string, value_a string, value_b string, score double")
    return indel_pairs(cells(cleaned, few).distinct())


def fuzzy_categories(df: DataFrame) -> DataFrame:
    """Each spelling with each similar spelling of the same column: (column_name, value, match)."""
    ways = F.array(*[F.struct(F.col(a).alias("value"), F.col(b).alias("match"))
                     for a, b in (("value_a", "value_b"), ("value_b", "value_a"))])
    return fuzzy_pairs(df).select("column_name", F.inline(ways))


def value_noise(df: DataFrame) -> DataFrame:
    """Placeholders, outer white space and similar spellings per text column."""
    words = ", ".join(text_literal(w) for w in fixed.SENTINELS)
    counted = tidy_aggregate(df, [
        {"column_name": text_literal(c), "sentinel_count": f"count_if(lower({quoted(c)}) IN ({words}))",
         "whitespace_count": f"count_if({quoted(c)} RLIKE {text_literal(_STARTS_OR_ENDS_BLANK)})"}
        for c in object_columns(df)])
    groups = fuzzy_categories(df).groupBy("column_name").agg(F.countDistinct("value").alias("fuzzy_values"))
    joined = counted.join(groups, "column_name", "left").withColumn(
        "fuzzy_values", F.coalesce("fuzzy_values", F.lit(0).cast("long")))
    return joined.select(
        "column_name", "sentinel_count", "whitespace_count", "fuzzy_values",
        (F.col("sentinel_count") + F.col("whitespace_count")).alias("noisy_count"),
        ((F.col("sentinel_count") > 0) | (F.col("whitespace_count") > 0)
         | (F.col("fuzzy_values") > 0)).alias("affected"))


def structural_noise(df: DataFrame, row_id: str) -> DataFrame:
    """Empty rows, constant columns and columns with hardly any variation."""
    data = df.drop(row_id)

    def labelled(frame: DataFrame, kind: str, item: str) -> DataFrame:
        return frame.select(F.lit(kind).alias("kind"), F.col(item).cast("string").alias("item"))

    return (labelled(empty_rows(df, row_id), "empty_row", row_id)
            .union(labelled(constant_columns(data), "constant_column", "column_name"))
            .union(labelled(low_variance_columns(data), "low_variance_column", "column_name")))


FINDING_SCHEMA = "finding string, column_name string, value double"


def noise_findings(df: DataFrame, facts: Sequence[Row], details: Sequence[Row]) -> list[tuple[str, str, float]]:
    """Findings from the facts and the outlier details of the columns (one row each)."""
    n_rows = facts[0]["n_rows"] if facts else 0
    many = _high_cardinality(df, n_rows, {r["column_name"]: r["distinct_sketch"] for r in facts
                                          if r["distinct_sketch"] is not None}).collect()
    out = [("missing_cells", r["column_name"], r["n_rows"] - r["present_count"]) for r in facts
           if r["present_count"] < r["n_rows"]]
    out += [("outliers", r["column_name"], r["outlier_count"]) for r in details]
    out += [("outlier_fraction", r["column_name"], r["outlier_fraction"]) for r in details]
    out += [("formatting_errors", r["column_name"], r["present_count"] - r["plain_numbers"]) for r in facts
            if 0 < (r["plain_numbers"] or 0) < r["present_count"]]
    out += [("constant_column", r["column_name"], 1) for r in facts if r["constant"]]
    out += [("high_cardinality_column", r["column_name"], 1) for r in many]
    return [(kind, column, float(value)) for kind, column, value in out]


def noise_report(df: DataFrame, outlier_method: str = "iqr") -> DataFrame:
    """All noise findings as (finding, column_name, value) rows.

    One scan for the facts of all columns, then the outliers of the number columns.
    """
    facts = column_facts(df).collect()
    sizes = {r["column_name"]: r["present_count"] for r in facts}
    details = outlier_details(df, outlier_method, sizes=sizes).collect()
    return tidy_schema_rows(df, noise_findings(df, facts, details), FINDING_SCHEMA)


def noise_breakdown(df: DataFrame, outlier_method: str = "iqr") -> DataFrame:
    """Size of each kind of noise; a table without any is ``Clean``."""
    labels = {"outliers": "Outliers", "formatting_errors": "Formatting errors",
              "missing_cells": "Missing cells", "constant_column": "Constant columns"}
    label = F.lit(None).cast("string")
    for finding, name in labels.items():
        label = F.when(F.col("finding") == finding, F.lit(name)).otherwise(label)
    # a few rows per column at most
    slices = (noise_report(df, outlier_method).withColumn("slice", label).filter("slice IS NOT NULL AND value > 0")
              .groupBy("slice").agg(F.sum("value").cast("long").alias("n")))
    clean = slices.agg(F.count("*").alias("k")).filter("k = 0").select(
        F.lit("Clean").alias("slice"), F.lit(1).cast("long").alias("n"))
    return slices.union(clean)
