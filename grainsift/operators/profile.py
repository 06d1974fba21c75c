"""Column profiles, missing-value summaries and dataset facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainsift.functions.columns import (
    double_literal, kind_label, number_sql, numeric_columns, present_sql, text_literal)
from grainsift.operators.aggkit import distinct_counts, long_aggregate, tidy_aggregate
from grainsift.operators.quantiles import exact_quantiles


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)), F.lit(0.0))


def _kind_sql(df: DataFrame, field: T.StructField) -> str:
    return (f"CASE WHEN count({present_sql(df, field.name)}) = 0 THEN 'empty' "
            f"ELSE '{kind_label(field.dataType)}' END")


def inferred_kinds(df: DataFrame) -> DataFrame:
    """Kind of the values of each column; a column without values is ``empty``."""
    return tidy_aggregate(df, [
        {"column_name": text_literal(f.name), "dtype": text_literal(f.dataType.simpleString()),
         "inferred_type": _kind_sql(df, f)} for f in df.schema])


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Type, distinct values and missing values per column: one scan plus one exact distinct count."""
    facts = tidy_aggregate(df, [
        {"column_name": text_literal(f.name), "dtype": text_literal(f.dataType.simpleString()),
         "inferred_type": _kind_sql(df, f), "n_rows": "count(1)",
         "missing_count": f"count(1) - count({present_sql(df, f.name)})"} for f in df.schema])
    unique = distinct_counts(df, df.columns, approximate)
    return (facts.join(F.broadcast(unique), "column_name")
            .select("column_name", "dtype", "inferred_type", "unique_count",
                    _ratio(F.col("unique_count"), F.col("n_rows")).alias("unique_ratio"),
                    "missing_count",
                    _ratio(F.col("missing_count"), F.col("n_rows")).alias("missing_fraction")))


def profile_numeric(df: DataFrame) -> DataFrame:
    """Mean, sample deviation, range and bias-corrected skewness; booleans count as numbers."""
    items = [{"column_name": text_literal(f.name), "x": number_sql(df, f.name)} for f in df.schema
             if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    n = "CAST(count(x) AS DOUBLE)"
    return long_aggregate(df, items, ["column_name"], {
        "mean": "avg(x)", "std": f"CASE WHEN {n} > 1 THEN stddev_samp(x) END", "min": "min(x)", "max": "max(x)",
        "skew": f"CASE WHEN {n} >= 3 THEN CASE WHEN stddev_pop(x) = 0 THEN 0.0D ELSE "
                f"skewness(x) * sqrt({n} * ({n} - 1)) / nullif({n} - 2, 0.0D) END END"})


def describe_numeric(df: DataFrame) -> DataFrame:
    """Count, mean, deviation and five-number summary per number column, to four places."""
    names = numeric_columns(df)
    quartiles = exact_quantiles(df, {c: (number_sql(df, c), [0.25, 0.5, 0.75]) for c in names})
    items = [{"column_name": text_literal(c), "x": number_sql(df, c),
              **{f"q{i}": double_literal(v) for i, v in enumerate(quartiles[c])}} for c in names]
    return long_aggregate(df, items, ["column_name"], {
        "n": "count(x)", "mean": "round(avg(x), 4)",
        "std": "round(CASE WHEN count(x) > 1 THEN stddev_samp(x) END, 4)", "min": "round(min(x), 4)",
        "p25": "round(max(q0), 4)", "p50": "round(max(q1), 4)", "p75": "round(max(q2), 4)",
        "max": "round(max(x), 4)"})


def missing_by_column(df: DataFrame) -> DataFrame:
    return tidy_aggregate(df, [
        {"column_name": text_literal(c), "n_rows": "count(1)",
         "missing_count": f"count(1) - count({present_sql(df, c)})"} for c in df.columns
    ]).withColumn("missing_fraction", F.round(_ratio(F.col("missing_count"), F.col("n_rows")), 4))


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing cells of the whole table, their share and the columns that have any."""
    by_column = missing_by_column(df)
    names = F.array_join(F.array_sort(F.collect_list(
        F.when(F.col("missing_count") > 0, F.col("column_name")))), ",")
    return by_column.agg(
        F.sum("missing_count").alias("total_missing"),
        F.round(_ratio(F.sum("missing_count"), F.sum("n_rows")), 4).alias("missing_fraction"),
        names.alias("missing_columns"))


def dataset_info(df: DataFrame) -> DataFrame:
    """Rows, columns, types and missing share, one row per column."""
    types = df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString()) for f in df.schema], "column_name string, dtype string")
    return (missing_by_column(df).join(F.broadcast(types), "column_name")
            .select("column_name", "dtype", "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"),
                    "missing_fraction"))
