"""Values of a text column that are spelled almost alike, and the rows that hold them."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, functions as F

from grainsift.functions.columns import string_columns
from grainsift.operators.aggkit import cells, few_valued, tidy_schema_rows
from grainsift.operators.stringpairs import levenshtein_pairs


def semantic_pairs(df: DataFrame, columns: Sequence[str], max_distinct: Optional[int] = None) -> DataFrame:
    """Pairs of similar values of the chosen text columns; ``max_distinct`` leaves out columns with as many values."""
    few = [c for c in columns if c in string_columns(df)]
    if max_distinct is not None:
        few = list(few_valued(df, few, max_distinct))
    if not few:
        return tidy_schema_rows(df, [], "column_name string, value_a string, value_b string, score double")
    return levenshtein_pairs(cells(df, few).distinct())


def semantic_duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Similar value pairs with the number of rows that hold either value."""
    pairs = semantic_pairs(df, columns)
    counts = cells(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    a = counts.select("column_name", F.col("value").alias("value_a"), F.col("n").alias("n_a"))
    b = counts.select("column_name", F.col("value").alias("value_b"), F.col("n").alias("n_b"))
    return (pairs.join(a, ["column_name", "value_a"]).join(b, ["column_name", "value_b"])
            .select("column_name", "value_a", "value_b", F.round("score", 6).alias("score"),
                    (F.col("n_a") + F.col("n_b")).alias("n_rows")))


def rows_of_pairs(df: DataFrame, pairs: DataFrame, column: str, row_id: str) -> DataFrame:
    """Rows whose value takes part in a pair (a semi join, one row out per row in)."""
    mine = pairs.filter(F.col("column_name") == column)
    values = mine.select(F.col("value_a").alias(column)).union(mine.select("value_b")).distinct()
    return df.join(values, column, "left_semi").select(row_id, column)
