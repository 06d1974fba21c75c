"""Distinct and frequent values, and samples of rows and cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from grainsift.functions.columns import cell_sql, cell_text, quoted
from grainsift.operators.aggkit import cells, tidy_schema_rows, value_counts

#: values that the sketch of a column follows, and how many of them are counted exactly for each one wanted
TRACKED = 4_096
SPARE = 8
#: share of all values by which the sketch can be wrong, in parts of TRACKED (bound of the frequent-items sketch)
SKETCH_ERROR = 3.5


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Present values of a column, each once: (value)."""
    return df.select(F.col(quoted(column)).alias("value")).filter("value IS NOT NULL").distinct()


def top_values(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The ``k`` most frequent present values of every column, as text: (column_name, rank, value, n).

    Ties go to the smaller value. A sketch over one scan picks candidates, a second scan counts these exactly. A value that
    is no candidate occurs at most as often as the last candidate's estimate or the sketch's error; where the k-th count is
    not above that (a column of nearly unique values), all values of the column are counted.
    """
    schema = "column_name string, rank int, value string, n long"
    if not columns:
        return tidy_schema_rows(df, [], schema)
    wanted = max(SPARE * k, 64)
    texts = df.select(*[cell_text(df, c).alias(f"c{i}") for i, c in enumerate(columns)])
    sketch = texts.agg(*[F.expr(f"approx_top_k(c{i}, {wanted}, {max(TRACKED, wanted)})").alias(f"s{i}") for i in range(len(columns))],
                       *[F.count(f"c{i}").alias(f"n{i}") for i in range(len(columns))]).first()
    candidates = {i: [r["item"] for r in (sketch[f"s{i}"] or []) if r["item"] is not None] for i in range(len(columns))}
    named = [(columns[i], v) for i, found in candidates.items() for v in found]
    counted = (cells(df, columns).join(F.broadcast(tidy_schema_rows(df, named, "column_name string, value string")),
                                       ["column_name", "value"]).groupBy("column_name", "value").agg(F.count("*").alias("n")))
    by_count = Window.partitionBy("column_name").orderBy(F.desc("n"), "value")
    ranked = counted.withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)
    rows = ranked.select("column_name", "rank", "value", "n").collect()              # k rows per column
    kth: dict[str, list[int]] = {}
    for r in rows:
        kth.setdefault(r["column_name"], []).append(r["n"])
    unsure = []
    for i, c in enumerate(columns):
        estimates = [r["count"] for r in (sketch[f"s{i}"] or [])]
        error = SKETCH_ERROR * sketch[f"n{i}"] / max(TRACKED, wanted)
        passed_over = max(estimates[-1] if len(estimates) >= wanted else 0, error if error >= 1 else 0)
        if passed_over and (len(kth.get(c, [])) < k or min(kth[c]) <= passed_over):
            unsure.append(c)
    sure = tidy_schema_rows(df, [tuple(r) for r in rows if r["column_name"] not in unsure], schema)
    if not unsure:
        return sure
    full = value_counts(df, unsure).withColumn("rank", F.row_number().over(by_count)).filter(F.col("rank") <= k)
    return sure.unionByName(full.select("column_name", "rank", "value", "n"))


def sample_rows(df: DataFrame, row_id: str, k: int) -> DataFrame:
    """``k`` rows, those of the smallest hashes of their id: the same ones however the table is dealt out, and the sample of
    two tables is the sample of their samples."""
    return df.orderBy(F.xxhash64(row_id), row_id).limit(k)


def sample_cells(df: DataFrame, row_id: str, columns: Sequence[str], k: int) -> DataFrame:
    """``k`` present cells of every column, in one pass: (column_name, row id, value), those of the smallest hashes of the row id.

    Tasks keep k cells per column before anything is sent, and samples of parts merge by taking the smallest hashes again.
    """
    texts = df.select(F.col(quoted(row_id)).alias("_id"), *[F.expr(cell_sql(df, c)).alias(c) for c in columns])
    long = texts.unpivot(["_id"], list(columns), "column_name", "value").filter("value IS NOT NULL")
    place = Window.partitionBy("column_name").orderBy(F.xxhash64("_id"), "_id")
    return (long.withColumn("_at", F.row_number().over(place)).filter(F.col("_at") <= k)
            .select("column_name", F.col("_id").alias(row_id), "value"))


def sampled_columns(df: DataFrame, row_id: str, columns: Sequence[str], k: int) -> DataFrame:
    """A table of the text columns with a sample of ``k`` present cells each and the rest missing."""
    picked = sample_cells(df, row_id, columns, k)
    return picked.groupBy(row_id).pivot("column_name", list(columns)).agg(F.first("value")).select(*[F.col(quoted(c)) for c in columns])
