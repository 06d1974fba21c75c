"""Aggregates over many columns in one scan, returned as tidy rows."""

from __future__ import annotations

from typing import Mapping, Sequence, Union

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainsift.functions.columns import cell_sql, cell_text, quoted, short_sql, text_literal

SKETCH_SIZE = 12


def distinct_sketch(cell: str) -> str:
    """Estimated distinct values as SQL, within about two percent; the sketch is one small buffer."""
    return f"hll_sketch_estimate(hll_sketch_agg({cell}, {SKETCH_SIZE}))"


def tidy_aggregate(df: DataFrame, rows: Sequence[Mapping[str, Union[str, Column]]]) -> DataFrame:
    """One aggregation over ``df``; each mapping becomes one output row.

    All rows carry the same names and types. The table is read once however many rows are asked.
    Values are columns, or SQL texts throughout, which is quicker to plan for wide tables.
    """
    if all(isinstance(v, str) for row in rows for v in row.values()):
        structs = ", ".join("named_struct(" + ", ".join(f"'{n}', {v}" for n, v in row.items()) + ")" for row in rows)
        array = F.expr(f"array({structs})")
    else:
        array = F.array(*[F.struct(*[c.alias(name) for name, c in row.items()]) for row in rows])
    return df.agg(array.alias("rows")).select(F.inline("rows"))


def long_aggregate(df: DataFrame, items: Sequence[Mapping[str, str]], keys: Sequence[str],
                   aggregates: Mapping[str, str], derived: Mapping[str, str] | None = None) -> DataFrame:
    """The same aggregates for many items of a row, grouped by the item.

    Each item is a mapping of field to SQL over ``df``, of which ``keys`` are constants that name it;
    ``aggregates`` speak of the other fields, and of ``derived`` ones, which are computed once per cell from the others.
    Rows are unfolded inside the scan stage and folded to
    one row per item before the shuffle, and the generated code stays as small as for one item
    however many columns the table has.
    """
    structs = ", ".join(
        "named_struct(" + ", ".join([f"'item', {i}"] + [f"'{n}', {v}" for n, v in item.items() if n not in keys]) + ")"
        for i, item in enumerate(items))
    cells = spread(df).selectExpr(f"inline(array({structs}))")
    if derived:
        cells = cells.selectExpr("*", *[f"{e} AS {n}" for n, e in derived.items()])
    grouped = (cells.groupBy("item")
               .agg(*[F.expr(f"{e} AS {n}") for n, e in aggregates.items()]))
    names = [f"array({', '.join(item[k] for item in items)})[item] AS {k}" for k in keys]
    return grouped.selectExpr(*names, *aggregates)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input over all cores before work that is heavy per row.

    An input with enough files or enough splits, as every large one has, is left as it is.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= wanted or df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)


def work_parts(spark: SparkSession) -> int:
    """Number of parts for a shuffle in front of work that few bytes say nothing about."""
    return max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Non-missing cells as (column_name, value) rows."""
    texts = df.select(*[cell_text(df, c).alias(c) for c in columns])
    return texts.unpivot([], list(columns), "column_name", "value").filter(F.col("value").isNotNull())


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per column and value. Copies are counted before the shuffle, so frequent values are cheap."""
    return cells(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("n"))


def distinct_counts(df: DataFrame, columns: Sequence[str], approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column as (column_name, unique_count)."""
    if approximate:
        return tidy_aggregate(df, [
            {"column_name": text_literal(c), "unique_count": distinct_sketch(cell_sql(df, c))}
            for c in columns])
    short = df.selectExpr(*[f"{short_sql(cell_sql(df, c))} AS {quoted(c)}" for c in columns])
    counted = (cells(short, columns).distinct().groupBy("column_name").agg(F.count("*").alias("unique_count")))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column_name string")
    return (names.join(F.broadcast(counted), "column_name", "left")
            .select("column_name", F.coalesce("unique_count", F.lit(0).cast("long")).alias("unique_count")))


def few_valued(df: DataFrame, columns: Sequence[str], below: int) -> dict[str, int]:
    """Columns with fewer than ``below`` distinct values, with the exact number.

    A sketch over one scan sorts out the columns that are far above the bound; only the others
    are counted exactly, and their few values collapse before the shuffle.
    """
    if not columns:
        return {}
    sketch = df.agg(*[F.expr(f"{distinct_sketch(cell_sql(df, c))} AS c{i}")
                      for i, c in enumerate(columns)]).first()
    near = [c for i, c in enumerate(columns) if sketch[i] < 2 * below + 100]
    if not near:
        return {}
    exact = distinct_counts(df, near).collect()
    return {r["column_name"]: r["unique_count"] for r in exact if r["unique_count"] < below}


def tidy_schema_rows(df: DataFrame, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Small frame of facts already known to the driver (one row per column or metric)."""
    return df.sparkSession.createDataFrame(list(rows), schema)


def settle(report: DataFrame) -> DataFrame:
    """Run a report once and keep its rows (one per column or metric) for later use."""
    return report.sparkSession.createDataFrame(report.collect(), report.schema)
