"""Filling missing values."""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from grainsift.config import IMPUTATION_STRATEGIES
from grainsift.functions.columns import as_number, number_sql, present
from grainsift.operators.aggkit import tidy_schema_rows
from grainsift.operators.ordering import bucket_of, order_bounds
from grainsift.operators.quantiles import exact_quantiles

REPORT_SCHEMA = "column_name string, strategy_used string, cells_filled long, fill_value string"


def is_number(df: DataFrame, column: str) -> bool:
    """Whether a mean says something; a boolean with gaps takes its most frequent value."""
    return isinstance(df.schema[column].dataType, T.NumericType)


def mode_value(df: DataFrame, column: str):
    """Most frequent present value; the smallest one on ties."""
    value = present(df, column)
    counts = df.select(value.alias("v")).filter("v IS NOT NULL").groupBy("v").agg(F.count("*").alias("n"))
    return counts.agg(F.min_by("v", F.struct(-F.col("n"), F.col("v")))).first()[0]


def fill_directional(df: DataFrame, columns: Sequence[str], order_by: Sequence[str],
                     partition_by: Sequence[str] = (), forward: bool = True,
                     rows_per_bucket: Optional[int] = None) -> DataFrame:
    """Carry the last (or next) present value over gaps along an order.

    Rows are worked on in bounded stretches of the order; a stretch that starts with a gap takes
    over what the stretches before it (of the same partition) ended with. A partition that holds
    most of the rows is therefore split over many tasks.
    """
    if not order_by:
        raise ValueError("filling along an order needs order_by columns")
    bounds = order_bounds(df, order_by, rows_per_bucket)
    keys = [*partition_by, "_stretch"]
    data = df.withColumn("_stretch", bucket_of(df, order_by, bounds))
    pick = F.last if forward else F.first
    span = ((Window.unboundedPreceding, 0) if forward else (0, Window.unboundedFollowing))
    inner = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(*span)
    filled = data.withColumns({c: pick(present(df, c), ignorenulls=True).over(inner) for c in columns})
    if not bounds:
        return filled.drop("_stretch").select(*df.columns)

    place = F.struct(*order_by)
    edge = F.max_by if forward else F.min_by
    ends = data.groupBy(*keys).agg(*[
        edge(present(df, c), F.when(present(df, c).isNotNull(), place)).alias(c) for c in columns])
    outer = Window.partitionBy(*partition_by).orderBy("_stretch").rowsBetween(
        *((Window.unboundedPreceding, -1) if forward else (1, Window.unboundedFollowing)))
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
                          *[pick(c, ignorenulls=True).over(outer).alias(f"_c{i}") for i, c in enumerate(columns)])
    same = [filled[k].eqNullSafe(carried[f"_k{i}"]) for i, k in enumerate(keys)]
    joined = filled.join(carried, same, "left")
    position = {c: i for i, c in enumerate(columns)}
    return joined.select(*[F.coalesce(filled[c], carried[f"_c{position[c]}"]).alias(c) if c in position
                           else filled[c] for c in df.columns])


def fill_values(df: DataFrame, strategies: Mapping[str, str]) -> dict[str, object]:
    """Values that replace missing cells for mean, median and mode columns."""
    means = [c for c, s in strategies.items() if s == "mean" and is_number(df, c)]
    medians = [c for c, s in strategies.items() if s == "median" and is_number(df, c)]
    values: dict[str, object] = {}
    if means:
        row = df.agg(*[F.avg(as_number(df, c)).alias(c) for c in means]).first()
        values.update({c: row[c] for c in means})
    if medians:
        found = exact_quantiles(df, {c: (number_sql(df, c), [0.5]) for c in medians})
        values.update({c: found[c][0] for c in medians})
    for c in strategies:
        if c not in values and strategies[c] in ("mean", "median", "mode"):
            value = mode_value(df, c)
            if value is None and isinstance(df.schema[c].dataType, T.StringType):
                value = "Unknown"
            elif value is None and is_number(df, c):
                value = 0
            values[c] = value       # None: no value of the column's type stands for a missing one
    return values


def _filled(df: DataFrame, column: str, strategy: str, value: object) -> Column:
    """Mean and median make a number column double; everything else keeps its type."""
    cell = present(df, column)
    if strategy in ("mean", "median") and is_number(df, column):
        return F.coalesce(as_number(df, column), F.lit(value))
    return F.coalesce(cell, F.lit(value).cast(df.schema[column].dataType))


def impute(df: DataFrame, strategy: str = "median", column_strategies: Optional[Mapping[str, str]] = None,
           order_by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Fill (or drop) missing cells column by column. Returns (table, report).

    Columns are handled in table order; statistics of a column see the rows that earlier ``drop``
    columns left. Columns between two drops share their scans.
    """
    chosen = {c: (column_strategies or {}).get(c, strategy) for c in df.columns}
    unknown = sorted({s for s in chosen.values() if s not in IMPUTATION_STRATEGIES})
    if unknown:
        raise ValueError(f"unknown imputation strategy: {', '.join(unknown)}")
    start = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in df.columns]).first().asDict()
    pending = [c for c in df.columns if start[c] > 0]
    if any(chosen[c] in ("forward_fill", "backward_fill") for c in pending) and not order_by:
        raise ValueError("forward_fill and backward_fill need order_by columns")

    report = []
    while pending:
        group = []
        while pending and chosen[pending[0]] != "drop":
            group.append(pending.pop(0))
        if group:
            missing = df.agg(*[F.count_if(present(df, c).isNull()).alias(c) for c in group]).first()
            df, rows = _fill_group(df, {c: chosen[c] for c in group}, missing.asDict(), order_by)
            report += rows
        if pending:
            c = pending.pop(0)
            report.append((c, "drop", df.agg(F.count_if(present(df, c).isNull())).first()[0], None))
            df = df.filter(present(df, c).isNotNull())
    return df, tidy_schema_rows(df, report, REPORT_SCHEMA)


def _fill_group(df: DataFrame, strategies: Mapping[str, str], missing: Mapping[str, int],
                order_by: Sequence[str]) -> tuple[DataFrame, list[tuple]]:
    values = fill_values(df, {c: s for c, s in strategies.items() if s in ("mean", "median", "mode")})
    report = []
    for c, s in strategies.items():
        if s in ("forward_fill", "backward_fill"):
            report.append((c, s, missing[c], "propagated"))
            continue
        number = is_number(df, c)
        used = s if s == "mode" or number else "mode (fallback)"
        value = values[c]
        if value is None and not number:
            report.append((c, "failed", 0, None))
            continue
        shown = round(value, 4) if s in ("mean", "median") and number and value is not None else value
        report.append((c, used, missing[c], None if shown is None else str(shown)))
    out = df.withColumns({c: _filled(df, c, strategies[c], v) for c, v in values.items()
                          if v is not None or is_number(df, c)}) if values else df
    for forward, name in ((True, "forward_fill"), (False, "backward_fill")):
        along = [c for c, s in strategies.items() if s == name]
        if along:
            out = fill_directional(out, along, order_by, forward=forward)
    return out, report
