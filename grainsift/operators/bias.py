"""Dominant groups, fairness rates and proxy correlations of sensitive columns."""

from __future__ import annotations

import re
from functools import reduce
from typing import Iterator, Optional, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import (
    cell_sql, cell_text, double_literal, is_categorical, number_sql, numeric_columns, quoted, short_sql, text_literal)
from grainsift.operators.aggkit import spread, tidy_aggregate, tidy_schema_rows, value_counts
from grainsift.operators.materialize import materialize
from grainsift.operators.ordering import with_position

_NULL_TEXT = "nan"


def sensitive_column_names(names: Sequence[str]) -> list[str]:
    pattern = re.compile(fixed.SENSITIVE_NAME_PATTERN, re.IGNORECASE)
    return [n for n in names if pattern.search(n)]


def sensitive_columns(df: DataFrame) -> DataFrame:
    return tidy_schema_rows(df, [(n,) for n in sensitive_column_names(df.columns)], "column_name string")


def dominant_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value (smallest text on ties) and its share of the present values."""
    counts = value_counts(df, columns)
    return counts.groupBy("column_name").agg(
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("dominant_value"),
        (F.max("n") / F.sum("n")).alias("dominant_fraction"))


def positive_label(df: DataFrame, target: str) -> DataFrame:
    """The most frequent target value counts as positive."""
    return dominant_values(df, [target]).select(F.col("dominant_value").alias("positive_label"))


def privileged_values(df: DataFrame, columns: Sequence[str],
                      dominant: Optional[dict[str, str]] = None) -> dict[str, list[str]]:
    """Known privileged groups by column name, else the dominant value."""
    unknown = [c for c in columns if c.lower() not in fixed.PRIVILEGED_GROUPS]
    if dominant is None:
        dominant = {r["column_name"]: r["dominant_value"]
                    for r in dominant_values(df, unknown).collect()} if unknown else {}
    return {c: fixed.PRIVILEGED_GROUPS.get(c.lower(), [dominant[c]] if dominant.get(c) else [])
            for c in columns}


def _member_sql(df: DataFrame, column: str, values: Sequence[str]) -> str:
    if not values:
        return "false"
    return f"coalesce({cell_sql(df, column)} IN ({', '.join(text_literal(v) for v in values)}), false)"


def is_member(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Membership in a group of values; a missing value is no member."""
    return F.expr(_member_sql(df, column, values))


def fairness_rates(df: DataFrame, columns: Sequence[str], target: str,
                   privileged: Optional[dict[str, list[str]]] = None,
                   label: Optional[str] = None) -> DataFrame:
    """Positive rates of both groups, their ratio and difference, for all columns in one scan."""
    if label is None:
        found = positive_label(df, target).first()
        label = found[0] if found else None
    positive = f"CASE WHEN {cell_sql(df, target)} = {text_literal(label or '')} THEN 1.0D ELSE 0.0D END"
    groups = privileged if privileged is not None else privileged_values(df, columns)
    rates = tidy_aggregate(df, [
        {"column_name": text_literal(c),
         "p_privileged": f"avg(CASE WHEN {_member_sql(df, c, groups[c])} THEN {positive} END)",
         "p_other": f"avg(CASE WHEN NOT {_member_sql(df, c, groups[c])} THEN {positive} END)"} for c in columns])
    return rates.selectExpr(
        "column_name", "round(p_privileged, 6) AS p_privileged", "round(p_other, 6) AS p_other",
        "round(p_other / nullif(p_privileged, 0.0D), 4) AS disparate_impact",
        "round(p_other - p_privileged, 4) AS parity_difference")


def bias_score(fraction: Column, threshold: float) -> Column:
    """0 up to the threshold share, 100 when one value fills the column."""
    if threshold >= 1.0:
        return F.lit(0.0)
    excess = 100.0 * (fraction - threshold) / (1.0 - threshold)
    return F.when(fraction <= threshold, F.lit(0.0)).otherwise(F.round(F.least(F.lit(100.0), excess), 2))


def bias_scores(df: DataFrame, columns: Sequence[str], threshold: float) -> DataFrame:
    return dominant_values(df, columns).select(
        "column_name", "dominant_value", F.round("dominant_fraction", 4).alias("dominant_fraction"),
        bias_score(F.col("dominant_fraction"), threshold).alias("bias_score"))


# --- proxies --------------------------------------------------------------------------

def numeric_proxies(df: DataFrame, sensitive: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """|Pearson| of each number column with the rank of the value of each sensitive column.

    Rows are folded per sensitive value first (count, mean and squared deviations), for all
    sensitive columns in one scan, so ranks and correlations work on one row per value. A missing
    sensitive value has rank -1.
    """
    keys = ", ".join(
        f"named_struct('sensitive', {text_literal(s)}, 'as_number', {_order_number(df, s)}, 'as_text', {cell_sql(df, s)})"
        for s in sensitive)
    values = [f"{number_sql(df, c)} AS x{i}" for i, c in enumerate(numbers)]
    long = df.selectExpr(f"inline(array({keys}))", *values)
    folded = long.groupBy("sensitive", "as_number", "as_text").agg(*[e for i in range(len(numbers)) for e in (
        F.expr(f"CAST(count(x{i}) AS DOUBLE) AS n{i}"), F.expr(f"coalesce(avg(x{i}), 0.0D) AS m{i}"),
        F.expr(f"coalesce(var_pop(x{i}), 0.0D) * count(x{i}) AS d{i}"))])
    folded = materialize(folded)
    placed = with_position(folded, ["sensitive", "as_number", "as_text"])
    # missing values sort first; the first present value of a column has rank 0
    present = F.col("as_text").isNotNull()
    starts = placed.groupBy("sensitive").agg(F.min(F.when(present, F.col("position"))).alias("start"))
    coded = placed.join(F.broadcast(starts), "sensitive").withColumn(
        "code", F.when(present, F.col("position") - F.col("start")).otherwise(F.lit(-1)).cast("double"))
    # shifting by the middle rank and by the mean keeps the sums small before they are subtracted
    middle = coded.groupBy("sensitive").agg(*[e for i in range(len(numbers)) for e in (
        F.expr(f"sum(n{i}) AS t{i}"), F.expr(f"sum(n{i} * code) / nullif(sum(n{i}), 0.0D) AS c{i}"),
        F.expr(f"sum(n{i} * m{i}) / nullif(sum(n{i}), 0.0D) AS a{i}"))])
    centred = coded.join(F.broadcast(middle), "sensitive")
    rows = ", ".join(
        f"named_struct('column_name', {text_literal(c)}, 'correlation', CASE WHEN max(t{i}) < 2 THEN 0.0D ELSE "
        f"abs(sum(n{i} * (code - c{i}) * (m{i} - a{i}))) / nullif(sqrt(sum(n{i} * (code - c{i}) * (code - c{i})) * "
        f"sum(d{i} + n{i} * (m{i} - a{i}) * (m{i} - a{i}))), 0.0D) END)" for i, c in enumerate(numbers))
    return (centred.groupBy("sensitive").agg(F.expr(f"array({rows})").alias("rows"))
            .select("sensitive", F.inline("rows")).filter("sensitive <> column_name")
            .withColumn("correlation", F.coalesce("correlation", F.lit(0.0))))


def _order_number(df: DataFrame, name: str) -> str:
    """What number, date and time columns sort by; text columns sort by their text."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return number_sql(df, name)
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({quoted(name)}) AS DOUBLE)"
    if isinstance(dtype, T.DateType):
        return f"CAST(unix_date({quoted(name)}) AS DOUBLE)"
    return "CAST(NULL AS DOUBLE)"


def categorical_proxies(df: DataFrame, sensitive: Sequence[str], others: Sequence[str]) -> DataFrame:
    """Cramer's V of each text column with each sensitive column; a missing value is its own group.

    Only the pairs of values that occur are counted. The statistic needs the totals of the
    sensitive value (a join Spark broadcasts when it is small and splits when it is skewed) and
    the totals of the other value, which come from the same grouping.
    """
    def filled(c: str) -> str:
        return f"coalesce({short_sql(cell_sql(df, c))}, '{_NULL_TEXT}')"

    wide = df.selectExpr(*[f"{filled(s)} AS s{i}" for i, s in enumerate(sensitive)],
                         *[f"{filled(c)} AS o{i}" for i, c in enumerate(others)])
    keys = "inline(array(" + ", ".join(
        f"named_struct('sensitive', {text_literal(s)}, 'key', s{i})" for i, s in enumerate(sensitive)) + "))"
    cells = "inline(array(" + ", ".join(
        f"named_struct('column_name', {text_literal(c)}, 'value', o{i})" for i, c in enumerate(others)) + "))"
    pairs = (wide.selectExpr(keys, *[f"o{i}" for i in range(len(others))]).selectExpr("sensitive", "key", cells)
             .filter("sensitive <> column_name")
             .groupBy("sensitive", "key", "column_name", "value").agg(F.count("*").alias("o")))
    totals = wide.selectExpr(keys).groupBy("sensitive", "key").agg(F.count("*").alias("r"))
    n_keys = totals.groupBy("sensitive").agg(F.count("*").alias("n_keys"))
    per_value = (pairs.join(totals, ["sensitive", "key"]).groupBy("sensitive", "column_name", "value")
                 .agg(F.expr("sum(o * CAST(o AS DOUBLE) / r) / sum(o) AS share")))
    sums = per_value.groupBy("sensitive", "column_name").agg(
        F.expr("greatest(0.0D, sum(share) - 1.0D) AS phi"), F.count("*").alias("n_values"))
    return sums.join(F.broadcast(n_keys), "sensitive").selectExpr(
        "sensitive", "column_name",
        "coalesce(sqrt(phi / nullif(least(n_values, n_keys) - 1, 0)), 0.0D) AS correlation")


def _text_or_category(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string" or is_categorical(f)]


def proxy_matrix(df: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Correlation of every sensitive column with every other number or text column."""
    numbers, texts = numeric_columns(df), _text_or_category(df)
    frames = []
    if sensitive and numbers:
        frames.append(numeric_proxies(df, sensitive, numbers))
    if sensitive and texts:
        frames.append(categorical_proxies(df, sensitive, texts))
    if not frames:
        return tidy_schema_rows(df, [], "sensitive string, column_name string, correlation double")
    return reduce(DataFrame.unionByName, frames)


def proxy_order(df: DataFrame, sensitive: Sequence[str]) -> list[tuple[str, str]]:
    """Order in which pairs are looked at: number columns first, then text columns."""
    others = numeric_columns(df) + _text_or_category(df)
    return [(s, o) for s in sensitive for o in others if s != o]


BIAS_DETAIL_SCHEMA = ("column_name string, bias_type string, dominant_value string, dominant_fraction double, "
                      "disparate_impact double, parity_difference double, proxy_correlation double, "
                      "is_proxy boolean, bias_score double")


def bias_details(df: DataFrame, sensitive: Sequence[str] = (), target: Optional[str] = None,
                 threshold: float = 0.70) -> DataFrame:
    """One row per sensitive column, then one per other column that stands in for one.

    Everything here has one row per column or pair of columns.
    """
    sensitive = [c for c in (sensitive or sensitive_column_names(df.columns)) if c in df.columns]
    if not sensitive:
        return tidy_schema_rows(df, [], BIAS_DETAIL_SCHEMA)
    found = {(r["sensitive"], r["column_name"]): r["correlation"] for r in proxy_matrix(df, sensitive).collect()}
    strong = [(o, found[(s, o)]) for s, o in proxy_order(df, sensitive)
              if (found.get((s, o)) or 0.0) >= fixed.PROXY_THRESHOLD]
    first_hit: dict[str, float] = {}
    for other, value in strong:
        first_hit.setdefault(other, value)
    proxies = [c for c in first_hit if c not in sensitive]

    measured = sensitive + proxies + ([target] if target and target in df.columns else [])
    base = {r["column_name"]: r for r in dominant_values(df, list(dict.fromkeys(measured))).collect()}
    rates = {}
    if target and target in df.columns and target in base:
        groups = privileged_values(df, sensitive, {c: base[c]["dominant_value"] for c in base})
        rates = {r["column_name"]: r for r in fairness_rates(
            df, sensitive, target, groups, base[target]["dominant_value"]).collect()}
    # one row per column from here on
    rows = []
    for c in sensitive + proxies:
        top, rate = base.get(c), rates.get(c)
        rows.append((c, "demographic" if c in sensitive else "proxy", top["dominant_value"] if top else None,
                     top["dominant_fraction"] if top else 0.0, rate["disparate_impact"] if rate else None,
                     rate["parity_difference"] if rate else None, first_hit.get(c)))
    fraction = F.col("fraction")
    return tidy_schema_rows(
        df, rows, "column_name string, bias_type string, dominant_value string, fraction double, "
                  "disparate_impact double, parity_difference double, hit double").select(
        "column_name", "bias_type", "dominant_value", F.round(fraction, 4).alias("dominant_fraction"),
        "disparate_impact", "parity_difference", F.round("hit", 4).alias("proxy_correlation"),
        F.col("hit").isNotNull().alias("is_proxy"),
        F.when(F.col("bias_type") == "demographic", bias_score(fraction, threshold))
        .otherwise(F.round(F.least(F.lit(100.0), 100.0 * F.col("hit")), 2)).alias("bias_score"))


def bias_report(details: DataFrame) -> DataFrame:
    """Mean score, affected columns and fairness figures from the detail rows."""
    affected = (F.col("bias_type") == "proxy") | (F.col("bias_score") > 0)
    fairness = F.when(F.col("disparate_impact").isNotNull() | F.col("parity_difference").isNotNull(),
                      F.concat_ws(":", F.col("column_name"),
                                  F.coalesce(F.col("disparate_impact").cast("string"), F.lit("-")),
                                  F.coalesce(F.col("parity_difference").cast("string"), F.lit("-"))))
    return details.agg(
        F.coalesce(F.round(F.avg("bias_score"), 2), F.lit(0.0)).alias("overall_bias_score"),
        F.array_join(F.array_sort(F.collect_list(F.when(affected, F.col("column_name")))), ",")
        .alias("affected_columns"),
        F.array_join(F.array_sort(F.collect_list(fairness)), ",").alias("fairness"))


def fairness_scorecard(details: DataFrame) -> DataFrame:
    """Six display axes from the mean bias score and the mean disparate impact."""
    means = details.agg(F.coalesce(F.avg("bias_score"), F.lit(60.0)).alias("b"),
                        F.coalesce(F.avg("disparate_impact"), F.lit(0.8)).alias("d"))
    b, d = F.col("b"), F.col("d")
    axes = {
        "demographic_parity": 100.0 - b,
        "equal_opportunity": 85.0 - 0.3 * b,
        "disparate_impact": 100.0 * F.least(d, 1.0 / F.greatest(d, F.lit(0.01))),
        "statistical_parity": 100.0 - 0.8 * b,
        "calibration": 100.0 - 0.25 * b,
        "treatment_equality": 100.0 - 0.6 * b,
    }
    rows = F.array(*[F.struct(F.lit(a).alias("axis"),
                              F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.round(e))).alias("score"))
                     for a, e in axes.items()])
    return means.select(F.inline(rows))


def crosstab_totals(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pairs of values that occur, with their count, both totals and the expected count."""
    cells = (df.select(cell_text(df, x).alias("x"), cell_text(df, y).alias("y")).filter("x IS NOT NULL AND y IS NOT NULL")
             .groupBy("x", "y").agg(F.count("*").alias("n")))
    rows = cells.groupBy("x").agg(F.sum("n").alias("row_total"))
    columns = cells.groupBy("y").agg(F.sum("n").alias("column_total"))
    total = rows.agg(F.sum("row_total")).first()[0] or 1
    return (cells.join(rows, "x").join(columns, "y")
            .select("x", "y", "n", "row_total", "column_total",
                    F.round(F.col("row_total") * F.col("column_total") / F.lit(total), 4).alias("expected")))


# --- correlation between number columns -------------------------------------------------

def correlation_matrix(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """|Pearson| for every pair of number columns over the rows where both are present.

    One scan for the means, one for the sums of all pairs at once as matrix products per batch;
    the shifted values keep the sums small, and only one row per pair and partition is shuffled.
    """
    columns = numeric_columns(df) if columns is None else columns
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    if not pairs:
        return tidy_schema_rows(df, [], "column_a string, column_b string, correlation double")
    # a column of one value is shifted by that value, so that nothing but zeros is left of it
    row = df.agg(*[F.expr(f"CASE WHEN min({x}) = max({x}) THEN min({x}) ELSE avg({x}) END")
                   for c in columns for x in [number_sql(df, c)]]).first()
    shifted = spread(df.selectExpr(*[f"{number_sql(df, c)} - {double_literal(m or 0.0)} AS x{i}"
                                     for i, (c, m) in enumerate(zip(columns, row))]))
    sums = (shifted.mapInPandas(_pair_sums, "a int, b int, n double, x double, y double, xx double, yy double, xy double")
            .groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")]))
    names = f"array({', '.join(text_literal(c) for c in columns)})"
    # what rounding leaves of a variance of zero is no variance
    left = "CASE WHEN {0}{0} - {0} * {0} / n > 1e-12D * {0}{0} THEN {0}{0} - {0} * {0} / n ELSE 0.0D END"
    spread_xy = f"sqrt({left.format('x')} * {left.format('y')})"
    return sums.selectExpr(
        f"{names}[a] AS column_a", f"{names}[b] AS column_b",
        f"CASE WHEN {spread_xy} > 0 THEN least(1.0D, abs(xy - x * y / n) / {spread_xy}) ELSE 0.0D END AS correlation")


def _pair_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sums over the rows where both columns of a pair are present, one row per pair and partition."""
    total = None
    for batch in batches:
        x = batch.to_numpy(dtype="float64")
        seen = ~np.isnan(x)
        x = np.where(seen, x, 0.0)
        here = seen.astype("float64")
        sums = np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        total = sums if total is None else total + sums
    if total is not None:
        a, b = np.triu_indices(total.shape[1], k=1)
        n, first, squares, products = total
        yield pd.DataFrame({"a": a, "b": b, "n": n[a, b], "x": first[a, b], "y": first[b, a],
                            "xx": squares[a, b], "yy": squares[b, a], "xy": products[a, b]})


def redundant_columns(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    return (correlation_matrix(df, columns).filter(F.col("correlation") > fixed.CORRELATION_THRESHOLD)
            .select("column_a", "column_b"))


def correlation_bands(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Pairs by strength, each with its display band."""
    r = F.col("correlation")
    label = (F.when(r > 0.9, F.lit("very high")).when(r > 0.8, F.lit("high"))
             .when(r > 0.7, F.lit("moderate")).otherwise(F.lit("low")))
    return (correlation_matrix(df, columns)
            .select("column_a", "column_b", F.round(r, 6).alias("correlation"), label.alias("band"))
            .orderBy(F.desc("correlation"), "column_a", "column_b"))
