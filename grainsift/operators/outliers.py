"""Outliers of number columns: fences, scores, capping and box-plot figures."""

from __future__ import annotations

from typing import Mapping, Optional, Sequence

from pyspark.sql import DataFrame, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import double_literal, number_sql, numeric_columns, quoted, text_literal
from grainsift.operators.aggkit import long_aggregate, tidy_schema_rows
from grainsift.operators.quantiles import exact_quantiles

_DETAIL_SCHEMA = ("column_name string, method string, outlier_count long, outlier_fraction double, "
                  "lower_bound double, upper_bound double, suggested_cap double")


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = fixed.IQR_MULTIPLIER
               ) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column that has values."""
    quartiles = exact_quantiles(df, {c: (number_sql(df, c), [0.25, 0.75]) for c in columns})
    return {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1))
            for c, (q1, q3) in quartiles.items() if q1 is not None}


def _moments(df: DataFrame, columns: Sequence[str], population: bool) -> dict[str, tuple[float, Optional[float]]]:
    spread = "stddev_pop" if population else "stddev_samp"
    items = [{"column_name": text_literal(c), "x": number_sql(df, c)} for c in columns]
    found = long_aggregate(df, items, ["column_name"], {
        "mean": "avg(x)", "spread": f"CASE WHEN count(x) > 1 THEN {spread}(x) END"}).collect()
    return {r["column_name"]: (r["mean"], r["spread"]) for r in found if r["mean"] is not None}


_OUTSIDE = "(x < low OR x > high)"
_TAIL = "column_name string, method string, outlier_count long, outlier_fraction double"


def _outside(x: str, low: float, high: float) -> str:
    return f"({x} < {double_literal(low)} OR {x} > {double_literal(high)})"


def _beyond(x: str, centre: float, spread: Optional[float], limit: float, scale: float = 1.0) -> str:
    if not spread:
        return "false"
    return (f"abs({double_literal(scale)} * ({x} - {double_literal(centre)}) / {double_literal(spread)}) "
            f"> {double_literal(limit)}")


def _with_figures(df: DataFrame, figures: Mapping[str, Sequence[Optional[float]]], names: Sequence[str]
                  ) -> list[dict[str, str]]:
    """Items for ``long_aggregate``: the number and the figures of its column, in table order."""
    return [{"column_name": text_literal(c), "x": number_sql(df, c),
             **{n: double_literal(v) for n, v in zip(names, figures[c])}} for c in figures]


def _counted(df: DataFrame, items: list[dict[str, str]], method: str, hit: str, whole: str,
             shown: Mapping[str, str]) -> DataFrame:
    """Rows that satisfy ``hit`` per column, with the figures that decided it."""
    if not items:
        return tidy_schema_rows(df, [], _TAIL + "".join(f", {n} double" for n in shown))
    counted = long_aggregate(df, items, ["column_name"], {
        "method": f"'{method}'", "outlier_count": f"count_if({hit})",
        "outlier_fraction": f"round(count_if({hit}) / CAST(greatest({whole}, 1) AS DOUBLE), 4)",
        **{n: f"round({e}, 4)" for n, e in shown.items()}})
    return counted


_FENCES = {"lower_bound": "max(low)", "upper_bound": "max(high)"}


def outliers_iqr(df: DataFrame, columns: Optional[Sequence[str]] = None, of_present: bool = False) -> DataFrame:
    """Values strictly outside the fences; the share is of all rows or of the present values."""
    columns = numeric_columns(df) if columns is None else columns
    items = _with_figures(df, iqr_fences(df, columns), ["low", "high"])
    return _counted(df, items, "iqr", _OUTSIDE, "count(x)" if of_present else "count(1)", _FENCES)


def outliers_zscore(df: DataFrame, columns: Optional[Sequence[str]] = None, population: bool = False) -> DataFrame:
    """Values more than three deviations from the mean (sample or population deviation)."""
    columns = numeric_columns(df) if columns is None else columns
    items = _with_figures(df, _moments(df, columns, population), ["centre", "spread"])
    return _counted(df, items, "zscore", f"spread > 0 AND abs((x - centre) / spread) > {fixed.Z_SCORE_THRESHOLD}D",
                    "count(x)" if population else "count(1)", {"mean": "max(centre)", "std": "max(spread)"})


def _median_and_mad(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    medians = {c: m[0] for c, m in exact_quantiles(
        df, {c: (number_sql(df, c), [0.5]) for c in columns}).items() if m[0] is not None}
    mads = exact_quantiles(df, {c: (f"abs({number_sql(df, c)} - {double_literal(m)})", [0.5]) for c, m in medians.items()})
    return {c: (m, mads[c][0]) for c, m in medians.items()}


def outliers_modified_zscore(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Distance from the median in units of the median absolute deviation."""
    columns = numeric_columns(df) if columns is None else columns
    items = _with_figures(df, _median_and_mad(df, columns), ["centre", "spread"])
    hit = (f"spread > 0 AND abs({fixed.MODIFIED_Z_SCALE}D * (x - centre) / spread) "
           f"> {fixed.Z_SCORE_THRESHOLD}D")
    return _counted(df, items, "modified_zscore", hit, "count(1)", {"median": "max(centre)", "mad": "max(spread)"})


def outlier_rows(df: DataFrame, column: str, row_id: str, method: str = "iqr") -> DataFrame:
    """The outlying rows of one column: bounds first, then a filter that reaches the scan."""
    x = number_sql(df, column)
    if method == "iqr":
        bounds = iqr_fences(df, [column]).get(column)
        hit = _outside(x, *bounds) if bounds else "false"
    elif method == "zscore":
        moments = _moments(df, [column], population=False).get(column)
        hit = _beyond(x, *moments, fixed.Z_SCORE_THRESHOLD) if moments else "false"
    elif method == "modified_zscore":
        centre = _median_and_mad(df, [column]).get(column)
        hit = _beyond(x, *centre, fixed.Z_SCORE_THRESHOLD, fixed.MODIFIED_Z_SCALE) if centre else "false"
    else:
        raise ValueError("method must be iqr, zscore or modified_zscore")
    return df.filter(hit).selectExpr(quoted(row_id), f"{x} AS value")


def suggest_cap(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """99th percentile of columns that have outliers by the fences."""
    details = outlier_details(df, "iqr", columns)
    return details.filter("outlier_count > 0").select("column_name", "suggested_cap")


def outlier_details(df: DataFrame, method: str = "iqr", columns: Optional[Sequence[str]] = None,
                    sizes: Optional[dict[str, int]] = None) -> DataFrame:
    """Outliers per number column with share of present values, fences and a suggested cap."""
    columns = numeric_columns(df) if columns is None else columns
    if not columns:
        return tidy_schema_rows(df, [], _DETAIL_SCHEMA)
    figures = exact_quantiles(df, {c: (number_sql(df, c), [0.25, 0.75, 0.99]) for c in columns}, sizes=sizes)
    hit = _OUTSIDE
    if method == "iqr":
        k = fixed.IQR_MULTIPLIER
        rows = {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1), cap) for c, (q1, q3, cap) in figures.items()
                if q1 is not None}
        items = _with_figures(df, rows, ["low", "high", "cap"])
        shown = _FENCES
    else:
        moments = _moments(df, columns, population=True)
        rows = {c: (*moments[c], figures[c][2]) for c in moments}
        items = _with_figures(df, rows, ["centre", "spread", "cap"])
        hit = f"spread > 0 AND abs((x - centre) / spread) > {fixed.Z_SCORE_THRESHOLD}D"
        shown = {"lower_bound": "CAST(NULL AS DOUBLE)", "upper_bound": "CAST(NULL AS DOUBLE)"}
    return _counted(df, items, method, hit, "count(x)", {
        **shown, "suggested_cap": f"CASE WHEN count_if({hit}) > 0 THEN max(cap) END"})


def cap_bounds(df: DataFrame, names: Sequence[str], method: str, iqr_multiplier: float,
               zscore_threshold: float) -> dict[str, tuple[float, float]]:
    """Bounds of the columns that can be capped; columns without spread are left out."""
    if not names:
        return {}
    if method == "iqr":
        fences = exact_quantiles(df, {c: (number_sql(df, c), [0.25, 0.75]) for c in names})
        return {c: (q1 - iqr_multiplier * (q3 - q1), q3 + iqr_multiplier * (q3 - q1))
                for c, (q1, q3) in fences.items() if q1 is not None and q3 != q1}
    return {c: (mean - zscore_threshold * std, mean + zscore_threshold * std)
            for c, (mean, std) in _moments(df, names, population=False).items() if std}


def cap_outliers(df: DataFrame, method: str = "iqr", cap: bool = True,
                 iqr_multiplier: float = fixed.IQR_MULTIPLIER,
                 zscore_threshold: float = fixed.Z_SCORE_THRESHOLD,
                 columns: Optional[Sequence[str]] = None) -> tuple[DataFrame, DataFrame]:
    """Clip number columns to their bounds; no row is dropped. Returns (table, report).

    A column changes (and becomes double) only when it has a value to clip.
    """
    chosen = numeric_columns(df) if columns is None else columns
    bounds = cap_bounds(df, chosen, method, iqr_multiplier, zscore_threshold)
    schema = ("column_name string, method string, lower_bound double, upper_bound double, "
              "outliers_detected long, outliers_capped long")
    if not bounds:
        return df, tidy_schema_rows(df, [], schema)
    names = list(bounds)
    counts = df.agg(*[F.expr(f"count_if({_outside(number_sql(df, c), *bounds[c])}) AS n{i}")
                      for i, c in enumerate(names)]).first()
    detected = {c: counts[i] for i, c in enumerate(names)}
    # greatest and least skip NULL, so a missing cell has to be kept by hand
    clipped = {c: F.expr(f"CASE WHEN {x} IS NOT NULL THEN greatest({double_literal(bounds[c][0])}, "
                         f"least({double_literal(bounds[c][1])}, {x})) END")
               for c in names for x in [number_sql(df, c)] if cap and detected[c] > 0}
    report = [(c, method, round(bounds[c][0], 4), round(bounds[c][1], 4), detected[c],
               detected[c] if c in clipped else 0) for c in names]
    return df.withColumns(clipped) if clipped else df, tidy_schema_rows(df, report, schema)


def boxplot_stats(df: DataFrame, columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Five-number summary and whiskers that end at the furthest value inside the fences."""
    columns = numeric_columns(df) if columns is None else columns
    figures = exact_quantiles(df, {c: (number_sql(df, c), [0.25, 0.5, 0.75]) for c in columns})
    k = fixed.IQR_MULTIPLIER
    items = _with_figures(df, {c: (q1, median, q3, q1 - k * (q3 - q1), q3 + k * (q3 - q1))
                               for c, (q1, median, q3) in figures.items() if q1 is not None},
                          ["q1", "q2", "q3", "low", "high"])
    inside = f"CASE WHEN NOT {_OUTSIDE} THEN x END"
    return long_aggregate(df, items, ["column_name"], {
        "min": "min(x)", "q1": "round(max(q1), 4)", "median": "round(max(q2), 4)", "q3": "round(max(q3), 4)",
        "max": "max(x)", "whisker_low": f"min({inside})", "whisker_high": f"max({inside})",
        "outlier_count": f"count_if({_OUTSIDE})"})


def outliers_ranked(df: DataFrame) -> DataFrame:
    """Columns with outliers, most first, with the share of the largest count."""
    details = outlier_details(df).filter("outlier_count > 0").select("column_name", "outlier_count")
    # one row per column, so the largest count is known to the driver
    top = details.agg(F.max("outlier_count")).first()[0] or 1
    return (details.withColumn("bar", F.round(F.col("outlier_count") / F.lit(top), 4))
            .orderBy(F.desc("outlier_count"), "column_name"))
