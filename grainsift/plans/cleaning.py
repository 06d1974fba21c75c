"""The cleaning run: types, duplicates, missing values, outliers, in this order."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import DataFrame, functions as F

from grainsift.config import CleaningConfig
from grainsift.functions.columns import cell_text, numeric_columns, object_columns
from grainsift.operators.aggkit import settle, tidy_schema_rows
from grainsift.operators.duplicates import duplicate_groups, exact_dedup
from grainsift.operators.impute import impute
from grainsift.operators.materialize import materialize
from grainsift.operators.nearpairs import kept_partners, token_sets
from grainsift.operators.outliers import cap_outliers
from grainsift.operators.typeinfer import convert_types, infer_types


@dataclass
class CleanResult:
    """The cleaned table, the reports of the stages that ran, and a row for everything they changed.

    ``changes`` has the row id, the ``stage``, and for a cell its ``column_name``, ``old_value`` and ``new_value`` (a value
    that its type cannot hold is lost, a missing one filled, an extreme one capped), for a removed row the ``kept_id`` it
    repeats and the ``similarity``. It is computed when it is read.
    """

    table: DataFrame
    reports: dict[str, DataFrame] = field(default_factory=dict)
    changes: Optional[DataFrame] = None


def near_removals(df: DataFrame, row_id: str, threshold: float = 0.90,
                  columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Rows that a kept earlier row is alike to, with that row: (row id, kept_id, similarity).

    Rows with equal token sets fall together first (rows without any token are equal too); the greedy choice in id
    order then runs on one row per set. ``kept_id`` is the first kept row that drops the row.
    """
    columns = columns if columns is not None else [c for c in object_columns(df) if c != row_id]
    id_type = df.schema[row_id].dataType.simpleString()
    if not columns:
        return tidy_schema_rows(df, [], f"{row_id} {id_type}, kept_id {id_type}, similarity double")
    found = token_sets(df, row_id, columns, lower=True)
    removers = materialize(kept_partners(found, threshold))
    members = found.members.join(removers, "rep", "left").select(
        F.col("row_id").alias(row_id), F.coalesce("by.id_a", "rep").alias("kept_id"),
        F.coalesce("by.jaccard", F.lit(1.0)).alias("similarity"))
    return members.filter(F.col(row_id) != F.col("kept_id"))


def fuzzy_dedup(df: DataFrame, row_id: str, threshold: float = 0.90,
                columns: Optional[Sequence[str]] = None) -> DataFrame:
    """Keep rows in id order and drop later rows that are alike to a kept one."""
    return df.join(near_removals(df, row_id, threshold, columns).select(row_id), row_id, "left_anti").select(*df.columns)


@dataclass
class Deduplicated:
    """The rows kept, the report, and every row removed: (row id, stage, kept_id, similarity)."""

    table: DataFrame
    report: DataFrame
    removed: DataFrame


def deduplicate(df: DataFrame, row_id: str, threshold: float = 0.90, fuzzy: bool = True) -> Deduplicated:
    """Exact duplicates, then near duplicates."""
    original = df.count()
    exact = materialize(exact_dedup(df, row_id))
    after_exact = exact.count()
    removed = (duplicate_groups(df, row_id).filter(F.col(row_id) != F.col("group_id"))
               .select(row_id, F.lit("exact_duplicate").alias("stage"), F.col("group_id").alias("kept_id"),
                       F.lit(1.0).alias("similarity")))
    table, left = exact, after_exact
    if fuzzy:
        near = materialize(near_removals(exact, row_id, threshold))
        removed = removed.union(near.select(row_id, F.lit("near_duplicate"), "kept_id", "similarity"))
        table = materialize(exact.join(near.select(row_id), row_id, "left_anti").select(*df.columns))
        left = table.count()
    report = [(original - after_exact, after_exact - left, original - left, original, left, threshold)]
    return Deduplicated(table, tidy_schema_rows(
        df, report, "exact_removed long, fuzzy_removed long, total_removed long, original_rows long, "
                    "cleaned_rows long, fuzzy_threshold double"), removed)


def remove_duplicates(df: DataFrame, row_id: str, threshold: float = 0.90,
                      fuzzy: bool = True) -> tuple[DataFrame, DataFrame]:
    """Exact duplicates, then near duplicates. Returns (table, report)."""
    found = deduplicate(df, row_id, threshold, fuzzy)
    return found.table, found.report


def removed_rows(before: DataFrame, after: DataFrame, row_id: str, k: int = 20) -> DataFrame:
    """The first removed row ids, an excerpt for display."""
    return before.join(after, row_id, "left_anti").select(row_id).orderBy(row_id).limit(k)


_CHANGED = {"types": "old_value IS NOT NULL AND new_value IS NULL", "missing": "old_value IS NULL AND new_value IS NOT NULL",
            "outliers": "try_cast(old_value AS double) <> try_cast(new_value AS double)"}


def _cell_changes(before: DataFrame, after: DataFrame, row_id: str, stage: str, columns: Sequence[str]) -> DataFrame:
    """Cells of the given columns that a stage changed, with their text before and after."""
    def long(df: DataFrame, value: str) -> DataFrame:
        texts = df.select(row_id, *[cell_text(df, c).alias(c) for c in columns])
        return texts.unpivot([row_id], list(columns), "column_name", value)
    return (long(before, "old_value").join(long(after, "new_value"), [row_id, "column_name"]).filter(_CHANGED[stage])
            .select(row_id, F.lit(stage).alias("stage"), "column_name", "old_value", "new_value",
                    F.lit(None).cast("string").alias("kept_id"), F.lit(None).cast("double").alias("similarity")))


def _row_changes(rows: DataFrame, row_id: str) -> DataFrame:
    empty = F.lit(None).cast("string")
    return rows.select(row_id, "stage", empty.alias("column_name"), empty.alias("old_value"), empty.alias("new_value"),
                       F.col("kept_id").cast("string").alias("kept_id"), "similarity")


def clean(df: DataFrame, config: CleaningConfig, row_id: str, order_by: Sequence[str] = ()) -> CleanResult:
    """Run the configured stages. ``row_id`` names the rows and is never changed itself.

    Forward and backward filling go along ``order_by`` (the row id when not given).
    """
    order_by = list(order_by) or [row_id]
    reports: dict[str, DataFrame] = {}
    original = df.count()
    n_columns = len(df.columns) - 1
    table = df

    changes: list[DataFrame] = []

    def changed(report: str, count: str, before: DataFrame) -> None:
        columns = [r["column_name"] for r in reports[report].filter(F.col(count) > 0).collect() if r["column_name"] != row_id]
        if columns:
            changes.append(_cell_changes(before, table, row_id, report, columns))

    if config.infer_types:
        if config.apply_type_conversions:
            before = table
            table, reports["types"] = convert_types(table, columns=[c for c in object_columns(table) if c != row_id])
            reports["types"] = settle(reports["types"])
            changed("types", "values_lost", before)
        else:
            reports["types"] = settle(infer_types(table.drop(row_id)))
    if config.remove_exact_duplicates:
        found = deduplicate(table, row_id, config.fuzzy_threshold, config.remove_fuzzy_duplicates)
        table, reports["duplicates"] = found.table, found.report
        changes.append(_row_changes(found.removed, row_id))
    if config.impute_missing:
        before = table
        table, reports["missing"] = impute(
            table, config.imputation_strategy, config.column_strategies, order_by)
        changed("missing", "cells_filled", before)
        if any(r["strategy_used"] == "drop" for r in reports["missing"].collect()):
            lost = before.join(table, row_id, "left_anti").select(
                row_id, F.lit("dropped").alias("stage"), F.lit(None).alias("kept_id"), F.lit(None).cast("double").alias("similarity"))
            changes.append(_row_changes(lost, row_id))
    if config.handle_outliers:
        # the row id is a name, not a quantity: it keeps out of the statistics
        before = table
        table, reports["outliers"] = cap_outliers(
            table, config.outlier_method, config.cap_outliers, config.iqr_multiplier, config.zscore_threshold,
            columns=[c for c in numeric_columns(table) if c != row_id])
        changed("outliers", "outliers_capped", before)
    id_type = df.schema[row_id].dataType.simpleString()
    log = reduce(DataFrame.unionByName, changes, tidy_schema_rows(
        df, [], f"{row_id} {id_type}, stage string, column_name string, old_value string, new_value string, kept_id string, "
                "similarity double"))
    reports["operations"] = _operations(df, reports)
    reports["shape"] = tidy_schema_rows(
        df, [(original, n_columns, table.count(), len(table.columns) - 1)],
        "original_rows long, original_columns long, final_rows long, final_columns long")
    return CleanResult(table, reports, log)


def _operations(df: DataFrame, reports: dict[str, DataFrame]) -> DataFrame:
    rows = []
    if "types" in reports and "converted_to" in reports["types"].columns:
        rows.append(("type_inference", reports["types"].filter("converted_to IS NOT NULL").count()))
    if "duplicates" in reports:
        rows.append(("duplicate_removal", reports["duplicates"].first()["total_removed"]))
    if "missing" in reports:
        rows.append(("imputation", reports["missing"].agg(F.coalesce(F.sum("cells_filled"), F.lit(0))).first()[0]))
    if "outliers" in reports:
        rows.append(("outlier_handling", reports["outliers"].agg(
            F.coalesce(F.sum("outliers_detected"), F.lit(0))).first()[0]))
    return tidy_schema_rows(df, [r for r in rows if r[1]], "operation string, n long")


def clean_summary(result: CleanResult) -> DataFrame:
    """Rows removed, cells cleaned, rows kept in percent and exact duplicates in percent."""
    shape = result.reports["shape"].first()

    def total(report: str, column: str) -> int:
        frame = result.reports.get(report)
        return frame.agg(F.coalesce(F.sum(column), F.lit(0))).first()[0] if frame is not None else 0

    before, after = shape["original_rows"], shape["final_rows"]
    exact = total("duplicates", "exact_removed")
    row = (before - after, total("missing", "cells_filled") + total("outliers", "outliers_capped"),
           round(100.0 * after / max(before, 1), 4), round(100.0 * exact / max(before, 1), 4))
    return tidy_schema_rows(result.table, [row], "rows_removed long, cells_cleaned long, retention_pct double, "
                                                 "exact_duplicate_pct double")
