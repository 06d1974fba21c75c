"""Types of text columns from their values, and the conversion to them."""

from __future__ import annotations

from functools import reduce
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import object_columns, quoted, text_literal, text_number_sql
from grainsift.operators import dates
from grainsift.operators.aggkit import few_valued, long_aggregate, spread, tidy_schema_rows


def _as_double(column: str) -> Column:
    return F.expr(text_number_sql(quoted(column)))


def infer_types(df: DataFrame, sample_rows: Optional[int] = None,
                order_by: Optional[Sequence[str]] = None) -> DataFrame:
    """Type of the values of every text column: (column_name, inferred_type).

    All rules are counted in one scan. Distinct values matter only for columns that no rule
    claims, and only when there are few, so they are counted for those columns alone. A column is one of dates when
    enough values look like dates and can be read as such in one order of day and month.
    """
    facts = _facts(df, object_columns(df), sample_rows, order_by)
    return tidy_schema_rows(df, list(_decided(df, facts).items()), "column_name string, inferred_type string")


def _facts(df: DataFrame, names: Sequence[str], sample_rows: Optional[int] = None,
           order_by: Optional[Sequence[str]] = None) -> dict[str, Row]:
    """Counts of every rule for every column (one row per column)."""
    if not names:
        return {}
    if sample_rows is None:
        counted = _counts(spread(df.select(*names)), names)
    else:
        counted = reduce(DataFrame.unionByName, [
            _counts(df.filter(F.col(c).isNotNull()).orderBy(*(order_by or [c])).limit(sample_rows), [c])
            for c in names])
    found = {r["column_name"]: r for r in counted.collect()}
    return {c: found[c] for c in names}


def _readable(facts: Row) -> int:
    """Values that are dates in the order of day and month that suits the column best."""
    return facts["year_first"] + max(facts["month_first"], facts["day_first"])


def _rule(facts: Row) -> Optional[str]:
    n, most = facts["n"], fixed.TYPE_SHARE
    if n == 0:
        return "unknown"
    for kind, count in (("boolean", "booleans"), ("integer", "integers"), ("float", "floats")):
        if facts[count] / n >= most:
            return kind
    if min(facts["dates"], _readable(facts)) / n >= fixed.DATE_SHARE:
        return "datetime"
    if facts["numbers"] / n >= most:
        return "integer" if facts["wholes"] == facts["numbers"] else "float"
    return None


def _decided(df: DataFrame, facts: dict[str, Row]) -> dict[str, str]:
    kinds = {c: _rule(f) for c, f in facts.items()}
    unclaimed = [c for c, kind in kinds.items() if kind is None]
    few = few_valued(df, unclaimed, fixed.CATEGORY_VALUES + 1)
    totals = df.agg(*[F.count(c).alias(c) for c in few]).first() if few else {}
    for c in unclaimed:
        kinds[c] = "categorical" if c in few and few[c] / max(totals[c], 1) < fixed.CATEGORY_SHARE else "string"
    return kinds


def _counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    def matches(pattern: str) -> str:
        return f"count_if(text RLIKE {text_literal(pattern)})"

    counted = long_aggregate(df, [{"column_name": text_literal(c), "text": quoted(c)} for c in names], ["column_name"], {
        "n": "count(text)", "booleans": matches(fixed.BOOLEAN_PATTERN), "integers": matches(fixed.INTEGER_PATTERN),
        "floats": matches(fixed.FLOAT_PATTERN), "dates": matches(fixed.DATE_PATTERN),
        "numbers": "count(nullif(number, double('NaN')))", "wholes": "count_if(number % 1 = 0)",
        "longs": "count(CASE WHEN number IS NOT NULL THEN coalesce(try_cast(trim(text) AS bigint), try_cast(number AS bigint)) END)",
        **{c: f"count({c})" for c in dates.READINGS}}, {"number": text_number_sql("text"), **dates.READINGS})
    listed = tidy_schema_rows(df, [(c,) for c in names], "column_name string")
    return listed.join(counted, "column_name", "left").na.fill(0)


def parse_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(fixed.TRUE_WORDS), F.lit(True)).when(low.isin(fixed.FALSE_WORDS), F.lit(False))


def convert_types(df: DataFrame, inferred: Optional[dict[str, str]] = None, sample_rows: Optional[int] = None,
                  columns: Optional[Sequence[str]] = None) -> tuple[DataFrame, DataFrame]:
    """Convert text columns (or ``columns`` of them) to their inferred types; values that do not parse become missing.

    The report tells the type that the values have, what became of the column, how many values were lost (or would have
    been, where a conversion failed) and the order of day and month in which dates were read. A column of whole numbers
    that holds a fraction stays as it is, and so does a column of dates of which too many cannot be read in one
    order; both are reported as failed. Columns that are no text are reported with their own type.
    Without ``inferred`` and ``sample_rows`` types and losses come from one scan. Returns (table, report).
    """
    names = list(inferred) if inferred is not None else [c for c in object_columns(df) if columns is None or c in columns]
    facts = _facts(df, names)
    if inferred is None:
        inferred = _decided(df, facts if sample_rows is None else _facts(df, names, sample_rows))
    changes: dict[str, Column] = {}
    report = []
    for c, kind in inferred.items():
        text, number, found = F.col(quoted(c)), _as_double(c), facts[c]
        target: Optional[str] = None
        failure: Optional[str] = None
        order = dates.chosen_order(found["month_first"], found["day_first"]) if kind == "datetime" else None
        kept = found["n"]
        if kind == "integer":
            kept = found["longs"]
            if found["wholes"] == found["numbers"]:
                changes[c] = F.when(number.isNotNull(), F.coalesce(F.trim(text).try_cast("long"), number.try_cast("long")))
                target = "bigint"
            else:
                failure = "holds numbers that are not whole"
        elif kind == "float":
            kept, changes[c], target = found["numbers"], F.when(~F.isnan(number), number), "double"
        elif kind == "boolean":
            kept, changes[c], target = found["booleans"], parse_boolean(text), "boolean"
        elif kind == "datetime":
            kept = _readable(found)
            if kept > 0 and kept >= fixed.DATE_SHARE * found["n"]:
                changes[c], target = dates.read_date(quoted(c), order or dates.MONTH_FIRST), "timestamp"
            else:
                failure = "holds too few dates that can be read in one order"
        elif kind == "categorical":
            changes[c], target = text.alias(c, metadata={"categorical": True}), "category"
        if kind in ("categorical", "string") and found["n"] and found["dates"] >= fixed.DATE_SHARE * found["n"]:
            failure = "looks like dates that cannot be read in one order"
        report.append((c, df.schema[c].dataType.simpleString(), kind, target, failure, found["n"] - kept, order))
    report += [(f.name, f.dataType.simpleString(), f.dataType.simpleString(), None, None, 0, None) for f in df.schema
               if f.name not in inferred]
    converted = df.select(*[changes[c].alias(c, metadata={"categorical": True} if inferred.get(c) == "categorical"
                                             else df.schema[c].metadata) if c in changes else F.col(quoted(c))
                            for c in df.columns])
    return converted, tidy_schema_rows(
        df, report, "column_name string, original_type string, inferred_type string, converted_to string, failure string, "
                    "values_lost long, date_order string")
