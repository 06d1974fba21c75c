"""Dates in text columns: which forms a column holds, which order of day and month it keeps, and reading them by it.

A value with the year in front, or of eight digits, reads in one way only. One with the year at the end may have the
month or the day first, and nothing in the value may tell. So the order is chosen for a column, not for a value: the one
in which more of its values are dates. Counting takes one pass over all columns.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import cell_sql, text_literal
from grainsift.operators.aggkit import long_aggregate, spread

MONTH_FIRST, DAY_FIRST = "month first", "day first"


def _when(text: str, shape: str, *parts: str) -> str:
    return f"WHEN {text} RLIKE {text_literal(shape)} THEN concat({', '.join(parts)})"


def _parsed(text: str, *cases: str) -> str:
    """No pattern is tried on a value that does not begin with a digit."""
    return f"try_cast(CASE WHEN left({text}, 1) NOT BETWEEN '0' AND '9' THEN NULL {' '.join(cases)} END AS timestamp)"


def _year_first(text: str) -> list[str]:
    def part(start: int, size: int) -> str:
        return f"substr({text}, {start}, {size}), '-'"
    return [_when(text, fixed.DATE_YEAR_FIRST, part(1, 4), part(6, 2), f"substr({text}, 9)"),
            _when(text, fixed.DATE_DIGITS, part(1, 4), part(5, 2), f"substr({text}, 7)")]


def _year_last(text: str, order: str) -> str:
    month, day = (1, 4) if order == MONTH_FIRST else (4, 1)
    return _when(text, fixed.DATE_YEAR_LAST, f"substr({text}, 7, 4)", "'-'", f"substr({text}, {month}, 2)", "'-'",
                 f"substr({text}, {day}, 2)", f"substr({text}, 11)")


def year_first_sql(text: str) -> str:
    """Timestamp of a value with the year in front, with or without a time, or of eight digits."""
    return _parsed(f"trim({text})", *_year_first(f"trim({text})"))


def year_last_sql(text: str, order: str) -> str:
    """Timestamp of a value with the year at the end, in the given order of day and month."""
    return _parsed(f"trim({text})", _year_last(f"trim({text})", order))


def read_date(text: str, order: str = MONTH_FIRST) -> Column:
    """Timestamp of a text (given as SQL) by one order of day and month; missing where it is no date by it."""
    return F.expr(_parsed(f"trim({text})", *_year_first(f"trim({text})"), _year_last(f"trim({text})", order)))


#: a field ``text`` read in each way; the counts of these choose the order and tell what it loses
READINGS = {"year_first": year_first_sql("text"), "month_first": year_last_sql("text", MONTH_FIRST),
            "day_first": year_last_sql("text", DAY_FIRST)}


def chosen_order(month_first: int, day_first: int) -> str | None:
    """Order in which more values are dates, month first if both have as many; none without such values."""
    if not month_first and not day_first:
        return None
    return DAY_FIRST if day_first > month_first else MONTH_FIRST


def date_formats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many values of each column are dates of each form, in one pass: (column_name, date_format, n).

    A value such as 05/02/2024 counts under both orders. Values that are dates of no form come as ``none``; forms that
    no value has do not come.
    """
    year, month, day = READINGS
    slash, dash = "substr(trim(text), 3, 1) = '/'", "substr(trim(text), 3, 1) = '-'"
    timed, digits = "trim(text) RLIKE '^.{10}[T ]'", "trim(text) RLIKE '^[0-9]+$'"
    forms = {"yyyy-MM-dd": f"{year} IS NOT NULL AND NOT {timed} AND NOT {digits}",
             "yyyy-MM-dd HH:mm": f"{year} IS NOT NULL AND {timed}", "yyyyMMdd": f"{year} IS NOT NULL AND {digits}",
             "MM/dd/yyyy": f"{slash} AND {month} IS NOT NULL", "dd/MM/yyyy": f"{slash} AND {day} IS NOT NULL",
             "MM-dd-yyyy": f"{dash} AND {month} IS NOT NULL", "dd-MM-yyyy": f"{dash} AND {day} IS NOT NULL",
             "none": f"coalesce({year}, {month}, {day}) IS NULL"}
    counts = {f"f{i}": f"count_if(text IS NOT NULL AND ({rule}))" for i, rule in enumerate(forms.values())}
    counted = long_aggregate(spread(df.select(*columns)),
                             [{"column_name": text_literal(c), "text": cell_sql(df, c)} for c in columns],
                             ["column_name"], counts, READINGS)
    pairs = ", ".join(f"{text_literal(name)}, {c}" for name, c in zip(forms, counts))
    return counted.selectExpr("column_name", f"stack({len(forms)}, {pairs}) AS (date_format, n)").filter("n > 0")
