"""Choosing columns by type and bringing cells to a comparable form."""

from __future__ import annotations

from typing import Iterable, Optional

from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainsift.functions.fixed_values import NUMBER_TEXT_PATTERN

_NESTED = (T.StructType, T.ArrayType, T.MapType)


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns; booleans are not numbers here."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def is_categorical(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.StringType) and bool(field.metadata.get("categorical"))


def object_columns(df: DataFrame) -> list[str]:
    """String columns that were not converted to categories."""
    return [f.name for f in df.schema
            if isinstance(f.dataType, T.StringType) and not is_categorical(f)]


def columns_except(df: DataFrame, excluded: Iterable[Optional[str]]) -> list[str]:
    excluded = set(excluded)
    return [c for c in df.columns if c not in excluded]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(value: str) -> str:
    """A string as SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def double_literal(value: Optional[float]) -> str:
    """A number as SQL literal of type double."""
    return "CAST(NULL AS DOUBLE)" if value is None else f"double('{value!r}')"


def number_sql(df: DataFrame, name: str) -> str:
    """The column as double, with NaN turned into NULL."""
    number = f"CAST({quoted(name)} AS DOUBLE)"
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"nullif({number}, double('NaN'))"
    return number


def present_sql(df: DataFrame, name: str) -> str:
    """The column with NaN turned into NULL."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return f"CASE WHEN NOT isnan({quoted(name)}) THEN {quoted(name)} END"
    return quoted(name)


def text_number_sql(text: str) -> str:
    """A text as double where it is written as a plain number; a cast alone also takes suffixes as in ``12D``."""
    return f"CASE WHEN trim({text}) RLIKE {text_literal(NUMBER_TEXT_PATTERN)} THEN try_cast(trim({text}) AS DOUBLE) END"


def cell_sql(df: DataFrame, name: str) -> str:
    """One text per distinct value of the column; NULL stays NULL."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return quoted(name)
    if isinstance(dtype, _NESTED):
        return f"to_json(named_struct('v', {quoted(name)}))"
    if isinstance(dtype, T.TimestampType):
        return f"CAST(unix_micros({quoted(name)}) AS STRING)"
    if isinstance(dtype, T.BinaryType):
        return f"hex({quoted(name)})"
    return f"CAST({present_sql(df, name)} AS STRING)"


def short_sql(cell: str) -> str:
    """A text that stands for the cell when only equality counts: long ones travel as a digest."""
    return f"CASE WHEN length({cell}) > 64 THEN concat('#', sha2({cell}, 256)) ELSE {cell} END"


def as_number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def present(df: DataFrame, name: str) -> Column:
    return F.expr(present_sql(df, name))


def cell_text(df: DataFrame, name: str) -> Column:
    return F.expr(cell_sql(df, name))


def sort_key(df: DataFrame, name: str) -> Column:
    """An order-preserving form that can travel as a literal."""
    dtype = df.schema[name].dataType
    column = F.col(f"`{name}`")
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(dtype, T.TimestampNTZType):
        return F.unix_micros(column.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return F.unix_date(column)
    if isinstance(dtype, T.DecimalType):
        return column.cast("decimal(38,18)")
    return column


def kind_label(dtype: T.DataType) -> str:
    """Name for the kind of values a typed column holds."""
    if isinstance(dtype, T.StringType):
        return "string"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "floating"
    if isinstance(dtype, T.DecimalType):
        return "decimal"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, T.BinaryType):
        return "bytes"
    return "mixed"


def band(value: Column, bands: list[tuple[str, float]]) -> Column:
    """Name of the highest band whose lower bound the value reaches."""
    label = F.lit(None).cast("string")
    for name, low in bands:
        label = F.when(value >= F.lit(low), F.lit(name)).otherwise(label)
    return label


def strip(text: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
