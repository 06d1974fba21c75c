"""Readers for CSV, JSON and Parquet, and what an import has to settle about a file."""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import quoted, text_number_sql

READABLE = (".csv", ".json", ".parquet")
DEFAULT_MAX_ROWS = 10_000
_TEXT_ENCODINGS = ("UTF-8", "ISO-8859-1")


def read_csv(spark: SparkSession, path: str, infer: bool = True, encoding: str = "UTF-8",
             schema: Optional[T.StructType] = None, multi_line: bool = True) -> DataFrame:
    """CSV with a header; missing-value words become NULL before types are inferred.

    Inference reads the files once more: give a schema for large inputs. With ``multi_line`` a quoted cell may
    hold line breaks, and one file is one task's work; without it, files are split and a line is a row.
    """
    options = {"header": True, "encoding": encoding, "multiLine": multi_line, "escape": '"'}
    if schema is not None:
        return na_normalize(spark.read.options(**options).schema(schema).csv(path))
    raw = na_normalize(spark.read.options(**options).csv(path))
    raw = raw.withColumnsRenamed({c: c.lstrip("﻿") for c in raw.columns if c.startswith("﻿")})
    return _infer(raw) if infer else raw


def _infer(raw: DataFrame) -> DataFrame:
    """Narrowest of long, double and boolean that every non-missing value of a column fits."""
    checks = []
    for i, c in enumerate(raw.columns):
        column = F.col(f"`{c}`")
        checks += [F.count(column).alias(f"n{i}"),
                   F.count(F.when(column.rlike(fixed.INTEGER_PATTERN), column.try_cast("long"))).alias(f"l{i}"),
                   F.count(F.expr(text_number_sql(quoted(c)))).alias(f"d{i}"),
                   F.count_if(F.lower(column).isin("true", "false")).alias(f"b{i}")]
    if not checks:
        return raw
    row = raw.agg(*checks).first()
    out = []
    for i, c in enumerate(raw.columns):
        n, longs, doubles, booleans = (row[f"{k}{i}"] for k in "nldb")
        column = F.col(f"`{c}`")
        if n and longs == n:
            column = column.cast("long")
        elif n and doubles == n:
            column = column.cast("double")
        elif n and booleans == n:
            column = column.cast("boolean")
        out.append(column.alias(c))
    return raw.select(*out)


def na_normalize(df: DataFrame) -> DataFrame:
    """Missing-value words in string columns and NaN in float columns become NULL."""
    out = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            column = F.when(~column.isin(fixed.NA_TOKENS), column)
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            column = F.when(~F.isnan(column), column)
        out.append(column.alias(f.name, metadata=f.metadata))
    return df.select(*out)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of records, or one record per line: the first character decides."""
    mark = F.substring(F.ltrim("value"), 1, 1)       # one character travels, however long the line is
    start = spark.read.text(path).select(mark).filter(mark != "").first()
    is_array = bool(start and start[0].startswith("["))
    return spark.read.option("multiLine", is_array).json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Reader by suffix."""
    suffix = "." + path.rstrip("/").rsplit(".", 1)[-1].lower()
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix == ".json":
        return read_json(spark, path)
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"cannot read {path!r}; accepted suffixes: {', '.join(READABLE)}")


def file_listing(spark: SparkSession, path: str, glob: Optional[str] = None) -> DataFrame:
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def dataset_size(spark: SparkSession, path: str) -> DataFrame:
    """Megabytes and kilobytes of the files; their content is not read."""
    size = F.sum("length") / F.lit(1024.0 * 1024.0)
    return (file_listing(spark, path).select("length").agg(size.alias("mb"))
            .select(F.round("mb", 3).alias("size_mb"), F.round(F.col("mb") * 1024, 2).alias("size_kb")))


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 when every line of every file is valid, else the one-byte Western encoding.

    The text source hands lines on as raw bytes, so files of any size are checked in splits.
    """
    valid = spark.read.text(path).agg(F.bool_and(F.is_valid_utf8("value"))).first()[0]
    return _TEXT_ENCODINGS[1] if valid is False else _TEXT_ENCODINGS[0]


def first_matching_file(spark: SparkSession, folder: str, glob: str = "*.csv") -> DataFrame:
    """The first file below the folder in path order."""
    return file_listing(spark, folder, glob).select("path").agg(F.min("path").alias("path"))


def flatten_nested(df: DataFrame) -> DataFrame:
    """Structs, arrays and maps become JSON text; other columns stay."""
    out = []
    for f in df.schema:
        column = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            column = F.to_json(column)
        out.append(column.alias(f.name))
    return df.select(*out)


def first_rows(df: DataFrame, order_by: Sequence[str], max_rows: int = DEFAULT_MAX_ROWS) -> DataFrame:
    """The first rows in the given order (an import limit chosen by the caller)."""
    return df.orderBy(*order_by).limit(max_rows)


def import_summary(df: DataFrame) -> DataFrame:
    """Number of rows, column names and the name of the first file read."""
    with_file = df.select(F.col("_metadata.file_name").alias("file_name"))
    return with_file.agg(F.count("*").alias("n_rows"), F.min("file_name").alias("file_name")).select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"),
        F.lit(",".join(df.columns)).alias("column_names"), "file_name")


def with_row_id(df: DataFrame, keys: Sequence[str] = (), name: str = "row_id") -> DataFrame:
    """Row identity: one caller's key column, or a number made once for a stable scan."""
    if len(keys) == 1:
        return df.withColumn(name, F.col(keys[0]).cast("long"))
    if keys:
        raise ValueError("give one unique key column; combine several into one first")
    return df.withColumn(name, F.monotonically_increasing_id())
