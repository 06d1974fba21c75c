"""Column expressions and small helpers shared by the operators of this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: the largest estimated size of a table that is marked for broadcast
BROADCAST_ROWS = 500_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACED_WORD = r"[^\x20\x09-\x0D]++"
LETTER_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, _UPPER, _UPPER.lower())


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def free_name(df: DataFrame, name: str) -> str:
    """A name that no column of the table has, for working columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def small(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if the counted rows are few, else left to the optimizer."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
