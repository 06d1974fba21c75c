"""Shards and slots from a keyed permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainsift.llm.common import free_name

ROUNDS = 6
#: rows that share one numbering stretch, on average
STRETCH_ROWS = 50_000


def _round_value(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = half * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & mask


def _keys(seed: int) -> list[int]:
    state = np.random.SeedSequence(seed).generate_state(ROUNDS, np.uint64)
    return [int(k) for k in state]


def _half_bits(size: int) -> int:
    return max(1, (max(size - 1, 1).bit_length() + 1) // 2)


def permute(numbers: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Places of row numbers 0..size-1 under a balanced Feistel permutation of 4**k >= size numbers.

    A number that leaves the range is sent through again until it falls inside (cycle walking), which
    keeps the map a bijection on 0..size-1. Under four passes are expected, as 4**k < 4 * size.
    """
    keys, bits = _keys(seed), np.uint64(_half_bits(size))
    mask = np.uint64((1 << int(bits)) - 1)
    out = numbers.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & mask
        for key in keys:
            left, right = right, left ^ _round_value(right, key, mask)
        x = (left << bits) | right
        out[walking] = x
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def unpermute(places: np.ndarray, size: int, seed: int) -> np.ndarray:
    """The row number at each place: the inverse of ``permute``."""
    keys, bits = _keys(seed), np.uint64(_half_bits(size))
    mask = np.uint64((1 << int(bits)) - 1)
    out = places.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        x = out[walking]
        left, right = x >> bits, x & mask
        for key in reversed(keys):
            left, right = right ^ _round_value(left, key, mask), left
        x = (left << bits) | right
        out[walking] = x
        walking = walking[x >= np.uint64(size)]
    return out.astype(np.int64)


def with_row_number(df: DataFrame, order: list[Column], name: str, rows: int) -> DataFrame:
    """Adds gapless numbers 0..rows-1 that depend on the rows' content only, not on their files.

    Rows are dealt into stretches by a hash of the order columns, counted per stretch, and numbered
    within it by the order columns; a stretch starts where the counts before it end. Rows that
    agree in all order columns get numbers in any order.
    """
    stretches = max(1, -(-rows // STRETCH_ROWS))
    deal, start = free_name(df, "_deal"), free_name(df, "_start")
    dealt = df.withColumn(deal, F.pmod(F.xxhash64(*order), F.lit(stretches)))
    sizes = dealt.groupBy(deal).agg(F.count("*").alias("_n"))
    before = Window.orderBy(deal).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(deal, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(start))
    place = F.row_number().over(Window.partitionBy(deal).orderBy(*order))
    return (dealt.withColumn(name, place).join(starts, deal)
            .withColumn(name, F.col(name) + F.col(start) - 1).drop(deal, start))


def text_size(text: Column) -> Column:
    """UTF-8 bytes plus 1; null counts as no bytes."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def shard_rows(df: DataFrame, shards: int, seed: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds ``size``, ``text_crc32``, ``law``, ``shard``, ``slot`` and ``grown_shard`` to every row.

    Law ``rows``: row number i goes to place p = Feistel(i), shard p mod ``shards``, slot p div
    ``shards``, so shard counts differ by at most one and slots are gapless. The numbering follows
    id and text, so reruns over the same rows agree whatever the files; ``unpermute`` gives the row of
    any (shard, slot) without a table. ``grown_shard`` belongs to the law ``key`` and is null here.
    Null ids and null texts are values like others (a null text has size 1 and the checksum of the
    empty text); rows alike in id and text are interchangeable and each gets a slot of its own. An
    empty table gives no rows. Columns of ``df`` with the names of results are replaced.
    """
    added = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    df = df.drop(*[c for c in added if c in df.columns and c not in (id_col, text_col)])
    rows = df.count()
    facts = df.withColumns({"size": text_size(F.col(text_col)), "text_crc32": text_crc32(F.col(text_col))})
    number = free_name(df, "_row_number")
    numbered = with_row_number(facts, [F.col(id_col), F.col("text_crc32"), F.col("size")], number, rows)

    @F.pandas_udf("long")
    def place(numbers: pd.Series) -> pd.Series:
        return pd.Series(permute(numbers.to_numpy(), rows, seed))

    at = place(F.col(number))
    return (numbered.withColumn(number, at)
            .withColumns({"law": F.lit("rows"),
                          "shard": F.pmod(F.col(number), F.lit(shards)).cast("int"),
                          "slot": F.expr(f"`{number}` div {shards}"),
                          "grown_shard": F.lit(None).cast("int")})
            .drop(number))
