"""Work along a total order without one task that holds all rows.

Rows are cut into buckets by sampled bounds of the order columns, so a bucket is a contiguous
stretch of the order with a limited number of rows; what has to cross buckets is one small row
per bucket. The bounds only steer balance: any bounds give the same result.
"""

from __future__ import annotations

import json
import math
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainsift.functions.columns import sort_key

ROWS_PER_BUCKET = 1_000_000
MAX_BUCKETS = 32_768
SAMPLES_PER_BUCKET = 8


def order_bounds(df: DataFrame, order_by: Sequence[str], rows_per_bucket: Optional[int] = None) -> list[tuple]:
    """Ascending bucket bounds; empty when all rows fit one bucket."""
    size = ROWS_PER_BUCKET if rows_per_bucket is None else rows_per_bucket
    n = df.count()
    buckets = min(MAX_BUCKETS, math.ceil(n / size)) if n else 1
    if buckets <= 1:
        return []
    wanted = buckets * SAMPLES_PER_BUCKET
    keys = df.select(*[sort_key(df, c).alias(f"k{i}") for i, c in enumerate(order_by)])
    # NULL sorts first, here as in Spark's order of rows, so columns that are mostly NULL are split by the others
    sample = keys.sample(min(1.0, 1.5 * wanted / n), seed=7).limit(2 * wanted).collect()
    ordered = sorted({tuple(r) for r in sample}, key=lambda r: tuple((v is not None, v if v is not None else 0) for v in r))
    step = max(1, len(ordered) // buckets)
    return ordered[step::step]


def bucket_of(df: DataFrame, order_by: Sequence[str], bounds: Sequence[tuple]) -> Column:
    """Number of bounds at or before the row: a coarse search, then a fine one."""
    if not bounds:
        return F.lit(0)
    row = F.struct(*[sort_key(df, c).alias(f"k{i}") for i, c in enumerate(order_by)])
    kind = df.select(row.alias("k")).schema["k"].dataType.simpleString()
    step = max(1, math.isqrt(len(bounds)))

    def constant(part: Sequence[tuple]) -> Column:
        text = json.dumps([{f"k{i}": v for i, v in enumerate(b)} for b in part], default=str)
        return F.from_json(F.lit(text), f"array<{kind}>")

    passed = F.size(F.filter(constant(bounds[step - 1::step]), lambda b: b <= row)) * step
    rest = F.filter(F.slice(constant(bounds), passed + 1, F.lit(step)), lambda b: b <= row)
    return (passed + F.size(rest)).cast("int")


def with_bucket(df: DataFrame, order_by: Sequence[str], name: str,
                rows_per_bucket: Optional[int] = None) -> DataFrame:
    return df.withColumn(name, bucket_of(df, order_by, order_bounds(df, order_by, rows_per_bucket)))


def with_position(df: DataFrame, order_by: Sequence[str], name: str = "position",
                  rows_per_bucket: Optional[int] = None) -> DataFrame:
    """Add the place of every row (from 0) in the total order of the ``order_by`` columns."""
    bounds = order_bounds(df, order_by, rows_per_bucket)
    bucketed = df.withColumn("_bucket", bucket_of(df, order_by, bounds))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order_by)).cast("long") - 1
    if not bounds:
        return bucketed.withColumn(name, within).drop("_bucket")
    counts = {r["_bucket"]: r["n"] for r in bucketed.groupBy("_bucket").agg(F.count("*").alias("n")).collect()}
    offsets, total = [], 0
    for b in range(len(bounds) + 1):
        offsets.append(total)
        total += counts.get(b, 0)
    start = F.get(F.from_json(F.lit(json.dumps(offsets)), "array<bigint>"), F.col("_bucket"))
    return bucketed.withColumn(name, start + within).drop("_bucket")
