"""Identical rows and identical columns."""

from __future__ import annotations

from functools import reduce
from typing import Optional

from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from grainsift.functions.columns import cell_text
from grainsift.operators.aggkit import tidy_schema_rows
from grainsift.operators.ordering import ROWS_PER_BUCKET, with_position


def _group_key(df: DataFrame, name: str) -> Column:
    """Maps cannot be grouped; their text can."""
    if isinstance(df.schema[name].dataType, T.MapType):
        return cell_text(df, name).alias(name)
    return F.col(f"`{name}`")


def _data_columns(df: DataFrame, row_id: Optional[str]) -> list[str]:
    return [c for c in df.columns if c != row_id]


def exact_duplicates(df: DataFrame, row_id: Optional[str] = None) -> DataFrame:
    """Rows beyond the first of each group of identical rows; missing values are equal.

    Copies collapse before the shuffle, so a row repeated very often costs nothing extra.
    """
    columns = _data_columns(df, row_id)
    groups = df.groupBy(*[_group_key(df, c) for c in columns]).agg(F.count("*").alias("n"))
    return groups.agg(
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_rows")).withColumn(
        "duplicate_fraction", F.round(F.col("duplicate_rows") / F.greatest(F.col("n_rows"), F.lit(1)), 4))


def duplicate_groups(df: DataFrame, row_id: str) -> DataFrame:
    """Members of every group of at least two identical rows, named by its smallest row id.

    One row per member: a group may be large, so its members are never put into one list.
    """
    columns = _data_columns(df, row_id)
    repeated = (df.groupBy(*columns).agg(F.count("*").alias("_n"), F.min(row_id).alias("group_id"))
                .filter("_n > 1"))
    same = reduce(lambda a, b: a & b, [df[c].eqNullSafe(repeated[c]) for c in columns])
    return df.join(repeated, same).select(repeated["group_id"], df[row_id])


def exact_dedup(df: DataFrame, row_id: str) -> DataFrame:
    """Keep the row with the smallest id of each group: a grouping, not a sort of every group."""
    columns = _data_columns(df, row_id)
    return df.groupBy(*columns).agg(F.min(row_id).alias(row_id)).select(*df.columns)


def duplicate_bytes(df: DataFrame, row_id: Optional[str] = None) -> DataFrame:
    """Text bytes held by rows that occur more than once."""
    columns = _data_columns(df, row_id)
    groups = df.groupBy(*columns).agg(F.count("*").alias("_n"))
    size = F.octet_length(F.concat_ws("", *[cell_text(groups, c) for c in columns]))
    return groups.filter("_n > 1").agg(
        F.coalesce(F.sum(F.col("_n") * size), F.lit(0)).cast("long").alias("duplicate_bytes")).withColumn(
        "duplicate_mb", F.round(F.col("duplicate_bytes") / F.lit(1024.0 * 1024.0), 6))


def duplicate_columns(df: DataFrame) -> DataFrame:
    """Columns that repeat an earlier column of the same type cell by cell.

    One scan makes a fingerprint per column; a second compares the few columns that share one.
    """
    marks = df.agg(*[e for i, c in enumerate(df.columns) for e in (
        F.count(F.col(f"`{c}`")).alias(f"n{i}"),
        F.sum(F.pmod(F.xxhash64(cell_text(df, c)), F.lit(2**32)).cast("decimal(20,0)")).alias(f"h{i}"))]).first()
    alike: dict[tuple, list[str]] = {}
    for i, c in enumerate(df.columns):
        alike.setdefault((df.schema[c].dataType.simpleString(), marks[f"n{i}"], marks[f"h{i}"]), []).append(c)
    first: dict[str, str] = {}
    groups = [g for g in alike.values() if len(g) > 1]
    while groups:                       # one comparison per column; a second round only where fingerprints lied
        pairs = [(g[0], c) for g in groups for c in g[1:]]
        equal = df.agg(*[F.coalesce(F.bool_and(cell_text(df, a).eqNullSafe(cell_text(df, b))), F.lit(True))
                         .alias(f"e{i}") for i, (a, b) in enumerate(pairs)]).first()
        first |= {b: a for i, (a, b) in enumerate(pairs) if equal[i]}
        groups = [g for g in ([c for c in g[1:] if c not in first] for g in groups) if len(g) > 1]
    return tidy_schema_rows(df, list(first.items()), "column_name string, same_as string")


def neighbour_pairs(df: DataFrame, row_id: str, threshold: float, reach: int = 4,
                    sample_rows: Optional[int] = None, rows_per_block: int = ROWS_PER_BUCKET) -> DataFrame:
    """Count of rows alike to one of the next ``reach`` rows, seen as sets of whole cells.

    Positions cut the table into blocks of equal size. The first rows of a block are also handed
    to the block before, so each block is worked on alone and no pair is lost.
    """
    columns = _data_columns(df, row_id)
    if sample_rows is not None:
        df = df.orderBy(row_id).limit(sample_rows)
    placed = with_position(df, [row_id], "_pos", rows_per_block)
    cells = F.array_distinct(F.array(*[F.coalesce(cell_text(df, c), F.lit("nan")) for c in columns]))
    sets = placed.select("_pos", cells.alias("_set")).withColumn("_block", F.floor(F.col("_pos") / rows_per_block))
    lent = sets.filter((F.col("_pos") % rows_per_block < reach) & (F.col("_block") > 0)).select(
        "_pos", "_set", (F.col("_block") - 1).alias("_block"), F.lit(True).alias("_lent"))
    blocks = sets.withColumn("_lent", F.lit(False)).unionByName(lent)
    window = Window.partitionBy("_block").orderBy("_pos")
    ahead = [F.lead("_set", k).over(window).alias(f"_s{k}") for k in range(1, reach + 1)]

    def alike(other: Column) -> Column:
        shared = F.size(F.array_intersect("_set", other))
        union = F.size(F.array_union("_set", other))
        return F.coalesce((shared / union >= threshold) & (shared < union), F.lit(False)).cast("long")

    per_row = sum((alike(F.col(f"_s{k}")) for k in range(1, reach + 1)), F.lit(0))
    return (blocks.select("_set", "_lent", *ahead).filter(~F.col("_lent"))
            .agg(F.coalesce(F.sum(per_row), F.lit(0)).cast("long").alias("near_pairs"),
                 F.count("*").alias("n_compared")))


def near_duplicate_estimate(df: DataFrame, row_id: str, threshold: float = 0.85,
                            sample_rows: Optional[int] = None) -> DataFrame:
    """Estimated near-duplicate pairs from neighbouring rows, whole table by default."""
    n = df.count()
    pairs = neighbour_pairs(df, row_id, threshold, sample_rows=sample_rows)
    compared = F.greatest(F.col("n_compared"), F.lit(1))
    scale = F.pow(F.lit(float(n)) / compared, F.lit(2.0))
    estimate = F.floor(F.col("near_pairs") * scale * 0.5)
    possible = max(n * (n - 1) / 2.0, 1.0)
    return pairs.select(
        estimate.alias("near_duplicate_pairs"),
        F.round(estimate / F.lit(possible), 6).alias("near_duplicate_fraction"))


def duplicate_report(df: DataFrame, row_id: str, threshold: float = 0.85,
                     sample_rows: Optional[int] = None, exact: Optional[Row] = None) -> DataFrame:
    """Identical rows, estimated near pairs and repeated columns in one row."""
    exact = exact if exact is not None else exact_duplicates(df, row_id).first()
    near = near_duplicate_estimate(df, row_id, threshold, sample_rows).first()
    same = ",".join(sorted(r["column_name"] for r in duplicate_columns(df.drop(row_id)).collect()))
    return tidy_schema_rows(
        df, [(exact["duplicate_rows"], exact["duplicate_fraction"], near["near_duplicate_pairs"],
              near["near_duplicate_fraction"], same)],
        "exact_duplicate_rows long, exact_duplicate_fraction double, near_duplicate_pairs long, "
        "near_duplicate_fraction double, duplicate_columns string")
