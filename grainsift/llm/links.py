"""Groups of linked nodes from an edge list that need not fit anywhere at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from grainsift.operators.materialize import materialize


def _mark(links: DataFrame) -> tuple:
    """Number of links and a sum over their hashes: unequal for different sets of links."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def component_labels(edges: DataFrame) -> DataFrame:
    """Smallest reachable id of every id in edges (``a``, ``b``): rows (``id``, ``label``).

    Large-star and small-star rounds: every id links its larger neighbours to its smallest neighbour,
    then its smaller ones, until nothing changes; the rounds grow with the logarithm of the longest
    chain, and the neighbour's edges stay as rows, never as a list. Each round is written down.
    """
    links = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                        .distinct())
    mark = _mark(links)
    while True:
        both = links.union(links.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        links = materialize(small.filter("u <> v").distinct())
        mark, before = _mark(links), mark
        if mark == before:
            return links.select(F.col("u").alias("id"), F.col("v").alias("label")).union(
                links.select("v", "v").distinct())


def near_labels(edges: DataFrame) -> DataFrame:
    """A label of every id in edges such that ids with one label are connected: the smallest neighbour's smallest
    neighbour. Cheaper than components, which may come under several labels."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    low = materialize(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("m")))
    return low.join(low.select(F.col("id").alias("m"), F.col("m").alias("label")), "m").select("id", "label")
