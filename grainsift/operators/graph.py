"""Groups of linked rows and greedy choices along pairs, by rounds of joins."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from grainsift.operators.materialize import materialize

#: pairs of one group of linked rows that one task decides
GROUP_EDGES = 2_100_000


def components(pairs: DataFrame) -> DataFrame:
    """Connected groups of a pair list (``id_a``, ``id_b``) as (``id``, ``cluster_id``).

    Every id takes the smallest label among its neighbours and then the label of its label, so
    the number of rounds grows with the logarithm of the longest chain. Each round is written down.
    """
    both = pairs.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    edges = materialize(both.union(both.select("v", "u")).distinct())
    labels = materialize(edges.groupBy(F.col("u").alias("id")).agg(F.least(F.min("u"), F.min("v")).alias("label")))
    while True:
        near = (edges.join(labels, edges["v"] == labels["id"]).groupBy(F.col("u").alias("id"))
                .agg(F.min("label").alias("near")))
        hop = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        step = materialize(
            labels.join(near, "id").join(hop, "label", "left")
            .select("id", F.col("label").alias("old"),
                    F.least("label", "near", F.coalesce("far", "label")).alias("label")))
        changed = step.filter("old <> label").limit(1).count()
        labels = step.select("id", "label")
        if not changed:
            return labels.select("id", F.col("label").alias("cluster_id"))


def greedy_drop(pairs: DataFrame) -> DataFrame:
    """Ids to drop when rows are taken in id order and every kept row drops its later partners.

    Up to ``GROUP_EDGES`` pairs are decided in one pass. The choice never crosses a group of linked rows, so groups of no
    more pairs are decided in one grouped pass. Larger ones are decided in rounds, which settle a layer of the order each.
    """
    edges = materialize(pairs.select(F.least("id_a", "id_b").alias("lo"), F.greatest("id_a", "id_b").alias("hi"))
                        .filter("lo <> hi").distinct())
    id_schema = f"id {edges.schema['hi'].dataType.simpleString()}"
    if edges.count() <= GROUP_EDGES:
        return edges.groupBy().applyInPandas(_greedy, id_schema)
    labels = components(edges.toDF("id_a", "id_b"))
    named = materialize(edges.join(labels.withColumnRenamed("id", "lo"), "lo"))
    sizes = materialize(named.groupBy("cluster_id").agg(F.count("*").alias("n")))
    large = sizes.filter(F.col("n") > GROUP_EDGES).select("cluster_id")
    small = named.join(large, "cluster_id", "left_anti")
    dropped = small.groupBy("cluster_id").applyInPandas(_greedy, id_schema)
    if not large.limit(1).count():
        return dropped
    return dropped.union(_greedy_rounds(materialize(named.join(large, "cluster_id", "left_semi").select("lo", "hi"))))


def _greedy(group: pd.DataFrame) -> pd.DataFrame:
    dropped = set()
    ordered = group.sort_values(["lo", "hi"])
    for lo, hi in zip(ordered["lo"], ordered["hi"]):
        if lo not in dropped:
            dropped.add(hi)
    return pd.DataFrame({"id": sorted(dropped)})


def _greedy_rounds(edges: DataFrame) -> DataFrame:
    """A row is decided once all its earlier partners are: kept if all of them were dropped, dropped
    as soon as one was kept. Each round is written down."""
    ids = edges.select(F.col("lo").alias("id")).union(edges.select("hi")).distinct()
    dropped = None
    open_ids, open_edges = materialize(ids), edges
    while True:
        waiting = open_edges.select(F.col("hi").alias("id")).distinct()
        kept = open_ids.join(waiting, "id", "left_anti")
        lost = materialize(open_edges.join(kept.select(F.col("id").alias("lo")), "lo", "left_semi")
                           .select(F.col("hi").alias("id")).distinct())
        dropped = lost if dropped is None else dropped.union(lost)
        settled = kept.union(lost)
        open_ids = materialize(open_ids.join(settled, "id", "left_anti"))
        if not open_ids.limit(1).count():
            return dropped
        # only edges from undecided rows still hold anything back
        open_edges = materialize(open_edges.join(open_ids.select(F.col("id").alias("lo")), "lo", "left_semi")
                                 .join(open_ids.select(F.col("id").alias("hi")), "hi", "left_semi"))


def duplicate_clusters(pairs: DataFrame) -> DataFrame:
    """Groups of linked rows from near-duplicate pairs: size in rows and sets, links between sets."""
    pairs = materialize(pairs)
    labels = components(pairs)
    sets = (pairs.select(F.col("id_a").alias("id"), F.col("copies_a").alias("copies"))
            .union(pairs.select("id_b", "copies_b")).distinct())
    sizes = sets.join(labels, "id").groupBy("cluster_id").agg(
        F.sum("copies").alias("n_rows"), F.count("*").alias("n_sets"))
    links = (pairs.filter("id_a <> id_b").join(labels, F.col("id_a") == F.col("id"))
             .groupBy("cluster_id").agg(F.count("*").alias("n_links")))
    return sizes.join(links, "cluster_id", "left").withColumn(
        "n_links", F.coalesce("n_links", F.lit(0).cast("long")))
