"""Sharding and mixing."""

import zlib
from collections import Counter, defaultdict
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainsift.llm import mixing, sharding


def _docs(spark, n=997, hot=0.4):
    rows = [(i, "w " * (1 + (i * 7919) % 60), None if i % 31 == 0 else f"s{0 if i < n * hot else i % 9}") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_shards_are_even_gapless_and_the_same_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "STRETCH_ROWS", 50)
    docs = _docs(spark)
    got = sharding.shard_rows(docs, 16).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(r["text"].encode()) + 1 and r["text_crc32"] == zlib.crc32(r["text"].encode())
        assert r["law"] == "rows" and r["grown_shard"] is None
    assert sorted(slots) == list(range(16))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_rows(docs.repartition(7, "text").orderBy(F.desc("text")), 16)
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in got} == {tuple(r) for r in again.select("doc_id", "shard", "slot").collect()}


def test_shards_of_odd_rows(spark, edge_docs):
    got = sharding.shard_rows(edge_docs, 4).collect()
    assert len(got) == 12 and Counter(r["shard"] for r in got) == {0: 3, 1: 3, 2: 3, 3: 3}
    assert {r["size"] for r in got if r["text"] is None} == {1} and {r["text_crc32"] for r in got if not r["text"]} == {0}
    assert sharding.shard_rows(edge_docs.limit(0), 4).count() == 0


def _targets(sizes):
    """The excess shared again by weight until no source is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        open_ = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / max(sum(weight[s] for s in open_), 1)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            return {s: fixed.get(s, weight[s] * level) for s in names}
        fixed |= {s: 3 * sizes[s] for s in over}


def _plan(docs, **options):
    return mixing.mix_plan(mixing.with_facts(docs), **options)


@pytest.mark.parametrize("block_rows", [7, 100_000])
def test_mix_meets_targets(spark, block_rows):
    docs = _docs(spark).unionByName(spark.createDataFrame([(5000 + i, "x y z", "tiny") for i in range(4)],
                                                          "doc_id long, text string, source string"))
    got = _plan(docs, block_rows=block_rows).collect()
    assert len(got) == docs.count()
    sizes, taken = Counter(), Counter()
    for r in got:
        assert r["size"] == len(r["text"].split()) and 0 <= r["taken"] <= 3 * r["size"]
        assert r["taken"] == r["size"] * len(r["shards"]) and all(0 <= s < 16 for s in r["shards"])
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
    wanted = _targets(sizes)
    assert wanted["tiny"] == 36
    assert sum(wanted.values()) == pytest.approx(sum(sizes.values()))
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(wanted[r["source"]])
    for source in sizes:
        assert 0 <= wanted[source] - taken[source] <= 60


def test_mix_is_the_same_again_and_splits_blocks_evenly(spark):
    docs = _docs(spark, 2000)
    one = {(r["doc_id"], r["copies"], tuple(r["shards"])) for r in _plan(docs, block_rows=1).collect()}
    two = {(r["doc_id"], r["copies"], tuple(r["shards"])) for r in _plan(docs.repartition(5, "text"), block_rows=1).collect()}
    assert one == two
    rows = Counter(s for _, _, shards in one for s in shards)
    assert len(rows) == 16 and max(rows.values()) < 1.6 * min(rows.values())
    # each shard has every large source's blocks near its share
    hot = Counter(s for i, _, shards in one if i < 800 and i % 31 for s in shards)
    assert len(hot) == 16 and max(hot.values()) < 4 * min(hot.values())


@pytest.mark.parametrize("total, marked, drawn", [(20, 7, 10), (9, 9, 4), (12, 0, 5), (30, 25, 28), (300, 40, 150), (1, 1, 0)])
def test_hypergeometric_draws_follow_the_law(spark, total, marked, drawn):
    grid = 20_000
    n, k, m = (F.lit(v).cast("long") for v in (total, marked, drawn))
    got = spark.range(grid).select(mixing.hypergeometric(n, k, m, (F.col("id") + 0.5) / grid).alias("x"))
    counts = {r["x"]: r["count"] for r in got.groupBy("x").count().collect()}
    for x in range(marked + 1):
        law = comb(marked, x) * comb(total - marked, drawn - x) / comb(total, drawn) if x <= drawn else 0
        assert abs(counts.pop(x, 0) / grid - law) < 2 / grid
    assert not counts


def test_split_tree_partitions_places(spark):
    for sizes, shards in (([0, 3], 4), ([1], 4), ([], 4), ([600, 300, 7, 93], 16), ([20, 17], 5), ([8], 1)):
        quotas = spark.createDataFrame(list(enumerate(sizes)), "number int, n long")
        got = {r["number"]: r["ends"] for r in mixing.split_tree(quotas, 3, shards).collect()}
        assert set(got) == set(range(len(sizes)))
        for number, ends in got.items():
            assert len(ends) == shards and ends == sorted(ends) and ends[-1] == sizes[number]
        held = np.array([np.diff([0, *ends]) for ends in got.values()]).reshape(len(sizes), shards)
        assert all(abs(held[:, s].sum() - sum(sizes) / shards) < 2 for s in range(shards))


def test_split_tree_follows_the_multivariate_law(spark):
    """Over many seeds, the first shard of four holds of each source what a random set of places would."""
    sizes, shards, seeds = [40, 30, 10], 4, 30
    quotas = spark.createDataFrame(list(enumerate(sizes)), "number int, n long")
    trees = [mixing.split_tree(quotas, seed, shards) for seed in range(seeds)]
    rows = [{r["number"]: np.diff([0, *r["ends"]]) for r in tree.collect()} for tree in trees]
    for number, n in enumerate(sizes):
        held = np.array([r[number] for r in rows])
        share, total = n / sum(sizes), sum(sizes)
        m = total // shards
        spread = m * share * (1 - share) * (total - m) / (total - 1)
        assert abs(held.mean(0) - m * share).max() < 4 * (spread / seeds) ** 0.5
        assert 0.6 * spread < held.var(0).mean() < 1.5 * spread


def test_small_sources_are_in_every_shard_and_shards_come_in_parts(spark, monkeypatch):
    docs = _docs(spark, 3000)
    got = _plan(docs).collect()
    shards, drawn = defaultdict(set), Counter()
    for r in got:
        shards[r["source"]] |= set(r["shards"])
        drawn[r["source"]] += len(r["shards"])
    assert any(n > 150 for n in drawn.values())
    assert all(len(shards[s]) == 16 for s, n in drawn.items() if n > 150)
    monkeypatch.setattr(mixing, "PART_BYTES", 2_000)
    mixed = mixing.mix(docs)
    assert mixed.rdd.getNumPartitions() > 16
    assert sorted(r["doc_id"] for r in mixed.collect()) == sorted(r["doc_id"] for r in got for _ in r["shards"])


def test_mix_of_odd_rows(spark, edge_docs):
    mixed = mixing.mix(edge_docs)
    assert mixed.columns == edge_docs.columns and mixed.count() > 0
    assert mixing.mix(edge_docs.limit(0)).count() == 0
    plan = _plan(edge_docs.select("doc_id", "text", "source"))
    assert plan.count() == 12
    assert all(r["taken"] <= 3 * r["size"] for r in plan.collect())
    wordless = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in _plan(wordless).collect()] == [0, 0]
