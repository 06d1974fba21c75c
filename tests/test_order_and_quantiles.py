import random

import numpy as np
import pytest

from grainsift.operators.impute import fill_directional
from grainsift.operators.materialize import materialize
from grainsift.operators.ordering import with_position
from grainsift.operators.quantiles import exact_quantiles
from grainsift.operators.duplicates import neighbour_pairs

SHAPES = {
    "spread": lambda r: r.uniform(-50, 50),
    "ties": lambda r: float(r.randint(0, 3)),
    "mostly one value": lambda r: 7.0 if r.random() < 0.9 else r.uniform(0, 10),
}


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("limits", [(10**6, 10**5), (0, 50), (0, 1)])
def test_quantiles_equal_numpy(spark, shape, limits):
    rng = random.Random(3)
    values = [SHAPES[shape](rng) for _ in range(3001)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    wanted = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = exact_quantiles(df, {"v": ("v", wanted)}, direct_limit=limits[0], sort_limit=limits[1])["v"]
    assert np.allclose(got, np.quantile(values, wanted), rtol=0, atol=1e-9)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,)], "v double")
    assert exact_quantiles(df, {"v": ("v", [0.5])})["v"] == [None]


@pytest.mark.parametrize("rows_per_bucket", [7, 100, 10_000])
def test_positions_with_hot_leading_key(spark, rows_per_bucket):
    rows = [(0 if i % 3 else i % 11, i) for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = with_position(df, ["a", "b"], rows_per_bucket=rows_per_bucket).collect()
    expected = {r: i for i, r in enumerate(sorted(rows))}
    assert {(r["a"], r["b"]): r["position"] for r in got} == expected


@pytest.mark.parametrize("forward", [True, False])
@pytest.mark.parametrize("partitioned", [True, False])
def test_fill_across_stretches(spark, forward, partitioned):
    rng = random.Random(5)
    rows = [(i, 0 if rng.random() < 0.6 else rng.randint(1, 3), rng.random() if rng.random() < 0.1 else None)
            for i in range(600)]
    df = spark.createDataFrame(rows, "i long, u int, v double").repartition(4)
    got = {r["i"]: r["v"] for r in fill_directional(
        df, ["v"], ["i"], ["u"] if partitioned else [], forward, rows_per_bucket=40).collect()}
    held, expected = {}, {}
    for i, u, v in rows if forward else reversed(rows):
        key = u if partitioned else 0
        held[key] = v if v is not None else held.get(key)
        expected[i] = held[key]
    assert got == expected


def test_fill_needs_an_order(spark):
    with pytest.raises(ValueError):
        fill_directional(spark.createDataFrame([(1,)], "v int"), ["v"], [])


@pytest.mark.parametrize("block", [5, 16, 10_000])
def test_neighbours_across_blocks(spark, block):
    rng = random.Random(2)
    rows = [(i, *[rng.choice("ab") + str(c) for c in range(4)]) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, c string, d string").repartition(3)
    got = neighbour_pairs(df, "row_id", 0.6, rows_per_block=block).first()
    sets = [set(r[1:]) for r in rows]
    expected = sum(1 for i in range(150) for j in range(i + 1, min(i + 5, 150))
                   if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6 and sets[i] != sets[j])
    assert (got["near_pairs"], got["n_compared"]) == (expected, 150)


def test_null_order_keys_spread_over_buckets(spark):
    from grainsift.operators.ordering import with_bucket
    rows = [("s", None, f"text {i:04d}") for i in range(2000)] + [("s", float(i), None) for i in range(2000)]
    df = spark.createDataFrame(rows, "a string, b double, c string")
    sizes = [r["count"] for r in with_bucket(df, ["a", "b", "c"], "bucket", rows_per_bucket=50).groupBy("bucket").count().collect()]
    assert len(sizes) > 50 and max(sizes) < 400
    places = with_position(df, ["a", "b", "c"], rows_per_bucket=50).orderBy("position").collect()
    assert [r["position"] for r in places] == list(range(4000))
    assert [(r["b"] is not None, r["b"] or 0, r["c"] or "") for r in places] == sorted(
        (b is not None, b or 0, c or "") for _, b, c in rows)


@pytest.mark.parametrize("before", [None, "false"])
def test_a_written_table_outlives_its_shuffle_and_keeps_settings(spark, before):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    if before is not None:
        spark.conf.set(key, before)
    try:
        counts = spark.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
        first, second = materialize(counts), materialize(counts)    # the same plan again
        assert spark.conf.get(key, None) == before
        assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) == sorted(map(tuple, counts.collect()))
    finally:
        spark.conf.unset(key)
