"""Isolation forest for one number column.

Every tree sees a small hashed sample, as the method asks for. In one dimension a tree cuts the
number line into pieces with one depth each, so a tree is two short arrays and a whole forest is a
step function; every row of the table is scored against it.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from grainsift.functions import fixed_values as fixed
from grainsift.functions.columns import as_number
from grainsift.operators.quantiles import exact_quantiles

TREES = 100
SAMPLE = 256


def _mean_depth(n: np.ndarray | int) -> float:
    """Mean depth of an unsuccessful search among ``n`` values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator) -> tuple[list[float], list[float]]:
    """Cut points in ascending order and the depth of each piece between them."""
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    cuts: list[float] = []
    depths: list[float] = []

    def split(part: np.ndarray, depth: int) -> None:
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            depths.append(depth + _mean_depth(len(part)))
            return
        cut = rng.uniform(part[0], part[-1])
        at = np.searchsorted(part, cut, side="right")
        split(part[:at], depth + 1)
        cuts.append(float(cut))
        split(part[at:], depth + 1)

    split(np.sort(values), 0)
    return cuts, depths


def tree_samples(df: DataFrame, column: str, row_id: str, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """(tree, value) rows, ``sample`` hashed values per tree.

    The first ``trees * sample`` rows in hash order are the pool (all rows of a shorter column); every tree
    draws from it on its own. So the number of rows is fixed by the forest, not the table.
    """
    values = df.select(F.col(row_id).alias("_id"), as_number(df, column).alias("value")).filter("value IS NOT NULL")
    size = trees * sample
    pool = values.orderBy(F.xxhash64("_id", F.lit(fixed.FOREST_SEED)), "_id").limit(size)
    n = pool.count()
    drawn = pool.select("*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    chance = min(1.0, 2.0 * sample / max(n, 1))
    drawn = drawn.filter(F.pmod(F.xxhash64("_id", "tree"), F.lit(1_000_000)) < int(chance * 1_000_000))
    order = Window.partitionBy("tree").orderBy(F.xxhash64("tree", "_id"), "_id")
    return drawn.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample).select("tree", "value")


def isolation_scores(df: DataFrame, column: str, row_id: str, trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Anomaly score (0 to 1) of every present value of the column."""
    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        values = pdf["value"].to_numpy()
        cuts, depths = _grow(values, np.random.default_rng([fixed.FOREST_SEED, tree]))
        return pd.DataFrame({"tree": [tree], "n": [len(values)], "cuts": [cuts], "depths": [depths]})

    # at most ``trees`` rows with at most ``sample`` cuts each
    grown = (tree_samples(df, column, row_id, trees, sample).groupBy("tree")
             .applyInPandas(grow, "tree int, n int, cuts array<double>, depths array<double>").orderBy("tree").collect())
    forest = [(np.array(t["cuts"]), np.array(t["depths"])) for t in grown]
    scale = _mean_depth(max((t["n"] for t in grown), default=2)) or 1.0
    edges = np.unique(np.concatenate([c for c, _ in forest])) if forest else np.array([])
    inside = np.concatenate([edges, [np.inf]])
    total = np.zeros(len(edges) + 1)
    for cuts, depths in forest:
        total += depths[np.searchsorted(cuts, inside, side="left")]
    steps = np.power(2.0, -total / max(len(forest), 1) / scale)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(steps[np.searchsorted(edges, values.to_numpy(), side="left")])

    present = df.select(F.col(row_id), as_number(df, column).alias("value")).filter("value IS NOT NULL")
    return present.withColumn("score", score("value"))


def outliers_isolation_forest(df: DataFrame, column: str, row_id: str, contamination: float = fixed.FOREST_CONTAMINATION,
                              trees: int = TREES, sample: int = SAMPLE) -> DataFrame:
    """Rows whose score lies above the contamination quantile."""
    scored = isolation_scores(df, column, row_id, trees, sample)
    cut = exact_quantiles(scored, {"score": ("score", [1.0 - contamination])})["score"][0]
    return scored.filter(F.col("score") > F.lit(cut))
