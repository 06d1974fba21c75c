"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative kept.

Equal vectors of one label are one node. Centroids come from a bounded sample; every node has the cell
of its nearest centroid as home. A node also visits a cell c when a vector with cosine of at least the threshold
could have its home there: vectors that close differ by at most s = sqrt(2 - 2 t) in length, so this
needs x.(home - c) <= s |home - c|. With that, cells lose no pair. Cells are cut into blocks, and
the products of two blocks are one task's work; a task returns link counts and a tree of each group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from grainsift.llm.links import component_labels
from grainsift.operators.materialize import materialize

COSINE = 0.98
#: vectors that the centroids are fitted on, at most: the smallest by a hash
SAMPLE_VECTORS = 16_384
#: nodes of the largest label per cell, on average, and the most cells
CELL_ROWS = 2_000
MAX_CELLS = 512
#: nodes of one block
BLOCK = 1_024
ITERATIONS = 10


def _vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Unit vectors as bytes of doubles with a digest of label and vector; nothing for vectors without direction."""
    for batch in batches:
        nodes, units, sizes = [], [], []
        for label, vector in zip(batch["label"], batch["vector"]):
            x = None
            if vector is not None and label is not None and not (isinstance(label, float) and np.isnan(label)):
                x = np.array([np.nan if v is None else v for v in vector], dtype=np.float64)
                if len(x) and np.isfinite(x).all() and (peak := np.abs(x).max()) > 0:
                    x = x / peak                       # keeps squares of huge and tiny components in range
                    x = x / np.sqrt(x @ x)
                else:
                    x = None
            nodes.append(None if x is None else hashlib.blake2b(
                repr(label).encode() + b"|" + np.asarray(vector, np.float64).tobytes(), digest_size=16).digest())
            units.append(None if x is None else x.tobytes())
            sizes.append(0 if x is None else len(x))
        yield pd.DataFrame({"id": batch["id"], "label": batch["name"], "node": nodes, "unit": units, "size": sizes})


def fit_centroids(units: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Unit centroids of spherical k-means; an empty cell keeps its centroid."""
    rng = np.random.Generator(np.random.PCG64(seed))
    cells = max(1, min(cells, len(units)))
    centroids = units[rng.choice(len(units), cells, replace=False)]
    for _ in range(ITERATIONS):
        home = (units @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, home, units)
        norms = np.linalg.norm(sums, axis=1)
        moved = norms > 1e-12
        centroids[moved] = sums[moved] / norms[moved, None]
    return centroids


def visited_cells(units: np.ndarray, centroids: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Home of each vector, and a matrix of the cells after its home that it must visit."""
    near = units @ centroids.T
    home = near.argmax(axis=1)
    apart = np.linalg.norm(centroids[:, None, :] - centroids[None, :, :], axis=2)
    reach = np.sqrt(max(0.0, 2 - 2 * cosine)) * apart[home] + 1e-9
    visits = near[np.arange(len(units)), home][:, None] - near <= reach
    visits &= np.arange(len(centroids))[None, :] > home[:, None]
    return home, visits


def _placed(shared, cosine: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                centroids = shared.value.get(size)
                units = np.frombuffer(b"".join(part["unit"]), np.float64).reshape(len(part), -1)
                if centroids is None:                  # no vector of this length was in the sample
                    home, visits = np.zeros(len(part), int), np.zeros((len(part), 1), bool)
                else:
                    home, visits = visited_cells(units, centroids, cosine)
                row, cell = np.nonzero(visits)
                for rows, cells, at_home in ((np.arange(len(part)), home, True), (row, cell, False)):
                    if len(rows):
                        yield part.iloc[rows].assign(cell=cells, home=at_home)
    return run


def _linked(cosine: float):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["own"] == group["block_a"]]
        second = first if group["block_a"].iloc[0] == group["block_b"].iloc[0] else group[group["own"] == group["block_b"]]
        empty = pd.DataFrame({"node": pd.Series(dtype=object), "weight": pd.Series(dtype="int64"),
                              "other": pd.Series(dtype=object)})
        if not len(first) or not len(second):
            return empty
        a, b = (np.frombuffer(b"".join(x["unit"]), np.float64).reshape(len(x), -1) for x in (first, second))
        near = a @ b.T >= cosine
        if second is first:
            np.fill_diagonal(near, False)
        if not near.any():
            return empty
        names = np.concatenate([first["node"].to_numpy(), second["node"].to_numpy()])
        rows, cols = near.any(axis=1), near.any(axis=0)
        near, a_at, b_at = near[rows][:, cols], np.flatnonzero(rows), np.flatnonzero(cols)
        out = [pd.DataFrame({"node": first["node"].to_numpy()[a_at],
                             "weight": near @ second["n_copies"].to_numpy()[b_at], "other": None})]
        if second is not first:
            out.append(pd.DataFrame({"node": second["node"].to_numpy()[b_at],
                                     "weight": near.T @ first["n_copies"].to_numpy()[a_at], "other": None}))
        # smallest position reachable within the block pair
        left, right = a_at.copy(), b_at + (0 if second is first else len(first))
        while True:
            new_left = np.minimum(left, np.where(near, right[None, :], 1 << 40).min(axis=1))
            new_right = np.minimum(right, np.where(near, new_left[:, None], 1 << 40).min(axis=0))
            if (new_left == left).all() and (new_right == right).all():
                break
            left, right = new_left, new_right
        ends = np.concatenate([left, right])
        starts = np.concatenate([a_at, b_at + (0 if second is first else len(first))])
        tree = np.unique(np.stack([starts, ends], axis=1)[starts != ends], axis=0)
        out.append(pd.DataFrame({"node": names[tree[:, 0]], "weight": 0, "other": names[tree[:, 1]]}))
        return pd.concat(out)
    return run


def near_vectors(df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """One row per row of ``df``: ``vec_id``, ``n_links``, ``component_id``, ``kept``.

    Vectors are linked when their labels are equal and their cosine in double precision is at least
    ``cosine``; ``n_links`` counts other rows linked directly, copies included, and ``component_id`` is the
    smallest id reachable. Rows with a null label, and vectors that are null, empty, zero or hold null or
    non-finite components, link with nothing; so do vectors of different length. Repeated rows are
    copies of each other. A null id is never the smallest and never kept unless its component has null
    ids only (then the component is null). An empty table gives no rows; other columns are not looked at.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector"),
                     F.col(label_col).cast("string").alias("name"))
    facts = materialize(rows.mapInPandas(_vectors, f"id {id_type}, label string, node binary, unit binary, size int"))
    found = facts.filter("node is not null")
    nodes = materialize(found.groupBy("label", "node").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n_copies"), F.max("unit").alias("unit"), F.max("size").alias("size")))

    # centroids per vector length, from a sample bounded by its number of vectors
    sizes = nodes.groupBy("size", "label").agg(F.count("*").alias("n")).groupBy("size").agg(
        F.sum("n").alias("n"), F.max("n").alias("largest")).orderBy(F.desc("n")).limit(16).collect()
    centroids = {}
    for size, n, largest in sizes:
        cells = min(MAX_CELLS, -(-largest // CELL_ROWS))
        share = min(1.0, 1.2 * SAMPLE_VECTORS / n)
        key = F.pmod(F.xxhash64("node"), F.lit(1 << 30))
        sample = (nodes.filter((F.col("size") == size) & (key < int(share * (1 << 30)))).orderBy(key)
                  .limit(SAMPLE_VECTORS).select("unit").toPandas()) if cells > 1 else []
        if len(sample):
            units = np.frombuffer(b"".join(sample["unit"]), np.float64).reshape(len(sample), -1)
            centroids[size] = fit_centroids(units, cells)
    shared = spark.sparkContext.broadcast(centroids)

    placed = materialize(nodes.select("label", "node", "unit", "size", "n_copies").mapInPandas(
        _placed(shared, cosine), "label string, node binary, unit binary, size int, n_copies long, cell int, home boolean"))
    place = ["label", "size", "cell"]
    blocks = placed.groupBy(*place).agg(
        F.ceil(F.sum(F.col("home").cast("int")) / BLOCK).alias("homes"),
        F.ceil(F.sum((~F.col("home")).cast("int")) / BLOCK).alias("guests"))
    last = F.col("homes") + F.when(F.col("home"), F.col("guests")).otherwise(0) - 1
    dealt = (placed.join(blocks, place).filter("homes > 0")
             .withColumn("own", F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("homes"))).otherwise(
                 F.col("homes") + F.pmod(F.xxhash64("node"), F.greatest("guests", F.lit(1)))))
             .select(*place, "node", "unit", "n_copies", "own",
                     F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other"))
             .withColumns({"block_a": F.least("own", "other"), "block_b": F.greatest("own", "other")}).drop("other"))
    found_links = materialize(dealt.groupBy(*place, "block_a", "block_b").applyInPandas(
        _linked(cosine), "node binary, weight long, other binary"))
    weights = found_links.groupBy("node").agg(F.sum("weight").alias("others"))
    edges = found_links.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    labels = component_labels(edges)
    grouped = (nodes.select("node", "first_id", "n_copies").join(weights, "node", "left")
               .join(labels.withColumnRenamed("id", "node"), "node", "left")
               .withColumn("group", F.coalesce(F.col("label"), F.col("node"))))
    least = grouped.groupBy("group").agg(F.min("first_id").alias("component_id"))
    grouped = grouped.join(least, "group").select(
        "node", "component_id", (F.coalesce("others", F.lit(0)) + F.col("n_copies") - 1).alias("n_links"))
    return (facts.select(F.col("id").alias("vec_id"), "node").join(grouped, "node", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.when(F.col("node").isNull(), F.col("vec_id").cast("long"))
                    .otherwise(F.col("component_id").cast("long")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
