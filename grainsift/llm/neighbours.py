"""Nearest neighbours of a query set: a block matrix join of int8 tiles with error bounds, and heaps.

Equal vectors are one node with its smallest ids. Query nodes and all nodes are cut into blocks, and a task
gets one block of each. It rounds every vector to int8 codes with a scale of its own and multiplies the codes; the sums are
whole numbers that single precision holds exactly. As both vectors are within known distances of their rounded forms, the
product gives a lower and an upper bound of the true distance. Pairs whose lower bound exceeds the k-th smallest upper
bound, or the k-th nearest found so far, cannot be among the nearest; the others are computed again in double precision
and go through a heap per query. A first round over one candidate block in 32 bounds what the second has to send. No pair
is lost, so the answer is the exact one.

The number of tiles is that of query blocks times that of candidate blocks: the work grows with their product.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from grainsift.llm.common import small
from grainsift.llm.vectors import matrices
from grainsift.operators.materialize import materialize

NEIGHBOURS = 10
#: doubles of one block's vectors, at most; blocks of small tables are smaller, so that there are PARTS of them
BLOCK_BYTES = 16 << 20
LEAST_ROWS = 1_024
PARTS = 48
#: one candidate block in so many is searched first
SEED = 32
#: queries and candidates whose products are taken at once, and pairs computed again at once
QUERY_STEP, CANDIDATE_STEP, PAIR_STEP = 1_024, 2_048, 1 << 18
#: components whose int8 products add up exactly in single precision: 127 * 127 * 1024 < 2 ** 24
EXACT_SUM = 1_024


def _facts(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(batch.column("vector")):
                moving = x.any(axis=1)
                rows, x = rows[moving], x[moving] + 0.0              # no negative zero
                nodes = [hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in x]
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("asks"), pa.array(nodes, pa.binary()),
                     pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                     pa.array(np.full(len(x), x.shape[1], np.int32))], ["id", "asks", "node", "vector", "size"])
    return run


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes (int8), a scale per row, and the distance of every row from its rounded form."""
    with np.errstate(over="ignore", under="ignore"):
        scale = np.abs(x).max(axis=1) / 127
        codes = np.rint(x / np.where(scale > 0, scale, 1)[:, None])
        error = np.sqrt(((x - codes * scale[:, None]) ** 2).sum(axis=1)) * (1 + 1e-9)
    return codes.astype(np.int8), scale, error


def tile_bounds(q: tuple, c: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances between rows given as codes, scale and error."""
    product = 0.0
    for at in range(0, q[0].shape[1], EXACT_SUM):
        part = q[0][:, at:at + EXACT_SUM].astype(np.float32) @ c[0][:, at:at + EXACT_SUM].astype(np.float32).T
        product = product + part.astype(np.float64)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        squares = [(codes.astype(np.float64) ** 2).sum(axis=1) * scale ** 2 for codes, scale, _ in (q, c)]
        both = squares[0][:, None] + squares[1][None, :]
        product *= -2 * q[1][:, None] * c[1][None, :]
        product += both
        both *= 1e-13                                               # what rounding can hide in the difference
        apart = q[2][:, None] + c[2][None, :]
        lower = np.sqrt(np.maximum(product - both, 0)) * (1 - 1e-12) - apart - 1e-150
        upper = np.sqrt(np.maximum(product, 0) + both) * (1 + 1e-12) + apart + 1e-150
    lower[~np.isfinite(lower)] = -np.inf                              # beyond doubles: left to the distance itself
    upper[~np.isfinite(upper)] = np.inf
    return lower, upper


def _distances(q: np.ndarray, c: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs, squares added component by component; ``q`` and ``c`` hold a row per component."""
    total = np.zeros(len(rows))
    with np.errstate(over="ignore", under="ignore"):
        for a, b in zip(q, c):
            total += np.square(a[rows] - b[cols])
    return np.sqrt(total)


def _k_least(rows: np.ndarray, cols: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest (score, column) of every row."""
    order = np.lexsort((cols, scores, rows))
    ranked = rows[order]
    starts = np.searchsorted(ranked, ranked, "left")
    return order[np.arange(len(order)) - starts < k]


def tile_neighbours(q: np.ndarray, c: np.ndarray, k: int, bound: np.ndarray) -> list[list[tuple[float, int]]]:
    """Per query the at most ``k`` nearest candidates within ``bound`` as (distance, position), nearest first."""
    heaps: list[list[tuple[float, int]]] = [[] for _ in range(len(q))]
    worst = bound.copy()
    held = quantised(c)
    by_component = np.ascontiguousarray(c.T)
    for i in range(0, len(q), QUERY_STEP):
        asking = q[i:i + QUERY_STEP]
        codes, own, limit = quantised(asking), np.ascontiguousarray(asking.T), worst[i:i + QUERY_STEP]
        for j in range(0, len(c), CANDIDATE_STEP):
            lower, upper = tile_bounds(codes, tuple(x[j:j + CANDIDATE_STEP] for x in held))
            if upper.shape[1] >= k:
                np.minimum(limit, np.partition(upper, k - 1, axis=1)[:, k - 1], out=limit)
            rows, cols = np.nonzero(lower <= limit[:, None])
            for at in range(0, len(rows), PAIR_STEP):
                r, p = rows[at:at + PAIR_STEP], cols[at:at + PAIR_STEP] + j
                scores = _distances(own, by_component, r, p)
                near = np.flatnonzero(scores <= limit[r])
                near = near[_k_least(r[near], p[near], scores[near], k)]
                for row, position, score in zip(r[near].tolist(), p[near].tolist(), scores[near].tolist()):
                    heap, entry = heaps[i + row], (-score, -position)
                    if len(heap) < k:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
                    if len(heap) == k:
                        limit[row] = min(limit[row], -heap[0][0])
    return [[(-s, -p) for s, p in sorted(heap, reverse=True)] for heap in heaps]


def _tile(k: int, kind: str):
    def stacked(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), kind).reshape(len(column), -1).astype(np.float64)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        asking, held = group[asks], group[~asks].sort_values(["first_id", "node"])
        found = []
        if len(asking) and len(held):
            bound = asking["bound"].fillna(np.inf).to_numpy(np.float64)
            found = tile_neighbours(stacked(asking["vector"]), stacked(held["vector"]), k, bound)
        rows = [(i, p, s) for i, near in enumerate(found) for s, p in near]
        i, p, s = map(list, zip(*rows)) if rows else ([], [], [])
        return pd.DataFrame({"q": asking["node"].to_numpy()[i], "c": held["node"].to_numpy()[p],
                             "first_id": held["first_id"].to_numpy()[p], "score": np.array(s, np.float64)})
    return run


def _least(found: DataFrame, k: int, *order: str) -> DataFrame:
    """The k first rows of every query node."""
    place = Window.partitionBy("q").orderBy(*order)
    return found.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= k).drop("at")


def nearest(df: DataFrame, asks: Column, k: int = NEIGHBOURS, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest other rows of every row for which ``asks`` holds: ``query_id``, ``rank`` from 1, ``vec_id``, ``score``.

    Nearness is the Euclidean distance in double precision (``score``, squares added in component order), ties go to the
    smaller id. Vectors that are null, empty, zero or hold null or non-finite components, and rows without id, take no part.
    Vectors of different length are no neighbours. A repeated row counts once; rows that share an id but not the vector are
    candidates of their own, and of those among the queries the one of the smallest digest asks. A query with fewer than
    ``k`` candidates gets them all; distances beyond doubles are infinite. An empty table gives no rows; other columns are
    not looked at.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    kind = "<f4" if df.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    rows = df.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.coalesce(asks, F.lit(False)).alias("asks"), F.col(vector_col).alias("vector"))
    facts = materialize(rows.mapInArrow(
        _facts(kind), f"id {id_type}, asks boolean, node binary, vector binary, size int"))
    by_node = Window.partitionBy("node").orderBy("id")
    ids = (facts.select("node", "id").distinct().withColumn("at", F.row_number().over(by_node)).filter(F.col("at") <= k + 1)
           .groupBy("node").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    nodes = materialize(facts.groupBy("node").agg(F.min("vector").alias("vector"), F.min("size").alias("size"))
                        .join(ids, "node"))
    queries = materialize(facts.filter("asks").groupBy("id").agg(F.min("node").alias("node")))
    asking = nodes.join(queries.select("node").distinct(), "node", "left_semi").select("node", "size", "vector")

    # blocks per vector length
    most = F.greatest(F.lit(1), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("size"))))
    grid = materialize(nodes.groupBy("size").agg(F.count("*").alias("held"))
                       .join(asking.groupBy("size").agg(F.count("*").alias("asked")), "size").select(
        "size", F.ceil(F.col("asked") / most).alias("q_blocks"),
        F.ceil(F.col("held") / F.least(most, F.greatest(F.lit(LEAST_ROWS), F.ceil(F.col("held") / PARTS)))).alias("c_blocks")))
    grid = small(grid, grid.count())
    seeds = F.col("cb") % SEED == 0
    held = (nodes.join(grid, "size").withColumn("cb", F.pmod(F.xxhash64("node"), F.col("c_blocks")))
            .withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q_blocks") - 1)))
            .select("size", "qb", "cb", "node", "vector", F.col("ids")[0].alias("first_id"), F.lit(False).alias("asks"),
                    F.lit(None).cast("double").alias("bound")))
    dealt = (asking.join(grid, "size").withColumn("qb", F.pmod(F.xxhash64("node", F.lit(1)), F.col("q_blocks")))
             .withColumn("cb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("c_blocks") - 1)))
             .select("size", "qb", "cb", "node", "vector", F.lit(None).cast(id_type).alias("first_id"),
                     F.lit(True).alias("asks")))

    def searched(candidates: DataFrame, questions: DataFrame) -> DataFrame:
        return candidates.unionByName(questions).groupBy("size", "qb", "cb").applyInPandas(
            _tile(k + 1, kind), f"q binary, c binary, first_id {id_type}, score double")

    first = materialize(_least(searched(held.filter(seeds), dealt.filter(seeds).withColumn("bound", F.lit(None).cast("double"))),
                               k + 1, "score", "first_id"))
    bounds = first.groupBy("q").agg(F.count("*").alias("n"), F.max("score").alias("bound")).filter(F.col("n") > k).select(
        F.col("q").alias("node"), "bound")
    second = searched(held.filter(~seeds), dealt.filter(~seeds).join(bounds, "node", "left"))
    found = _least(first.union(second), k + 1, "score", "first_id")

    # rows of the nodes found, and the answer of every query node for all rows that ask with it
    named = (found.select("q", F.col("c").alias("node"), "score").join(nodes.select("node", "ids"), "node")
             .select("q", "score", F.explode("ids").alias("id")))
    best = _least(named, k + 1, "score", "id").groupBy(F.col("q").alias("node")).agg(
        F.sort_array(F.collect_list(F.struct("score", "id"))).alias("near"))
    return (queries.select(F.col("id").alias("query_id"), "node").join(best, "node")
            .withColumn("near", F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k))
            .select("query_id", F.posexplode("near").alias("rank", "found"))
            .select("query_id", (F.col("rank") + 1).alias("rank"), F.col("found.id").alias("vec_id"), "found.score"))
