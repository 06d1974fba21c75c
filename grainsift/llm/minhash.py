"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification.

1. One pass over the texts makes, per row, a digest of the word sequence, the size of the shingle set and
   its MinHash signature. Rows with one digest are copies and become one node, so groups of copies of
   any size cost one node.
2. Nodes that agree in a band of signature values are candidates. In each band bucket, every node is
   first paired with one head only.
3. Signatures of a pair are compared batch by batch. With m of n values equal and a uniform prior, the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair goes when the probability of reaching
   the threshold is below the miss probability.
4. Pairs that stay are verified on their full shingle sets, and give groups.
5. Buckets that still hold several groups are compared in blocks across groups: the sequential test leaves
   pairs, and these are verified on full sets, most equal values first, unless they were joined meanwhile. So a
   family of near copies costs rows in proportion to its nodes, and no link between groups is lost.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from grainsift.llm.common import free_name, small
from grainsift.llm.links import component_labels, near_labels
from grainsift.llm.tokens import mix, sequence_hash, word_slices
from grainsift.operators.materialize import materialize

BANDS = 32
BAND_ROWS = 5
HASHES = BANDS * BAND_ROWS
#: values compared at once by the sequential test
BATCH = 32
#: a pair is dropped when its chance of reaching the threshold is below this
MISS_PROBABILITY = 1e-6
#: nodes of one bucket compared in one block
BLOCK = 512
#: rows of bucket blocks that are handled in one call, on average
LOT_ROWS = 3_000

_rng = np.random.Generator(np.random.PCG64(20240817))
_FACTORS = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def shingle_set(words: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text's word hashes; a short text is one shingle."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    return np.unique(sequence_hash([words[i:i + count] for i in range(width)]))


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES smallest values of the set under as many hash functions."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 1024):
        part = shingles[at:at + 1024]
        best = np.minimum(best, ((_FACTORS[:, None] * part[None, :] + _SHIFTS[:, None]) >> np.uint64(32)).min(axis=1))
    return best.astype(np.uint32)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each signature (rows)."""
    values = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signatures), 1))
    for i in range(BAND_ROWS):
        keys = mix(keys * np.uint64(0x2545F4914F6CDD1D) + values[:, :, i])
    return keys.view(np.int64)


@lru_cache(maxsize=64)
def least_matches(compared: int, threshold: float, miss: float) -> int:
    """Fewest equal values among ``compared`` with P(similarity >= threshold | equal values) >= miss."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    tail = grid >= threshold
    for m in range(compared + 1):
        log_density = (m * np.log(grid) + (compared - m) * np.log1p(-grid)
                       + lgamma(compared + 2) - lgamma(m + 1) - lgamma(compared - m + 1))
        if np.exp(log_density[tail]).sum() / 20_000 >= miss:
            return m
    return compared + 1


def sequential_survivors(a: np.ndarray, b: np.ndarray, threshold: float, miss: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of signature rows: the positions that are never pruned, and their equal values."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int32)
    for at in range(0, HASHES, BATCH):
        stop = min(at + BATCH, HASHES)
        equal[alive] += (a[alive, at:stop] == b[alive, at:stop]).sum(axis=1, dtype=np.int32)
        alive = alive[equal[alive] >= least_matches(stop, threshold, miss)]
    return alive, equal[alive]


def _facts_schema(id_type: str) -> str:
    return f"id {id_type}, text_key long, node binary, n_shingles long, signature binary"


def _digest(words: np.ndarray) -> bytes:
    return hashlib.blake2b(words.tobytes(), digest_size=16).digest()


def _facts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, text_keys = batch.column(0), batch.column(1)
            for part in word_slices(batch.column(2)):
                nodes, sizes, signs = [], [], []
                for i in range(part.rows):
                    words = part.hash[part.first[i]:part.first[i + 1]]
                    shingles = shingle_set(words, width)
                    sizes.append(len(shingles))
                    nodes.append(_digest(words))
                    signs.append(signature(shingles).tobytes() if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(part.row, part.rows), text_keys.slice(part.row, part.rows), pa.array(nodes, pa.binary()),
                     pa.array(sizes, pa.int64()), pa.array(signs, pa.binary())],
                    ["id", "text_key", "node", "n_shingles", "signature"])
    return run


def _sets(width: int):
    """(node, shingles) of the rows whose digest is asked for."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = batch.column(0).to_pylist()
            for part in word_slices(batch.column(1)):
                nodes, sets = [], []
                for i in range(part.rows):
                    words = part.hash[part.first[i]:part.first[i + 1]]
                    if _digest(words) == wanted[part.row + i]:
                        nodes.append(wanted[part.row + i])
                        sets.append(shingle_set(words, width).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.binary())],
                                                 ["node", "shingles"])
    return run


def _keys_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        if len(batch):
            signs = np.frombuffer(b"".join(batch["signature"]), np.uint32).reshape(-1, HASHES)
            yield pd.DataFrame({"node": batch["node"], "keys": list(band_keys(signs))})


def _prune(threshold: float, miss: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), np.uint32).reshape(-1, HASHES) for c in ("sign_a", "sign_b"))
                alive, _ = sequential_survivors(a, b, threshold, miss)
                yield batch.iloc[alive][["a", "b"]]
    return run


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity; sizes too far apart need no look inside."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y):
        return False
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(batch["set_a"], batch["set_b"])]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]
    return run


def _across(threshold: float, miss: float):
    """Nodes of a bucket's block pair in pairs across groups that pass the sequential test.

    Each bucket gives one row per such node, with its place; the first one carries the pairs of places in order
    of equal values. A pair is taken in the first band it agrees in only.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "block_a", "block_b"], kind="stable", ignore_index=True)
        signs = np.frombuffer(b"".join(rows["signature"]), np.uint32).reshape(-1, HASHES)
        code, side, band = (rows[c].to_numpy() for c in ("code", "side", "band"))
        place = rows[["key", "block_a", "block_b"]].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
        picked, places, texts = [], [], []
        for lo, hi in zip(starts, np.append(starts[1:], len(rows))):
            if place[lo, 1] == place[lo, 2]:
                first, second = _triangle(hi - lo)
                first, second = first + lo, second + lo
            else:
                left, right = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
                first, second = np.repeat(left, len(right)), np.tile(right, len(left))
            apart = code[first] != code[second]
            first, second = first[apart], second[apart]
            found = []
            for at in range(0, len(first), 4096):
                a, b = first[at:at + 4096], second[at:at + 4096]
                alive, equal = sequential_survivors(signs[a], signs[b], threshold, miss)
                a, b = a[alive], b[alive]
                if band[lo]:
                    early = (signs[a, :band[lo] * BAND_ROWS] == signs[b, :band[lo] * BAND_ROWS]).reshape(
                        len(a), band[lo], BAND_ROWS).all(axis=2).any(axis=1)
                    a, b, equal = a[~early], b[~early], equal[~early]
                found.append(np.stack([a, b, equal], axis=1))
            found = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            if len(found):
                found = found[np.argsort(-found[:, 2], kind="stable"), :2]
                used, local = np.unique(found, return_inverse=True)
                picked.append(used)
                places.append(np.arange(len(used)))
                texts += [local.reshape(-1, 2).astype(np.int32).tobytes()] + [None] * (len(used) - 1)
        if not picked:
            return pd.DataFrame({c: [] for c in ("key", "block_a", "block_b", "node", "place", "pairs")})
        out = rows.loc[np.concatenate(picked), ["key", "block_a", "block_b", "node"]]
        return out.assign(place=np.concatenate(places), pairs=texts)
    return run


@lru_cache(maxsize=256)
def _triangle(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def _confirm(percent: int):
    """Links that join the groups of each bucket: its pairs in order, those joined already left out."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, part in rows.sort_values(["key", "block_a", "block_b", "place"]).groupby(["key", "block_a", "block_b"], sort=False):
            nodes = part["node"].to_numpy()
            sets = [np.frombuffer(x, np.uint64) for x in part["shingles"]]
            root = list(range(len(nodes)))
            for x, y in np.frombuffer(part["pairs"].iloc[0], np.int32).reshape(-1, 2).tolist():
                x_root, y_root = _find(root, x), _find(root, y)
                if x_root != y_root and similar(sets[x], sets[y], percent):
                    root[max(x_root, y_root)] = min(x_root, y_root)
                    a.append(min(nodes[x], nodes[y]))
                    b.append(max(nodes[x], nodes[y]))
        return pd.DataFrame({"a": pd.Series(a, dtype=object), "b": pd.Series(b, dtype=object)})
    return run


def _find(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _with_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """Adds ``group``: a label that only connected nodes share, else the node itself."""
    labels = near_labels(links)
    return (members.join(labels, members["node"] == labels["id"], "left")
            .withColumn("group", F.coalesce("label", "node")).drop("id", "label"))


def _block_pairs(members: DataFrame, signatures: DataFrame) -> DataFrame:
    """Rows of buckets with several groups, dealt into blocks, one copy per pair of blocks."""
    # a node's groups are told apart by a hash of the group's label
    coded = members.withColumn("code", F.xxhash64("group"))
    mixed = (coded.groupBy("key").agg(F.count("*").alias("n"), F.min("code").alias("lo"), F.max("code").alias("hi"))
             .filter("lo <> hi").select("key", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    dealt = (coded.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
             .join(signatures, "node"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    return (dealt.select("key", "band", "node", "code", "signature", "own", other)
            .select("key", "band", "node", "code", "signature", F.least("own", "other").alias("block_a"),
                    F.greatest("own", "other").alias("block_b"),
                    (F.col("own") > F.col("other")).cast("int").alias("side")))


def _gathered(rows: DataFrame, total: int, size: int) -> DataFrame:
    """Adds ``lot``: whole bucket blocks by hash, about ``size`` rows in each, so that small ones share a call."""
    return rows.withColumn("lot", F.pmod(F.xxhash64("key", "block_a", "block_b"), F.lit(max(1, -(-total // size)))))


def near_duplicates(df: DataFrame, percent: int = 85, width: int = 3, miss: float = MISS_PROBABILITY,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``n_copies``,
    ``text_key`` (a hash of the text) and ``group`` (the component, also where ids are null; null without words).

    Texts are linked when 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles;
    a component is everything reachable by links, named by its smallest id. Links are confirmed on full
    sets; a pair at 85 % shares no band with probability (1 - 0.85**5)**32 = 7e-9 and is pruned with
    probability below ``miss`` per batch. A text with fewer words than ``width`` has its whole sequence
    as its one shingle; texts without words (or null) have the empty set and stay alone, with themselves
    as component. Repeated rows each get a row; rows that share an id but not a text keep separate texts.
    A null id is never the smallest and never kept, unless its component has null ids only (then the
    component is null). Texts of any length count whole. An empty table gives no rows. Other columns of
    ``df`` are not looked at.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    facts = materialize(texts.mapInArrow(_facts(width), _facts_schema(id_type)))
    nodes = materialize(facts.filter("n_shingles > 0").groupBy("node").agg(
        F.min("id").alias("first_id"), F.count("*").alias("n_copies")))
    # one signature per node: of the row that holds the smallest id (rows with that id agree in it)
    ids = facts.filter("n_shingles > 0").select("id", "node", "signature")
    signatures = ids.join(nodes.select(F.col("node").alias("own"), "first_id"),
                          (ids["node"] == F.col("own")) & ids["id"].eqNullSafe(F.col("first_id")), "left_semi")
    signatures = signatures.select("node", "signature")

    postings = (signatures.mapInPandas(_keys_of, "node binary, keys array<long>")
                .select("node", F.xxhash64("node").alias("code"), F.posexplode("keys").alias("band", "key")))
    shared = (postings.groupBy("key").agg(F.min("code").alias("least"), F.max("code").alias("most"))
              .filter("least <> most").select("key", "least"))
    members = materialize(postings.join(shared, "key").distinct())
    wanted = materialize(members.select("node").distinct())
    n_wanted = wanted.count()
    if not n_wanted:
        return _result(facts, nodes, None)
    family_signs = materialize(signatures.join(small(wanted, n_wanted), "node", "left_semi").dropDuplicates(["node"]))

    # full sets of the candidates, from one row each
    chosen = nodes.join(wanted, "node").select("node", F.col("first_id").alias("first"))
    sets = (texts.join(small(chosen, n_wanted), texts["id"].eqNullSafe(chosen["first"]))
            .select("node", "text").mapInArrow(_sets(width), "node binary, shingles binary")
            .dropDuplicates(["node"]))
    sets = materialize(sets)

    def confirmed(pairs: DataFrame) -> DataFrame:
        full = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
                .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"))
        return materialize(full.mapInPandas(_verify(percent), "a binary, b binary"))

    heads = members.filter("code = least").select("key", F.col("node").alias("a"))
    stars = members.filter("code <> least").join(heads, "key").select("a", F.col("node").alias("b")).distinct()
    with_signs = (stars.join(family_signs.select(F.col("node").alias("a"), F.col("signature").alias("sign_a")), "a")
                  .join(family_signs.select(F.col("node").alias("b"), F.col("signature").alias("sign_b")), "b"))
    links = confirmed(materialize(with_signs.mapInPandas(_prune(percent / 100, miss), "a binary, b binary")))
    grouped = _with_groups(members.select("key", "band", "node"), links)
    blocks = _gathered(_block_pairs(grouped, family_signs), members.count(), LOT_ROWS)
    pairs = materialize(blocks.groupBy("lot").applyInPandas(
        _across(percent / 100, miss), "key long, block_a long, block_b long, node binary, place int, pairs binary"))
    open_pairs = _gathered(pairs.join(sets, "node"), pairs.count(), LOT_ROWS)
    links = links.union(open_pairs.groupBy("lot").applyInPandas(_confirm(percent), "a binary, b binary"))
    return _result(facts, nodes, component_labels(links))


def _result(facts: DataFrame, nodes: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        nodes = nodes.withColumn("group", F.col("node"))
    else:
        nodes = (nodes.join(labels, nodes["node"] == labels["id"], "left")
                 .withColumn("group", F.coalesce("label", "node")).drop("id", "label"))
    least = nodes.groupBy(F.col("group").alias("_group")).agg(F.min("first_id").alias("component_id"))
    nodes = nodes.join(least, F.col("group") == F.col("_group")).select("node", "n_copies", "group", "component_id")
    rows = facts.select(F.col("id").alias("doc_id"), "text_key", "node", "n_shingles").join(nodes, "node", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (rows.withColumn("component_id", component)
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
            .withColumn("n_copies", F.coalesce("n_copies", F.lit(1).cast("long")))
            .select("doc_id", "n_shingles", "component_id", "kept", "n_copies", "text_key", "group"))


def drop_near_duplicates(df: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """The rows of ``df`` less near duplicates: of every component one row stays, that of the smallest id.

    Of rows with that id, the one with the smallest hash of the text stays, and of rows alike in both any
    one. A component with null ids only keeps one row too. Rows without words all stay. Columns are as they were.
    """
    found = materialize(near_duplicates(df, percent, width, id_col=id_col, text_col=text_col)
                        .select("doc_id", "text_key", "group"))
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("text_key").alias("key"))
    kept = found.filter("group is not null").groupBy("group").agg(F.min(best).alias("best")).select(
        F.col("best.id").alias("_kept_id"), F.col("best.key").alias("_kept_key"))
    wordless = found.filter("group is null").select(F.col("doc_id").alias("_kept_id"), F.col("text_key").alias("_kept_key"))
    copies = found.filter("group is not null").groupBy("doc_id", "text_key").agg(F.count("*").alias("n"))
    kept_id, kept_key, again, place = (free_name(df, c) for c in ("_kept_id", "_kept_key", "_again", "_place"))
    kept = (kept.join(copies, kept["_kept_id"].eqNullSafe(copies["doc_id"]) & (kept["_kept_key"] == copies["text_key"]))
            .select("_kept_id", "_kept_key", (F.col("n") > 1).alias("_again"))
            .union(wordless.distinct().withColumn("_again", F.lit(False))))
    kept = materialize(kept.toDF(kept_id, kept_key, again))
    rows = df.join(small(kept, kept.count()), df[id_col].eqNullSafe(kept[kept_id])
                   & (F.xxhash64(df[text_col]) == kept[kept_key]))
    first = F.row_number().over(Window.partitionBy(kept_id, kept_key).orderBy(kept_key))
    repeated = rows.filter(again).withColumn(place, first).filter(F.col(place) == 1)
    return rows.filter(~F.col(again)).drop(kept_id, kept_key, again).union(repeated.drop(kept_id, kept_key, again, place))
