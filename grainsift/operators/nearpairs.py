"""Near-duplicate rows: token sets that overlap above a threshold.

Rows with the same token set are folded into one representative with a number of copies, so a
text copied a million times is one row here and its pairs are a number, not a million squared
rows. Pairs of different sets come from an exact prefix-filter join (Chaudhuri et al. 2006,
Bayardo et al. 2007).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import Iterator, Optional, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from grainsift.functions.columns import string_columns
from grainsift.functions.text import row_tokens
from grainsift.operators.aggkit import spread, work_parts
from grainsift.operators.graph import greedy_drop
from grainsift.operators.materialize import materialize
from grainsift.operators.ordering import bucket_of, order_bounds

FREQUENCY_SLOTS = 1 << 20
SIGNATURE_WORDS = 4
BLOCK_ROWS = 2_000
#: rows of a table of hot keys up to which it is broadcast
BROADCAST_KEYS = 200_000
#: pairs to look at up to which they are broadcast to the sets
BROADCAST_PAIRS = 500_000
#: pairs that one group of like sets is compared with at a time
CELL_PAIRS = 200_000
#: sets of the first batch of the greedy choice; later batches are larger by a factor
SEED_SETS, BATCH_GROWTH = 2_048, 8
#: pairs of a batch that one task decides, and meetings up to which they are not counted before
BATCH_PAIRS, BATCH_MEETINGS = 2_100_000, 20_000_000
_SLACK = 1e-9


@dataclass
class TokenSets:
    """Distinct token sets (``rep``, ``tokens``, the same as one text ``words``, ``copies``) and the set of every row."""

    sets: DataFrame
    members: DataFrame


def token_sets(df: DataFrame, row_id: str, columns: Optional[Sequence[str]] = None,
               lower: bool = False) -> TokenSets:
    """Fold rows by token set; ``rep`` is the smallest row id of a set.

    Sets move as one text, sorted tokens with blanks between (tokens have none), which is half as long as an array.
    ``members`` has (``rep``, row id) and is only computed when it is used.
    """
    columns = columns or [c for c in string_columns(df) if c != row_id]
    rows = spread(df.select(row_id, *columns)).select(
        F.col(row_id).alias("row_id"),
        F.array_join(F.array_sort(row_tokens([F.col(f"`{c}`") for c in columns], lower)), " ").alias("words"))
    sets = materialize(rows.groupBy("words").agg(F.min("row_id").alias("rep"), F.count("*").alias("copies")))
    repeated = sets.filter("copies > 1").select("rep", "words")
    single = sets.filter("copies = 1").select("rep", F.col("rep").alias("row_id"))
    members = rows.join(repeated, "words").select("rep", "row_id").unionByName(single)
    return TokenSets(sets.withColumn("tokens", _as_tokens(F.col("words"))), members)


def _as_tokens(words: Column) -> Column:
    return F.when(words == "", F.array().cast("array<string>")).otherwise(F.split(words, " "))


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """Tokens of all sets per hash slot, so the table sent along has a fixed size whatever the vocabulary."""
    used = (sets.select(F.explode(F.transform("tokens", lambda t: F.xxhash64(t).bitwiseAND(FREQUENCY_SLOTS - 1))).alias("slot"))
            .groupBy(F.col("slot").cast("int").alias("slot")).agg(F.count("*").alias("n")).toArrow())
    counts = np.zeros(FREQUENCY_SLOTS, dtype="int32")      # at most FREQUENCY_SLOTS rows came
    counts[used.column("slot").to_numpy()] = np.minimum(used.column("n").to_numpy(), np.iinfo("int32").max)
    return counts


def _prefixes(counts: np.ndarray, threshold: float, names: Sequence[str]):
    """Arrow batches of (rep, token hashes, bucket) to the postings of their prefixes, see ``prefix_postings``."""
    def beginning(size: np.ndarray, share: float) -> np.ndarray:
        return size - np.ceil(size * share - _SLACK * (size + 1)).astype("int64") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            size = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype("int64")
            if not len(size):
                continue
            starts = np.cumsum(size) - size
            row = np.repeat(np.arange(len(size)), size)
            # bits set by an odd number of tokens: two sets differ in at least as many tokens as in bits
            bit = (values.view("uint64") >> np.uint64(40)) % np.uint64(64 * SIGNATURE_WORDS)
            one, word = np.uint64(1) << bit % np.uint64(64), bit // np.uint64(64)
            bits = [np.bitwise_xor.reduceat(np.where(word == w, one, np.uint64(0)), starts).view("int64")
                    for w in range(SIGNATURE_WORDS)]
            freq = counts[values & (FREQUENCY_SLOTS - 1)]
            order = np.lexsort((values, freq, row))
            values, freq, place = values[order], freq[order], np.arange(len(values)) - starts[row] + 1
            # a token alone in its slot is the rarest and in no other set: it counts in the prefix and is no posting
            kept = np.flatnonzero((place <= beginning(size, threshold)[row]) & (freq > 1))
            of, place = row[kept], place[kept]
            indexed = place <= beginning(size, 2 * threshold / (1 + threshold))[of]
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[kept]), batch.column(0).take(pa.array(of)), pa.array(size[of].astype("int32")),
                 pa.array(place.astype("int32")), pa.array(freq[kept]), pa.array(indexed), *[pa.array(b[of]) for b in bits],
                 batch.column(2).take(pa.array(of))], names=names)
    return run


def prefix_postings(sets: DataFrame, threshold: float) -> DataFrame:
    """Prefix tokens of every set, rare tokens first in one order for all sets.

    Columns: ``key`` (hash of the token), ``rep``, ``size`` of the set, ``place`` of the token from 1, ``freq`` (no less than
    the sets that hold the token), ``indexed`` (whether the token is needed where the set is the smaller one of a pair) and
    the words ``bits_i`` of a signature, and ``bucket`` of the set if it has one. Any common order gives right results; this one keeps shared tokens out of prefixes.
    """
    names = ["key", "rep", "size", "place", "freq", "indexed", *[f"bits_{w}" for w in range(SIGNATURE_WORDS)], "bucket"]
    types = [T.IntegerType()] * 3 + [T.BooleanType()] + [T.LongType()] * SIGNATURE_WORDS + [T.IntegerType()]
    schema = T.StructType([T.StructField("key", T.LongType()), sets.schema["rep"]] + [
        T.StructField(n, t) for n, t in zip(names[2:], types)])
    bucket = F.col("bucket") if "bucket" in sets.columns else F.lit(0)
    hashed = spread(sets.filter((F.size("tokens") > 0) & F.col("rep").isNotNull())).select(
        "rep", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"), bucket.cast("int").alias("bucket"))
    return materialize(hashed.mapInArrow(_prefixes(_slot_counts(sets), threshold, names), schema))


def block_self_join(postings: DataFrame, key: str, condition: Column,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs (left, right) of postings with equal key, hot keys spread over many tasks.

    ``postings`` has ``key``, ``rep`` and payload; ``condition`` speaks of ``a.`` and ``b.``. The rows
    of a key longer than ``block_rows`` are dealt into blocks, and every two blocks meet in their
    own task. Nothing is left out, and no task sees more than two blocks of a key.
    """
    hot = (postings.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > block_rows)
           .select(key, F.ceil(F.col("_n") / block_rows).cast("int").alias("_blocks")))
    dealt = postings.join(hot, key, "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1))).withColumn(
        "_own", F.pmod(F.xxhash64("rep"), F.col("_blocks")).cast("int"))
    # a number of parts of our own: the work is in the comparisons, so few bytes are no reason for few tasks
    parts = work_parts(postings.sparkSession)
    left = dealt.withColumn("_i", F.col("_own")).withColumn(
        "_j", F.explode(F.sequence(F.col("_own"), F.col("_blocks") - 1))).repartition(parts, key, "_i", "_j")
    right = dealt.withColumn("_j", F.col("_own")).withColumn(
        "_i", F.explode(F.sequence(F.lit(0), F.col("_own")))).repartition(parts, key, "_i", "_j")
    a, b = left.alias("a"), right.alias("b")
    meet = ((F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._i") == F.col("b._i"))
            & (F.col("a._j") == F.col("b._j")))
    # two rows of one block meet in both orders, rows of different blocks in one
    ordered = (F.col("a._own") < F.col("b._own")) | (F.col("a.rep") < F.col("b.rep"))
    return (a.join(b, meet & ordered & condition)
            .select(F.least("a.rep", "b.rep").alias("id_a"), F.greatest("a.rep", "b.rep").alias("id_b")))


def _hot_keys(left: DataFrame, right: DataFrame, key: str, common: Column, rows: int) -> tuple[DataFrame, int]:
    """Keys with more than ``rows`` rows on a side, with the number of blocks of both sides, and how many keys these are."""
    counted = [side.filter(common).groupBy(key).agg(F.count("*").alias(n)) for side, n in ((left, "_l"), (right, "_r"))]
    hot = materialize(counted[0].join(counted[1], key).filter(F.greatest("_l", "_r") > rows).select(
        key, F.ceil(F.col("_l") / rows).cast("int").alias("_l"), F.ceil(F.col("_r") / rows).cast("int").alias("_r")))
    n = hot.count()
    return (F.broadcast(hot) if n <= BROADCAST_KEYS else hot), n


def block_join(left: DataFrame, right: DataFrame, key: str, condition: Column, hot: DataFrame) -> DataFrame:
    """Pairs (``id_a`` < ``id_b``) of rows of two tables with equal key, hot keys spread over many tasks.

    ``condition`` speaks of ``a.`` (left) and ``b.`` (right). The rows of a key in ``hot`` are dealt into blocks on both
    sides, and every two blocks meet in their own task.
    """
    parts = work_parts(left.sparkSession)

    def dealt(side: DataFrame, own: str, own_blocks: str, other: str, other_blocks: str) -> DataFrame:
        return (side.join(hot, key, "left")
                .withColumn(own, F.pmod(F.xxhash64("rep"), F.coalesce(own_blocks, F.lit(1))).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.coalesce(other_blocks, F.lit(1)) - 1)))
                .drop("_l", "_r").repartition(parts, key, "_i", "_j"))
    a, b = dealt(left, "_i", "_l", "_j", "_r").alias("a"), dealt(right, "_j", "_r", "_i", "_l").alias("b")
    meet = ((F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a._i") == F.col("b._i")) & (F.col("a._j") == F.col("b._j")))
    return _smaller_first(a.join(b, meet & condition))


def _smaller_first(met: DataFrame) -> DataFrame:
    return met.select(F.least("a.rep", "b.rep").alias("id_a"), F.greatest("a.rep", "b.rep").alias("id_b"))


def _fits(threshold: float) -> Column:
    """Whether two postings may be of similar sets, the smaller set at ``a``.

    Sizes have to fit, enough tokens have to be left behind the first shared one (Xiao et al. 2008), and the signatures
    must not differ in more bits than the sets may in tokens.
    """
    slack = f"{_SLACK!r}D * (a.size + b.size + 1)"
    differing = " + ".join(f"bit_count(a.bits_{w} ^ b.bits_{w})" for w in range(SIGNATURE_WORDS))
    return F.expr(f"""a.rep <> b.rep AND CASE WHEN a.indexed
        THEN (a.size < b.size OR a.size = b.size AND a.rep < b.rep) AND a.size >= b.size * {threshold!r}D - {slack}
        AND 1 + least(a.size - a.place, b.size - b.place) >= (a.size + b.size) * {threshold / (1 + threshold)!r}D - {slack}
        AND {differing} <= (a.size + b.size) * {(1 - threshold) / (1 + threshold)!r}D + {slack} ELSE false END""")


def _slim(postings: DataFrame) -> DataFrame:
    return postings.select("key", "rep", "size", "place", "indexed", *[f"bits_{w}" for w in range(SIGNATURE_WORDS)])


def fitting_pairs(indexed: DataFrame, probing: DataFrame, threshold: float) -> DataFrame:
    """Pairs of postings that meet and fit, the smaller set from ``indexed``; a pair may come once per shared token."""
    indexed = indexed.filter("indexed")
    hot, _ = _hot_keys(indexed, probing, "key", F.col("freq") > BLOCK_ROWS, BLOCK_ROWS)
    return block_join(_slim(indexed), _slim(probing), "key", _fits(threshold), hot)


def own_fitting_pairs(postings: DataFrame, threshold: float) -> DataFrame:
    """``fitting_pairs`` of a table with itself. But for hot keys both sides are one shuffle: the condition on ``indexed``
    stands with the other side's columns, so that it is not taken in front of the shuffle on one side only."""
    hot, n = _hot_keys(postings.filter("indexed"), postings, "key", F.col("freq") > BLOCK_ROWS, BLOCK_ROWS)
    cold = _slim(postings.join(hot, "key", "left_anti") if n else postings).repartition(
        work_parts(postings.sparkSession), "key")
    pairs = _smaller_first(cold.alias("a").join(cold.alias("b"), (F.col("a.key") == F.col("b.key")) & _fits(threshold)))
    if not n:
        return pairs
    rest = postings.join(hot, "key", "left_semi")
    return pairs.unionByName(block_join(_slim(rest.filter("indexed")), _slim(rest), "key", _fits(threshold), hot))


def candidate_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs of sets that share a prefix token and whose sizes, places and signatures fit."""
    return own_fitting_pairs(prefix_postings(sets, threshold), threshold).distinct()


def _scored(threshold: float, names: Sequence[str]):
    """Jaccard similarity of the pairs of a cell; every set is taken apart once."""
    def run(pairs: pa.Table, sets: pa.Table) -> pa.Table:
        found: dict = {}
        for rep, words, copies in zip(*[sets.column(c).to_pylist() for c in ("rep", "words", "copies")]):
            found.setdefault(rep, []).append((frozenset(words.split(" ")) if words else frozenset(), copies))
        rows = []
        for i, (id_a, id_b) in enumerate(zip(pairs.column("id_a").to_pylist(), pairs.column("id_b").to_pylist())):
            for a, copies_a in found.get(id_a, ()):
                for b, copies_b in found.get(id_b, ()):
                    shared = len(a & b)
                    union = len(a) + len(b) - shared
                    score = shared / union if union else 1.0
                    if score >= threshold - _SLACK:
                        rows.append((i, score, copies_a, copies_b))
        at, *values = zip(*rows) if rows else ((),) * 4
        at = pa.array(at, pa.int64())
        return pa.Table.from_arrays([pairs.column("id_a").take(at), pairs.column("id_b").take(at), *[
            pa.array(v, t) for v, t in zip(values, (pa.float64(), pa.int64(), pa.int64()))]], names=names)
    return run


def _score(candidates: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Candidates with Jaccard similarity at or above the threshold, by the tokens themselves.

    The pairs of a family of like sets meet where its smallest id is, so a set moves about once however many pairs it is in.
    Families with very many pairs are dealt into blocks. Only sets in candidates are moved, and as texts.
    """
    spark = sets.sparkSession
    candidates = materialize(candidates)
    n_pairs = candidates.count()
    few = n_pairs <= BROADCAST_PAIRS
    ends = candidates.select("id_a", F.explode(F.array("id_a", "id_b")).alias("id"))
    homes = materialize(ends.groupBy("id").agg(F.min("id_a").alias("home")))
    n_ids = homes.count()
    small = F.broadcast(homes) if few else homes
    placed = (candidates.join(small.select(F.col("id").alias("id_a"), F.col("home").alias("_a")), "id_a")
              .join(small.select(F.col("id").alias("id_b"), F.col("home").alias("_b")), "id_b")
              .select("id_a", "id_b", F.least("_a", "_b").alias("home")))
    if n_pairs > CELL_PAIRS:
        large = placed.groupBy("home").agg(F.count("*").alias("_n")).filter(F.col("_n") > CELL_PAIRS).select(
            "home", F.ceil(F.sqrt(F.col("_n") / CELL_PAIRS)).alias("_blocks"))
        placed = placed.join(large, "home", "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1).cast("long")))
    else:
        placed = placed.withColumn("_blocks", F.lit(1).cast("long"))
    cells = max(work_parts(spark), -(-n_pairs // CELL_PAIRS), -(-n_ids // BLOCK_ROWS))
    placed = materialize(placed.select("id_a", "id_b", F.pmod(F.xxhash64(
        "home", *[F.pmod(F.xxhash64(c), F.col("_blocks")) for c in ("id_a", "id_b")]), F.lit(cells)).cast("int").alias("cell")))
    wanted = placed.select("cell", F.explode(F.array("id_a", "id_b")).alias("rep")).distinct()
    if few:
        wanted = F.broadcast(wanted)
    moved = sets.select("rep", "words", "copies").join(wanted, "rep").select(F.col("cell").alias("at"), "rep", "words", "copies")
    names = ["id_a", "id_b", "jaccard", "copies_a", "copies_b"]
    schema = T.StructType([candidates.schema["id_a"], candidates.schema["id_b"], T.StructField("jaccard", T.DoubleType()),
                           T.StructField("copies_a", T.LongType()), T.StructField("copies_b", T.LongType())])
    # a number of parts of our own, as the work is in the comparisons
    parts = min(cells, 8 * work_parts(spark))
    return (placed.repartition(parts, "cell").groupBy("cell").cogroup(moved.repartition(parts, "at").groupBy("at"))
            .applyInArrow(_scored(threshold, names), schema))


def similar_sets(found: TokenSets, threshold: float) -> DataFrame:
    """Pairs of different token sets with Jaccard similarity at or above the threshold."""
    return _score(candidate_pairs(found.sets, threshold), found.sets, threshold)


def kept_partners(found: TokenSets, threshold: float) -> DataFrame:
    """Every set that a greedy choice in id order drops, with the first kept one alike to it: (``rep``, ``by``).

    The pairs of a family that is all alike are many, but its first set drops the others. So sets are taken in batches in
    id order, a small one first: a batch is compared with the sets kept so far, and only what is left of it with itself.
    A batch that would still have very many pairs is taken in smaller ones.
    """
    named = found.sets.filter(F.col("rep").isNotNull())
    bounds = order_bounds(named, ["rep"], SEED_SETS)
    postings = prefix_postings(named.withColumn("bucket", bucket_of(named, ["rep"], bounds)), threshold)
    first, width, kept, dropped = 0, 1, None, []
    while first <= len(bounds):
        after = first + width
        batch, hit = postings.filter((F.col("bucket") >= first) & (F.col("bucket") < after)), None
        if kept is not None:
            met = fitting_pairs(kept, batch, threshold).union(fitting_pairs(batch, kept, threshold)).distinct()
            hit = materialize(_first_partner(_score(met, named, threshold)))
            batch = materialize(batch.join(hit.select("rep"), "rep", "left_anti"))
        if width > 1 and _meetings(batch) > BATCH_MEETINGS:
            n = materialize(own_fitting_pairs(batch, threshold).agg(F.count("*").alias("n"))).first()["n"]
            if n > BATCH_PAIRS:
                width = max(1, width // BATCH_GROWTH)
                continue
        pairs = materialize(_score(own_fitting_pairs(batch, threshold).distinct(), named, threshold))
        lost = materialize(greedy_drop(pairs)).select("id")
        dropped += [_first_partner(pairs.join(lost.withColumnRenamed("id", "id_b"), "id_b", "left_semi")
                                   .join(lost.withColumnRenamed("id", "id_a"), "id_a", "left_anti"))] + ([hit] if hit else [])
        left = batch.join(lost.withColumnRenamed("id", "rep"), "rep", "left_anti")
        kept = left if kept is None else kept.union(left)
        first, width = after, width * BATCH_GROWTH
    return reduce(DataFrame.union, dropped)


def _first_partner(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy(F.col("id_b").alias("rep")).agg(F.min(F.struct("id_a", "jaccard")).alias("by"))


def _meetings(postings: DataFrame) -> int:
    """Upper bound of the pairs of postings that are looked at."""
    per_key = postings.groupBy("key").agg(F.count_if("indexed").alias("a"), F.count("*").alias("b"))
    return materialize(per_key.agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0)).alias("n"))).first()["n"]


def near_duplicates(df: DataFrame, row_id: str, threshold: float = 0.9,
                    columns: Optional[Sequence[str]] = None, lower: bool = False) -> DataFrame:
    """Near-duplicate rows as pairs of representatives with the number of row pairs they stand for.

    A pair of a representative with itself stands for the pairs among its own copies.
    """
    found = token_sets(df, row_id, columns, lower)
    pairs = similar_sets(found, threshold).withColumn("row_pairs", F.col("copies_a") * F.col("copies_b"))
    own = found.sets.filter("copies > 1").select(
        F.col("rep").alias("id_a"), F.col("rep").alias("id_b"), F.lit(1.0).alias("jaccard"),
        F.col("copies").alias("copies_a"), F.col("copies").alias("copies_b"),
        F.floor(F.col("copies") * (F.col("copies") - 1) / 2).alias("row_pairs"))
    return pairs.unionByName(own)


def suggested_merges(pairs: DataFrame) -> DataFrame:
    """Each pair as a group to merge into its smaller row id."""
    return pairs.select(F.least("id_a", "id_b").alias("keep_id"), F.greatest("id_a", "id_b").alias("merge_id"),
                        F.col("jaccard").alias("score"))


# --- approximate variant -----------------------------------------------------------------

def bands_for(threshold: float, permutations: int) -> tuple[int, int]:
    """Bands and rows per band whose 50 % point lies nearest below the threshold."""
    best = (permutations, 1)
    best_point = 0.0
    for rows in range(1, permutations + 1):
        bands = permutations // rows
        point = (1.0 / bands) ** (1.0 / rows)
        if best_point <= point <= threshold - 0.02:
            best, best_point = (bands, rows), point
    return best


def minhash_signatures(sets: DataFrame, permutations: int = 128, seed: int = 1) -> DataFrame:
    """Smallest value of each of many hash functions over the tokens of a set."""
    rng = np.random.default_rng(seed)
    factors = (rng.integers(1, 1 << 62, permutations, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
    shifts = rng.integers(0, 1 << 63, permutations, dtype=np.uint64)

    @F.pandas_udf("array<long>")
    def signature(hashes: pd.Series) -> pd.Series:
        def one(values: np.ndarray) -> np.ndarray:
            h = np.asarray(values, dtype=np.int64).astype(np.uint64)
            mixed = h[:, None] * factors[None, :] + shifts[None, :]
            return (mixed.min(axis=0) >> np.uint64(1)).astype(np.int64)
        return hashes.map(one)

    return sets.filter(F.size("tokens") > 0).select(
        "rep", "copies", signature(F.transform("tokens", lambda t: F.xxhash64(t))).alias("signature"))


def minhash_pairs(found: TokenSets, threshold: float = 0.9, permutations: int = 128) -> DataFrame:
    """Pairs of sets that agree on a whole band, with the estimated similarity."""
    bands, rows = bands_for(threshold, permutations)
    signed = materialize(minhash_signatures(found.sets, permutations))
    keys = F.array(*[F.xxhash64(F.lit(i), F.slice("signature", i * rows + 1, rows)) for i in range(bands)])
    postings = signed.select("rep", F.explode(keys).alias("band"))
    candidates = block_self_join(postings, "band", F.lit(True)).distinct()
    a = signed.select(F.col("rep").alias("id_a"), F.col("signature").alias("_sa"))
    b = signed.select(F.col("rep").alias("id_b"), F.col("signature").alias("_sb"))
    agree = F.size(F.filter(F.zip_with("_sa", "_sb", lambda x, y: x == y), lambda same: same))
    return (candidates.join(a, "id_a").join(b, "id_b")
            .select("id_a", "id_b", (agree / F.lit(float(permutations))).alias("estimate"))
            .filter(F.col("estimate") >= threshold))
