"""Mixing sources to target shares by drawing permuted blocks, with DataFrame operations only.

1. Every source gets a target number of words from its weight, capped at a multiple of its size.
2. A source's rows are dealt into blocks by a hash (a block is a random set of its rows, and the hash
   order of blocks is a random permutation). A target of k sizes and a rest draws every block k times
   and, for the rest, a prefix of the permuted blocks; around the place where the rest ends only some
   rows are taken.
3. The drawn blocks are split among output shards by a tree. A node holds, per source, a range of the
   source's permuted block places. Its left child gets a fixed share of all places, and how many of each
   source is drawn from the multivariate hypergeometric law, source after source; the child takes the
   first places of each range and its sibling the others. Repeating this down to single shards
   partitions the source quotas exactly and gives each shard disjoint blocks.
4. Within a shard, rows follow a hash of draw and row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from grainsift.llm.common import SPACED_WORD, free_name, small
from grainsift.operators.materialize import materialize

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: rows of a block, on average; smaller sources have smaller blocks, so that there are some for every shard
BLOCK_ROWS = 1_000
BLOCKS_PER_SHARD = 32
SHARDS = 16
#: bytes of text in one part of the written mix, on average
PART_BYTES = 64_000_000

_RESULTS = ("size", "source_size", "target", "copies", "taken", "shards")


def word_size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def with_facts(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source") -> DataFrame:
    """Adds ``size`` (words) and ``mix_key`` (a hash that orders the rows of a source)."""
    return df.drop(*[c for c in (*_RESULTS, "mix_key") if c in df.columns and c not in (id_col, text_col, source_col)]
                   ).withColumns({
                       "size": word_size(F.col(text_col)),
                       "mix_key": F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))})


def source_targets(facts: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
                   max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: rows, size, weight by code-point order (null last) and capped target.

    With sources in ascending order of cap over weight, the words per unit of weight are the largest of
    (all words - caps before) / (weights from here on): sharing the excess again and again ends there.
    """
    order = Window.orderBy(F.col(source_col).asc_nulls_last())
    everything = Window.partitionBy()
    by_cap = Window.orderBy("_ratio", F.col(source_col).asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    return (facts.groupBy(source_col).agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
            .withColumn("_weight", weight)
            .withColumn("_ratio", cap / F.col("_weight"))
            .withColumn("_level", (F.sum("source_size").over(everything)
                                   - F.coalesce(F.sum(cap).over(before), F.lit(0)))
                        / F.sum("_weight").over(onward))
            .withColumn("_level", F.max("_level").over(everything))
            .withColumn("target", F.least(F.col("_weight") * F.col("_level"), cap.cast("double")))
            .select(source_col, "source_size", "_rows", F.col("_weight").alias("weight"), "target"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression that uses a value several times and computes it once."""
    return F.transform(F.array(value), body)[0]


def hypergeometric(total: Column, marked: Column, drawn: Column, chance: Column) -> Column:
    """How many marked ones are among ``drawn`` of ``total`` places: the value at ``chance`` (0 to 1) of the law.

    Weights follow from that of the mode by the ratio of neighbours; the law is walked from the mode upwards,
    then downwards, which orders the values but leaves their chances as they are. Values more than forty
    standard deviations from the mode weigh nothing in double precision and are not visited.
    """
    def walk(p: Column, steps: Column, up: bool, target: Column) -> Column:
        """Sum of weights on one side of the mode, and the first value at which it exceeds the target."""
        def step(a: Column, j: Column) -> Column:
            x = p["mode"] + j if up else p["mode"] - j
            ratio = ((p["marked"] - x) * (p["drawn"] - x) / ((x + 1) * (p["others"] - p["drawn"] + x + 1)) if up else
                     x * (p["others"] - p["drawn"] + x) / ((p["marked"] - x + 1) * (p["drawn"] - x + 1)))
            own = a["w"] if up else F.when(j > 0, a["w"]).otherwise(0.0)          # the mode counts upwards
            return F.struct((a["w"] * ratio).alias("w"), (a["sum"] + own).alias("sum"),
                            F.when((a["at"] < 0) & (a["sum"] + own > target), x).otherwise(a["at"]).alias("at"))
        start = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1.0).alias("at"))
        return F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), steps.cast("long")), lambda j: j.cast("double")),
                           start, step)

    def bounds(p: Column) -> Column:
        least = F.greatest(F.lit(0.0), p["drawn"] - p["others"])
        most = F.least(p["marked"], p["drawn"])
        mode = F.floor((p["drawn"] + 1) * (p["marked"] + 1) / (p["marked"] + p["others"] + 2)).cast("double")
        share = p["marked"] / F.greatest(p["marked"] + p["others"], F.lit(1.0))
        reach = F.ceil(40 * F.sqrt(p["drawn"] * share * (1 - share)) + 40).cast("double")
        return F.struct(p["marked"].alias("marked"), p["others"].alias("others"), p["drawn"].alias("drawn"),
                        F.greatest(least, F.least(most, mode)).alias("mode"), least.alias("least"), most.alias("most"),
                        reach.alias("reach"), p["chance"].alias("chance"))

    def value(p: Column) -> Column:
        above = F.least(p["most"] - p["mode"], p["reach"])
        below = F.least(p["mode"] - p["least"], p["reach"])
        never = F.lit(float("inf"))
        sums = F.struct(walk(p, above, True, never)["sum"].alias("up"), walk(p, below, False, never)["sum"].alias("down"))
        return _let(sums, lambda s: _let(p["chance"] * (s["up"] + s["down"]), lambda target: F.when(
            target < s["up"], walk(p, above, True, target)["at"]).otherwise(walk(p, below, False, target - s["up"])["at"])))

    given = F.struct(marked.cast("double").alias("marked"), (total - marked).cast("double").alias("others"),
                     drawn.cast("double").alias("drawn"), chance.alias("chance"))
    return _let(given, lambda g: _let(bounds(g), lambda p: _let(value(p), lambda x: F.when(x < 0, p["mode"]).otherwise(x)))
                ).cast("long")


def split_tree(quotas: DataFrame, seed: int, shards: int) -> DataFrame:
    """Leaves of the splitting tree over block places of sources (``number``, ``n``): one row per source with
    ``ends``, the place in the source's permuted order where each shard's range ends.

    A node with s shards and n places gives its left child floor(s / 2) shards and n * floor(s / 2) div s places.
    A node is one row, which holds one range per source.
    """
    nodes = quotas.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
                       F.array_sort(F.collect_list(F.struct("number", F.lit(0).cast("long").alias("at"), "n"))).alias("ranges")
                       ).select(F.lit(0).alias("first"), F.lit(shards).alias("shards"), "total", "ranges")
    left_shards = F.floor(F.col("shards") / 2).cast("int")
    left_total = F.expr("total * floor(shards / 2) div shards").cast("long")
    widest = shards
    while widest > 1:
        def draw(a: Column, r: Column) -> Column:
            chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("first"), F.col("shards"), r["number"]), 11) / 2.0 ** 53
            return _let(hypergeometric(a["total"], r["n"], a["left"], chance), lambda x: F.struct(
                (a["total"] - r["n"]).alias("total"), (a["left"] - x).alias("left"), F.concat(a["drawn"], F.array(x)).alias("drawn")))
        start = F.struct(F.col("total").alias("total"), left_total.alias("left"), F.array().cast("array<bigint>").alias("drawn"))
        drawn = F.when(F.col("shards") > 1, F.aggregate("ranges", start, draw)["drawn"])
        left = F.zip_with("ranges", "drawn", lambda r, x: F.struct(r["number"].alias("number"), r["at"].alias("at"), x.alias("n")))
        right = F.zip_with("ranges", "drawn", lambda r, x: F.struct(
            r["number"].alias("number"), (r["at"] + x).alias("at"), (r["n"] - x).alias("n")))
        def node(first: Column, count: Column, total: Column, ranges: Column) -> Column:
            return F.struct(first.alias("first"), count.alias("shards"), total.alias("total"), ranges.alias("ranges"))
        children = F.when(F.col("shards") > 1, F.array(
            node(F.col("first"), left_shards, F.col("left_total"), left),
            node(F.col("first") + left_shards, F.col("shards") - left_shards, F.col("total") - F.col("left_total"), right))
            ).otherwise(F.array(node(F.col("first"), F.col("shards"), F.col("total"), F.col("ranges"))))
        nodes = materialize(nodes.withColumn("left_total", left_total).withColumn("drawn", drawn)
                            .select(F.explode(children).alias("node")).select("node.*"))
        widest -= widest // 2
    return (nodes.select("first", F.explode("ranges").alias("r")).groupBy(F.col("r.number").alias("number"))
            .agg(F.transform(F.array_sort(F.collect_list(F.struct("first", (F.col("r.at") + F.col("r.n")).alias("end")))),
                             lambda x: x["end"]).alias("ends")))


def block_plan(facts: DataFrame, seed: int = 0, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
               max_repeats: int = MAX_REPEATS, block_rows: int = BLOCK_ROWS, shards: int = SHARDS
               ) -> tuple[DataFrame, DataFrame]:
    """Sources (number, sizes, target) and blocks (number, block, draws and their shards) of a mix, as tables."""
    sources = source_targets(facts, source_col, weights, max_repeats)
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")),
                                                    F.lit(max_repeats))).otherwise(0).cast("long")
    sources = materialize(sources.select(
        F.col(source_col).alias("_s"), "source_size", "target", full.alias("_full"),
        F.row_number().over(Window.orderBy(F.col(source_col).asc_nulls_last())).alias("_number"),
        F.when(full < max_repeats, F.col("target") - full * F.col("source_size")).otherwise(0.0).alias("_left"),
        F.greatest(F.ceil(F.col("_rows") / block_rows), F.least(F.col("_rows"), F.lit(BLOCKS_PER_SHARD * shards))).alias("_blocks")))
    # blocks of a source in permuted order; the rest of its target ends in the first that does not fit whole
    permuted = Window.partitionBy("_number").orderBy("_order", "_block")
    before = permuted.rowsBetween(Window.unboundedPreceding, -1)
    source = Window.partitionBy("_number")
    def so_far(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))
    end = F.min(F.when(F.col("_before") + F.col("_words") > F.col("_left"), F.col("_place"))).over(source)
    dealt = with_block(facts.select(source_col, "size", "mix_key"), sources, seed, source_col)
    plan = (dealt.groupBy("_number", "_block", "_full", "_left").agg(F.sum("size").alias("_words"), F.count("*").alias("_n"))
            .withColumn("_order", F.xxhash64(F.lit(seed + 2), "_number", "_block"))
            .withColumns({"_before": so_far("_words"), "_place": so_far("_n")})
            .withColumn("_end", F.when(F.col("_left") > 0, end))
            # rows are chosen one by one in the blocks about this place
            .withColumn("_ending", (F.col("_left") > 0) & F.coalesce(
                (F.col("_place") + F.col("_n") > F.col("_end") - block_rows) & (F.col("_place") < F.col("_end") + block_rows), F.lit(False)))
            .withColumn("_rest", F.col("_left") - F.min(F.when(F.col("_ending"), F.col("_before"))).over(source))
            .withColumn("_whole", (F.col("_left") > 0) & ~F.col("_ending")
                        & F.coalesce(F.col("_place") < F.col("_end"), F.lit(True)))
            .withColumn("_times", F.col("_full") + (F.col("_whole") | F.col("_ending")).cast("long"))
            .select("_number", "_block", "_full", "_ending", F.when(F.col("_ending"), F.col("_rest")).alias("_rest"), "_times"))
    plan = materialize(plan)
    ends = split_tree(plan.groupBy(F.col("_number").alias("number")).agg(F.sum("_times").alias("n")), seed + 5, shards)
    drawn = plan.filter("_times > 0").select(
            "_number", "_block", F.explode(F.sequence(F.lit(1).cast("long"), "_times")).alias("_time"))
    by_hash = source.orderBy(F.xxhash64(F.lit(seed + 3), "_number", "_block", "_time"), "_block", "_time")
    placed = (drawn.withColumn("_place", F.row_number().over(by_hash) - 1)
              .join(ends, F.col("_number") == F.col("number"))
              .withColumn("_shard", F.size(F.filter("ends", lambda e: e <= F.col("_place"))))
              .groupBy(F.col("_number").alias("_n"), F.col("_block").alias("_b"))
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("_time", "_shard"))),
                               lambda x: x["_shard"]).alias("_draws")))      # at most max_repeats + 1 entries
    blocks = plan.join(placed, (F.col("_number") == F.col("_n")) & (F.col("_block") == F.col("_b")), "left")
    return sources, materialize(blocks.select(
        F.col("_number").alias("_n"), F.col("_block").alias("_b"), "_full", "_ending", "_rest", "_times",
        F.coalesce("_draws", F.array().cast("array<int>")).alias("_draws")))


def with_block(rows: DataFrame, sources: DataFrame, seed: int, source_col: str) -> DataFrame:
    """Rows with their source's columns and ``_block``, the block a row's hash deals it into."""
    return (rows.join(sources, rows[source_col].eqNullSafe(sources["_s"]))
            .withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), "mix_key"), F.col("_blocks"))).drop("_s", "_blocks"))


def draw_rows(rows: DataFrame, plan: tuple[DataFrame, DataFrame], seed: int = 0, source_col: str = "source",
              size: Column | None = None) -> DataFrame:
    """Rows with ``mix_key`` and their columns of the mix. Rows of whole blocks take no part in a shuffle when
    the blocks are few enough to be broadcast; ``size`` may be given as an expression and is then computed only
    where rows are chosen one by one."""
    sources, blocks = plan
    dealt = with_block(rows, sources, seed, source_col).drop("_full", "_left")
    drawn = dealt.join(small(blocks, blocks.count()), (dealt["_number"] == blocks["_n"]) & (dealt["_block"] == blocks["_b"]))
    if size is not None:
        drawn = drawn.withColumn("size", size)
    whole = drawn.filter(~F.col("_ending")).withColumn("copies", F.col("_times").cast("int"))
    # where the rest ends: a prefix in hash order, then whatever small rows still fit
    within = Window.partitionBy("_number")
    running = within.orderBy("mix_key", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    by_size = within.orderBy("size", "mix_key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_size = F.when(~F.col("_first"), F.col("size")).otherwise(0)
    ends = (drawn.filter("_ending")
            .withColumn("_first", F.sum("size").over(running) <= F.col("_rest"))
            .withColumn("_spent", F.sum(F.when(F.col("_first"), F.col("size")).otherwise(0)).over(within))
            .withColumn("_second", F.sum(open_size).over(by_size) + F.col("_spent") <= F.col("_rest"))
            .withColumn("copies", (F.col("_full") + (F.col("_first") | F.col("_second")).cast("long")).cast("int"))
            .drop("_first", "_spent", "_second"))
    return (whole.unionByName(ends).withColumn("taken", F.col("copies") * F.col("size"))
            .withColumn("shards", F.slice("_draws", F.lit(1), F.col("copies")))
            .drop("_number", "_block", "_n", "_b", "_full", "_ending", "_rest", "_times", "_draws"))


def mix_plan(facts: DataFrame, seed: int = 0, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
             max_repeats: int = MAX_REPEATS, block_rows: int = BLOCK_ROWS, shards: int = SHARDS) -> DataFrame:
    """Adds ``source_size``, ``target``, ``copies``, ``taken`` and ``shards`` to rows with facts.

    ``copies`` says how often the row is in the mix and ``shards`` names the output shard of each copy.
    A null source is a source of its own, the last; rows without words never change a target and are
    drawn with their block. Taken words miss a target by less than the smallest row left over in the
    blocks where it ends. Ties and repeated rows: rows alike in id and text are interchangeable and share
    a block. An empty table gives no rows. Reruns agree: every draw follows hashes of the rows and ``seed``.
    """
    names = [f"column_{i}" if c not in (source_col, "size", "mix_key") else c for i, c in enumerate(facts.columns)]
    rows = facts.toDF(*names)                                              # so that no name can clash
    drawn = draw_rows(rows, block_plan(rows, seed, source_col, weights, max_repeats, block_rows, shards), seed, source_col)
    return drawn.withColumnsRenamed(dict(zip(names, facts.columns)))


def mixed_rows(plan: DataFrame, seed: int = 0) -> DataFrame:
    """One row per copy in the mix with its output shard ``mix_shard`` and order in it ``mix_order``."""
    copies = plan.select("*", F.posexplode("shards").alias("mix_copy", "mix_shard"))
    return copies.withColumn("mix_order", F.xxhash64(F.lit(seed + 4), "mix_key", "mix_copy"))


def shuffled(mix: DataFrame, parts: int, shards: int = SHARDS) -> DataFrame:
    """The mix laid out by output shard, each in its own order and in a number of parts, ready to be written."""
    part = F.floor(F.shiftrightunsigned("mix_order", 11) / 2.0 ** 53 * parts)
    return (mix.withColumn("mix_part", (F.col("mix_shard") * parts + part).cast("int"))
            .repartitionById(shards * parts, "mix_part").sortWithinPartitions("mix_part", "mix_order").drop("mix_part"))


def mix(df: DataFrame, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, shards: int = SHARDS) -> DataFrame:
    """The mix itself: rows of ``df``, each as often as it is drawn, laid out by output shard.

    Only keys and sizes of rows are planned with; texts move once, to their part of the output.
    """
    coded = df.toDF(*[f"column_{i}" for i in range(len(df.columns))])     # so that no name can clash
    names = dict(zip(df.columns, coded.columns))
    text, source = names[text_col], names[source_col]
    full = with_facts(coded, seed, names[id_col], text, source)
    facts = materialize(full.select(source, "size", "mix_key", F.octet_length(text).alias("_bytes")))
    plan = block_plan(facts, seed, source, weights, max_repeats, shards=shards)
    held = facts.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0]
    rows = draw_rows(full.drop("size"), plan, seed, source, word_size(F.col(text)))
    mixed = mixed_rows(rows.select(*coded.columns, "mix_key", "shards"), seed)
    return shuffled(mixed, max(1, -(-held // (shards * PART_BYTES))), shards).select(*coded.columns).toDF(*df.columns)
