"""Benchmark passages inside documents, up to a share of edited words.

Texts and items are sequences of word hashes and distance is the edit distance over words. The CGK
embedding walks a sequence with one random bit per (step, word): each step writes the current word and
the bit says whether to move on. Two sequences at a small edit distance come back into step after each
edit, so they agree in most steps: edit distance becomes Hamming distance. Each walk is sampled at a few
steps, again and again; a window and an item that agree in one sample are a candidate pair. Neighbouring windows that
agree somewhere are one run with their text, and the edit distance of an item to the best stretch of the run
decides. The longer an item, the longer walks are out of step, so every size class has as many walks as bring its
recall at the full share of edits to RECALL.

A window starts at every word of the items and is as long as an item of a size class with its edits. Most windows
are spared by two conditions that every true one meets: at d edits, a window holds at least n - d of the
n item words and n - 1 - 2d of the item's word pairs. Words, pairs and samples of items are kept as bit
tables of a fixed size; a shared slot only adds candidates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from grainsift.llm.common import free_name, small
from grainsift.llm.tokens import LETTERS, Words, mix, sequence_hash, word_slices
from grainsift.operators.materialize import materialize

SIMILARITY = 0.8
#: walks with bits of their own (of a class, at least), samples of each walk, steps in a sample
WALKS, SAMPLES, STEPS = 16, 4, 3
#: share of passages at the full share of edits that a class's walks must find, and random ones it is estimated from
RECALL, TRIALS = 0.995, 200
#: the least share of steps in which a passage is taken to agree
LEAST_AGREEMENT = 0.05
#: steps of walks that are held at once
HELD_STEPS = 4_000_000
#: slots of the bit tables, as a power of two
TABLE_BITS = 22
#: sizes of a class differ by this factor at most
CLASS_RATIO = 1.2
#: windows walked at once
WINDOW_BATCH = 4096
SEED = 7

_ODD, _TOP = np.uint32(0x9E3779B1), np.uint32(31)


def edits(n: int, similarity: float) -> int:
    """Most edits of an item of n words that count as the same passage."""
    return int(math.floor((1 - similarity) * n + 1e-9))


class SizeClass:
    """Items of similar size: what a window must hold, how long it is, and its walks."""

    def __init__(self, index: int, sizes: list[int], similarity: float):
        self.index = index
        self.edits = max(edits(n, similarity) for n in sizes)
        self.length = max(n + edits(n, similarity) for n in sizes)
        self.words = min(n - edits(n, similarity) for n in sizes)
        self.pairs = max(0, min(n - 1 - 2 * edits(n, similarity) for n in sizes))
        rng = np.random.Generator(np.random.PCG64([SEED, index]))
        # at half a word a step, a walk of 1.6 n steps seldom leaves the item
        self.steps = max(1, int(1.6 * min(sizes)))
        self.sample_steps = min(STEPS, self.steps)
        self.walks = self._walks(max(sizes), similarity, rng)
        self.samples = np.stack([[np.sort(rng.choice(self.steps, self.sample_steps, replace=False)) for _ in range(SAMPLES)]
                                 for _ in range(self.walks)])

    def _walks(self, n: int, similarity: float, rng: np.random.Generator) -> int:
        """Walks that miss at most 1 - RECALL of random passages with all allowed edits."""
        items = rng.integers(1, 1 << 63, (TRIALS, n), dtype=np.uint64)
        passages = np.zeros((TRIALS, self.length), np.uint64)
        for i, item in enumerate(items):
            words = edited(item, edits(n, similarity), rng)
            passages[i, :len(words)] = words
        agree = np.zeros((TRIALS, WALKS))
        for a, b in zip(self._walk(items, 0, WALKS), self._walk(passages, 0, WALKS)):
            agree += a == b
        agree = np.maximum(agree / self.steps, LEAST_AGREEMENT)
        missed = ((1 - agree ** self.sample_steps) ** SAMPLES).mean(axis=1)
        walks = WALKS
        while (missed ** walks).mean() > 1 - RECALL:
            walks += WALKS // 4
        return walks

    def _walk(self, windows: np.ndarray, first: int, last: int) -> Iterator[np.ndarray]:
        """The words (rows, walks), as 32 of their bits, that some of the walks write in each step."""
        count, width = windows.shape
        flat = np.zeros((count, max(width, self.steps)), np.uint32)      # a walk moves on by one word a step at most
        flat[:, :width] = windows >> np.uint64(32)
        at = np.repeat(np.arange(count) * flat.shape[1], last - first).reshape(count, -1)
        flat = flat.ravel()
        steps = np.arange(self.steps, dtype=np.uint64)[:, None] + mix(np.full(1, SEED + self.index, np.uint64))
        salts = (mix((np.arange(first, last, dtype=np.uint64) << np.uint64(32)) + steps) >> np.uint64(32)).astype(np.uint32)
        bits = np.empty(at.shape, np.uint32)
        for salt in salts:
            seen = flat.take(at)
            np.bitwise_xor(seen, salt, out=bits)
            bits *= _ODD
            bits >>= _TOP
            at += bits
            yield seen

    def keys(self, windows: np.ndarray) -> np.ndarray:
        """Sample keys (rows, walks * SAMPLES) of word sequences padded with zeros."""
        out = np.empty((len(windows), self.walks, SAMPLES), np.uint64)
        rows = max(1, HELD_STEPS // (self.steps * WALKS))
        for first in range(0, self.walks, WALKS):
            last = min(first + WALKS, self.walks)
            walk = np.arange(last - first)[:, None, None]
            names = (np.arange(first, last)[:, None] * SAMPLES + np.arange(SAMPLES)).astype(np.uint64) + np.uint64(self.index << 32)
            for at in range(0, len(windows), rows):
                seen = np.stack(list(self._walk(windows[at:at + rows], first, last)))
                sampled = seen[self.samples[first:last], :, walk]        # walk, sample, step, row
                key = np.broadcast_to(mix(names)[:, :, None], (last - first, SAMPLES, seen.shape[1]))
                for step in range(self.sample_steps):
                    key = (key ^ sampled[:, :, step]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out[at:at + rows, first:last] = np.moveaxis(key * np.uint64(0xBF58476D1CE4E5B9), 2, 0)
        return out.reshape(len(windows), -1)


def edited(item: np.ndarray, count: int, rng: np.random.Generator) -> np.ndarray:
    """The item with so many of its places replaced, removed or with a new word before them, at random."""
    kind = np.full(len(item), 3)
    kind[rng.choice(len(item), count, replace=False)] = rng.integers(0, 3, count)
    words = np.where(kind == 0, rng.integers(1, 1 << 63, len(item), dtype=np.uint64), item)
    times = np.array([1, 0, 2, 1])[kind]
    out = np.repeat(words, times)
    new = (np.cumsum(times) - times)[kind == 2]
    out[new] = rng.integers(1, 1 << 63, len(new), dtype=np.uint64)
    return out


def size_classes(sizes: list[int], similarity: float) -> dict[int, SizeClass]:
    by_class: dict[int, list[int]] = {}
    for n in sorted(set(sizes)):
        by_class.setdefault(int(math.log(n) / math.log(CLASS_RATIO)), []).append(n)
    return {c: SizeClass(c, members, similarity) for c, members in by_class.items()}


def class_of(n: int) -> int:
    return int(math.log(n) / math.log(CLASS_RATIO))


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def _pairs(words: np.ndarray) -> np.ndarray:
    return sequence_hash([words[:-1], words[1:]]) if len(words) > 1 else words[:0]


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in word_slices(batch.column(1), LETTERS):
            words = [part.hash[part.first[i]:part.first[i + 1]] for i in range(part.rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(part.row, part.rows), pa.array([w.tobytes() for w in words], pa.binary()),
                 pa.array([len(w) for w in words], pa.int32())], ["item_id", "item", "n_item_words"])


def _item_slots(classes: dict[int, SizeClass]):
    """Slots of the bit tables: kind 0 words, 1 word pairs, 2 samples."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item in batch["item"]:
                words = np.frombuffer(item, np.uint64)
                keys = classes[class_of(len(words))].keys(words[None, :])[0]
                for kind, hashes in enumerate((words, _pairs(words), keys)):
                    yield pd.DataFrame({"kind": kind, "slot": np.unique(_slot(hashes))})
    return run


def _item_keys(classes: dict[int, SizeClass]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, item in zip(batch["item_row"], batch["item"]):
                words = np.frombuffer(item, np.uint64)
                keys = np.unique(classes[class_of(len(words))].keys(words[None, :])[0])
                yield pd.DataFrame({"item_row": number, "key": keys.view(np.int64)})
    return run


def _table(slots: np.ndarray) -> bytes:
    bits = np.zeros(1 << TABLE_BITS, bool)
    bits[slots] = True
    return np.packbits(bits).tobytes()


def _ends(part: Words) -> np.ndarray:
    return np.repeat(part.first[1:], np.diff(part.first))


def _hits(classes: dict[int, SizeClass], tables) -> callable:
    """Runs of neighbouring windows that agree with some item's samples, with the words around them and the keys they share."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_in, pairs_in, keys_in = (np.unpackbits(np.frombuffer(t, np.uint8)).view(bool) for t in tables.value)
        for batch in batches:
            waiting: dict[int, list] = {c: [] for c in classes}
            for part in word_slices(batch.column(2), LETTERS):
                n = len(part.hash)
                if not n:
                    continue
                ends, rows = _ends(part), part.owner()
                first = words_in[_slot(part.hash)]
                known = np.concatenate([[0], np.cumsum(first)])
                pair = np.zeros(n, bool)
                if n > 1:
                    pair[:-1] = pairs_in[_slot(_pairs(part.hash))]
                    pair[part.first[1:][part.first[1:] > 0] - 1] = False
                known_pairs = np.concatenate([[0], np.cumsum(pair)])
                # some nearest place begins with a word of the item: another first word is as well left out
                places = np.flatnonzero(first)
                for c, size in classes.items():
                    stop = np.minimum(places + size.length, ends[places])
                    fits = places[(known[stop] - known[places] >= size.words)
                                  & (known_pairs[np.maximum(stop - 1, places)] - known_pairs[places] >= size.pairs)]
                    for at in range(0, len(fits), WINDOW_BATCH):
                        some = fits[at:at + WINDOW_BATCH]
                        begin = part.first[rows[some]]
                        reach = some[:, None] + np.arange(-size.edits, size.length)
                        region = part.hash[np.clip(reach, 0, n - 1)]
                        region[(reach >= ends[some][:, None]) | (reach < begin[:, None])] = 0
                        waiting[c].append((rows[some] + part.row, some - begin, region))
                        if sum(len(w[0]) for w in waiting[c]) >= WINDOW_BATCH:
                            yield from _runs(batch, classes[c], waiting[c], keys_in)
                            waiting[c] = []
            for c, left in waiting.items():
                yield from _runs(batch, classes[c], left, keys_in)
    return run


def _runs(batch: pa.RecordBatch, size: SizeClass, waiting: list, keys_in: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Windows that agree somewhere, those within a quarter of a window of the first as one row: ``start`` is the first
    place from which the words are given, ``free`` how many places after it may begin a passage, too."""
    if not waiting:
        return
    rows, starts, regions = (np.concatenate([w[i] for w in waiting]) for i in range(3))
    window, key = [], []
    for at in range(0, len(rows), WINDOW_BATCH):
        keys = size.keys(regions[at:at + WINDOW_BATCH, size.edits:])
        hit, column = np.nonzero(keys_in[_slot(keys)])
        window.append(at + hit)
        key.append(keys[hit, column])
    window, key = np.concatenate(window), np.concatenate(key)
    if not len(window):
        return
    at = np.flatnonzero(np.diff(window, prepend=-1))                     # first key of every window that hits
    firsts, bounds = [], []
    for i, w in zip(at, window[at]):
        if not firsts or rows[w] != rows[firsts[-1]] or not 0 <= starts[w] - starts[firsts[-1]] <= size.length // 4:
            firsts.append(w)
            bounds.append(i)
    bounds.append(len(window))
    out: dict[str, list] = {c: [] for c in ("row", "start", "free", "keys", "region")}
    for w, low, high in zip(firsts, bounds[:-1], bounds[1:]):
        last = window[high - 1]
        before, spread = min(size.edits, int(starts[w])), int(starts[last] - starts[w])
        out["row"].append(rows[w])
        out["start"].append(starts[w] - before)
        out["free"].append(before + spread)
        out["keys"].append(np.unique(key[low:high]).view(np.int64))
        tail = regions[last, regions.shape[1] - spread:] if spread else regions[last, :0]
        out["region"].append(np.concatenate([regions[w, size.edits - before:], tail]).tobytes())
    own = pa.array(np.array(out["row"]))
    yield pa.RecordBatch.from_arrays(
        [batch.column(0).take(own), batch.column(1).take(own), pa.array(np.array(out["start"], np.int64)),
         pa.array(np.array(out["free"], np.int32)), pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["region"], pa.binary())],
        ["id", "text_key", "start", "free", "keys", "region"])


def nearest_places(items: list[np.ndarray], regions: list[np.ndarray], free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of each item to the nearest stretch of its region that begins in one of the first ``free`` + 1 places,
    and the first such place (zeros at a region's end are no words)."""
    n, m = max(map(len, items)), max(map(len, regions))
    a, b = np.zeros((len(items), n), np.uint64), np.zeros((len(items), m), np.uint64)
    for i, (x, y) in enumerate(zip(items, regions)):
        a[i, :len(x)], b[i, :len(y)] = x, y
    sizes = np.array([len(x) for x in items])
    # a cell holds its distance and, below, the place where its stretch begins
    one = 1 << (int(free.max(initial=0)) + 1).bit_length()
    steps = np.arange(m + 1, dtype=np.int64) * one
    row = np.maximum(steps - free[:, None] * one, 0) + np.minimum(np.arange(m + 1), free[:, None])
    least = np.where(sizes == 0, 0, -1)
    void = np.concatenate([np.zeros((len(items), 1), bool), b == 0], axis=1)
    b[b == 0] = _NO_WORD                                                # agrees with no word of an item
    for i in range(n):
        match = (b != a[:, i:i + 1]) * np.int64(one)
        new = np.empty_like(row)
        new[:, 0] = row[:, 0] + one
        match += row[:, :-1]
        np.minimum(row[:, 1:] + one, match, out=new[:, 1:])
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        row = new
        done = sizes == i + 1
        if done.any():
            least[done] = np.where(void[done], 1 << 62, row[done]).min(axis=1)
    return least // one, least % one


_NO_WORD = np.uint64((1 << 64) - 1)


def prefix_distances(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Edit distance of each item to the nearest prefix of its region."""
    return nearest_places(items, regions, np.zeros(len(items), np.int64))[0]


def _distance(similarity: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                some = batch.iloc[at:at + 512].copy()
                items = [np.frombuffer(x, np.uint64) for x in some.pop("item")]
                regions = [np.frombuffer(x, np.uint64) for x in some.pop("region")]
                distance, place = nearest_places(items, regions, some.pop("free").to_numpy(np.int64))
                some["start"] += place
                some["distance"] = distance.astype(np.int32)
                allowed = np.array([edits(len(x), similarity) for x in items])
                yield some[some["distance"].to_numpy() <= allowed]
    return run


def find_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per text and item it holds: ``doc_id``, ``text_key``, ``item_id``, ``n_item_words``,
    ``start_word``, ``distance``, ``similarity``.

    Words are runs of ASCII letters, digits and characters beyond ASCII, with A-Z lower-cased. A text holds
    an item of n words when some place in it begins a stretch at word edit distance of at most
    (1 - ``similarity``) * n; the row names the nearest such place, the first of equals. Every distance is exact;
    random sampling can only miss pairs (the walks of each size of items are as many as find RECALL of random
    passages at the full share of edits; measured in the tests for items of 80 to 800 words). Null and empty texts and items without words hold and are nothing. Rows alike in id and text give
    one row; ``text_key`` (a hash of the text) tells texts with one id apart. Items sharing an id are all
    looked for and the nearest counts. Empty tables give no rows; other columns are not looked at.
    """
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    item_type = items.schema[item_id_col].dataType.simpleString()
    words = (items.select(F.col(item_id_col).alias("item_id"), F.col(item_text_col).alias("text"))
             .mapInArrow(_item_words, f"item_id {item_type}, item binary, n_item_words int").filter("n_item_words > 0"))
    # a number for each item row, so that items with a null id or one id stay apart
    words = materialize(words.distinct().withColumn("item_row", F.xxhash64("item_id", "item")))
    sizes = [r[0] for r in words.select("n_item_words").distinct().collect()]
    schema = f"doc_id {id_type}, text_key long, item_id {item_type}, n_item_words int, start_word long, distance int, similarity double"
    if not sizes:
        return spark.createDataFrame([], schema)
    classes = size_classes(sizes, similarity)
    slots = words.select("item").mapInPandas(_item_slots(classes), "kind int, slot long").distinct().toPandas()
    tables = spark.sparkContext.broadcast([_table(slots.loc[slots["kind"] == k, "slot"].to_numpy()) for k in range(3)])
    keys = words.select("item_row", "item").mapInPandas(_item_keys(classes), "item_row long, key long")

    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"), F.col(text_col).alias("text"))
    runs = materialize(texts.mapInArrow(
        _hits(classes, tables), f"id {id_type}, text_key long, start long, free int, keys array<long>, region binary")
        .withColumn("run", F.monotonically_increasing_id()))
    n_items = words.count()
    pairs = (runs.select("run", F.explode("keys").alias("key"))
             .join(small(keys, n_items * max(c.walks for c in classes.values()) * SAMPLES), "key")
             .select("run", "item_row").distinct())
    known = words.withColumnRenamed("item_row", "_row")
    near = (pairs.join(runs.drop("keys"), "run").join(small(known, n_items), F.col("item_row") == F.col("_row"))
            .select("id", "text_key", "start", "free", "item_id", "n_item_words", "item", "region")
            .mapInPandas(_distance(similarity), f"id {id_type}, text_key long, start long, item_id {item_type}, "
                                                "n_item_words int, distance int"))
    best = F.min(F.struct((F.col("distance") / F.col("n_item_words")).alias("share"), "start", "distance", "n_item_words"))
    return (near.groupBy("id", "text_key", "item_id").agg(best.alias("best"))
            .select(F.col("id").alias("doc_id"), "text_key", "item_id", "best.n_item_words",
                    F.col("best.start").alias("start_word"), "best.distance",
                    (1 - F.col("best.share")).alias("similarity")))


def drop_leaks(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no item; columns and repeated rows as they were."""
    leaks = find_leaks(docs, items, similarity, id_col, text_col)
    leak_id, leak_key = free_name(docs, "_leak_id"), free_name(docs, "_leak_key")
    keys = materialize(leaks.select("doc_id", "text_key").distinct().toDF(leak_id, leak_key))
    return docs.join(small(keys, keys.count()), docs[id_col].eqNullSafe(keys[leak_id])
                     & (F.xxhash64(docs[text_col]) == keys[leak_key]), "left_anti")
