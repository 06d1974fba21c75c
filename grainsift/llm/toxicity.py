"""Toxicity of texts: a bidirectional recurrent network with attention over all overlapping windows.

Labels say that a text is toxic, not where. Counts over the labelled texts give every word and character
n-gram its evidence (how much oftener than expected it stands in toxic texts). The windows with most evidence
in toxic texts and some windows of other texts train the network; then it picks the windows itself and is
trained on. A text's score is a logistic function of the logits of its TOP most toxic windows and of its number
of windows, fitted on texts that the network was not trained on: one odd word in a long text is chance, several
windows of the kind are not.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from grainsift.llm import gru
from grainsift.llm.common import free_name
from grainsift.llm.langid import gram_hashes
from grainsift.llm.tokens import COPIED_ROWS, LETTERS, HashIndex, Words, word_slices
from grainsift.operators.materialize import materialize

WINDOW, STRIDE = 48, 24
#: labelled texts that are learned from, per label at most (the smallest by a hash), and their longest size
EVIDENCE_DOCS = {1: 4_000, 0: 12_000}
TRAIN_CHARS = 12_000
#: of these, texts that the network is fitted on, per label at most
TRAIN_DOCS = {1: 1_000, 0: 2_000}
#: words and n-grams with embeddings of their own: those with most evidence, in three texts at least
MODEL_WORDS, MODEL_GRAMS = 6_000, 20_000
ORDERS = (3, 4, 5)
EVIDENCE_LIMIT = 4.0
EPOCHS = (5, 3)
TOP = 4
FLOOR = -8.0
HELD_SHARE = 0.25
BATCH = 256
#: distinct words whose n-grams are looked up at once
KNOWN_WORDS = 30_000
RATE = 0.01
SEED = 3


@dataclass
class Model:
    words: np.ndarray
    grams: np.ndarray
    weights: dict[str, np.ndarray]
    combine: np.ndarray


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, hash, texts with it, toxic texts with it) per slice; kind 0 is words."""
    for batch in batches:
        toxic = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
        for part in word_slices(batch.column(1), LETTERS):
            if not len(part.hash):
                continue
            keys, first, which = np.unique(part.hash, return_index=True, return_inverse=True)
            pairs = np.unique(part.owner() * len(keys) + which)
            row, word = pairs // len(keys), pairs % len(keys)
            found = [(0, keys[word], row)]
            texts = [part.text(i) for i in first]
            for order in ORDERS:
                grams, owner = gram_hashes(texts, order)
                slots, at = np.unique(grams, return_inverse=True)
                starts = np.searchsorted(owner, np.arange(len(texts) + 1))
                n = np.diff(starts)[word]
                rows = np.repeat(row, n)
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                ids = at[np.repeat(starts[:-1][word], n) + inner]
                both = np.unique(rows * len(slots) + ids) if len(slots) else np.zeros(0, np.int64)
                found.append((order, slots[both % max(len(slots), 1)], both // max(len(slots), 1)))
            for kind, hashes, rows in found:
                keys_, at = np.unique(hashes, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys_), kind, np.int32)), pa.array(keys_.view(np.int64)),
                     pa.array(np.bincount(at, minlength=len(keys_)).astype(np.int64)),
                     pa.array(np.bincount(at, weights=toxic[part.row + rows], minlength=len(keys_)).astype(np.int64))],
                    ["kind", "hash", "n", "toxic"])


class Lookup:
    """Rows of a model's embeddings for words."""

    def __init__(self, words: np.ndarray, grams: np.ndarray):
        self.words, self.grams = HashIndex(words), HashIndex(grams)

    def rows(self, part: Words) -> tuple[np.ndarray, ...]:
        """Per distinct word: row in words; per known n-gram: row in grams and its word; per word the scale of
        its n-grams; and per occurrence its distinct word."""
        keys, first, which = np.unique(part.hash, return_index=True, return_inverse=True)
        return *self.known(keys, lambda i: part.text(first[i])), which

    def known(self, keys: np.ndarray, text: Callable[[int], str]) -> tuple[np.ndarray, ...]:
        """``rows`` of distinct words by their hashes, less the occurrences; ``text`` gives the word at a place in them."""
        word = self.words.find(keys).astype(np.int32)
        grams, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        counts = np.ones(len(keys))
        for lo in range(0, len(keys), KNOWN_WORDS):
            texts = [text(i) for i in range(lo, min(lo + KNOWN_WORDS, len(keys)))]
            for order in ORDERS:
                hashes, owner = gram_hashes(texts, order)
                counts[lo:lo + KNOWN_WORDS] += np.bincount(owner, minlength=len(texts))
                at = self.grams.find(hashes)
                grams.append(at[at >= 0].astype(np.int32))
                owners.append((owner[at >= 0] + lo).astype(np.int32))
        return word, np.concatenate(grams), np.concatenate(owners), (1 / np.sqrt(counts)).astype(np.float32)

    def table(self, texts: pd.Series) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """``rows`` of all texts together, and the place of each text's first word (one entry more than texts).

        Slice by slice, as this runs on the driver: beside a slice only distinct words and a number per occurrence
        are held.
        """
        seen, new, spelled, parts, first = np.zeros(0, np.uint64), [], [], [], [np.zeros(1, np.int64)]
        for at in range(0, len(texts), COPIED_ROWS):
            for part in word_slices(pa.array(texts.iloc[at:at + COPIED_ROWS], pa.string(), from_pandas=True), LETTERS):
                keys, place, which = np.unique(part.hash, return_index=True, return_inverse=True)
                fresh = ~np.isin(keys, seen, assume_unique=True)
                seen = np.union1d(seen, keys[fresh])
                new.append(keys[fresh])
                spelled += [part.text(i) for i in place[fresh]]
                parts.append((keys, which.astype(np.int32)))
                first.append(part.first[1:] + first[-1][-1])
        order = np.argsort(np.concatenate([seen[:0], *new]))
        which = np.concatenate([np.zeros(0, np.int32), *(np.searchsorted(seen, keys).astype(np.int32)[at] for keys, at in parts)])
        return (*self.known(seen, lambda i: spelled[order[i]]), which), np.concatenate(first)


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all overlapping windows, their ends, and their row; a row without words has none."""
    sizes = np.diff(first)
    count = np.where(sizes > 0, 1 + -(-np.maximum(sizes - WINDOW, 0) // STRIDE), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][row] + place * STRIDE
    return start, np.minimum(start + WINDOW, first[1:][row]), row


def _steps(start: np.ndarray, end: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = start[None, :] + np.arange(WINDOW)[:, None]
    here = at < end[None, :]
    return which[np.minimum(at, len(which) - 1)], here


def window_logits(weights: dict, vectors: np.ndarray, which: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out, inputs = np.empty(len(start), np.float32), gru.projected(weights, vectors)
    for at in range(0, len(start), 2048):
        rows, here = _steps(start[at:at + 2048], end[at:at + 2048], which)
        out[at:at + 2048] = gru.forward(weights, inputs, rows, here)
    return out


def _train(weights: dict, rows: tuple, start: np.ndarray, end: np.ndarray, target: np.ndarray, epochs: int,
           rng: np.random.Generator) -> None:
    word, gram, owner, scale, which = rows
    adam = gru.Adam(weights, RATE)
    by_owner = np.argsort(owner, kind="stable")
    gram_of, bounds = gram[by_owner], np.searchsorted(owner[by_owner], np.arange(len(word) + 1))
    cost = np.where(target > 0, 0.5 / max(target.sum(), 1), 0.5 / max((1 - target).sum(), 1)) * len(target)
    for _ in range(epochs):
        order = rng.permutation(len(start))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            steps, here = _steps(start[pick], end[pick], which)
            used, local = np.unique(steps, return_inverse=True)
            n = np.diff(bounds)[used]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            grams = gram_of[np.repeat(bounds[:-1][used], n) + inner]
            _, grad = gru.gradient(weights, word[used], grams, np.repeat(np.arange(len(used)), n), scale[used],
                                   local.reshape(steps.shape), here, target[pick], cost[pick].astype(np.float32))
            adam.step(weights, grad)


def _top_windows(level: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Position of each row's window of greatest level (rows with windows only)."""
    order = np.lexsort((-level, row))
    heads = np.searchsorted(row[order], np.arange(rows))
    have = np.bincount(row, minlength=rows) > 0
    return order[heads[have]]


def text_features(logits: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Per text: 1, its TOP greatest window logits (FLOOR where it has fewer) and the log of its windows."""
    order = np.lexsort((-logits, row))
    count = np.bincount(row, minlength=rows)
    heads = np.cumsum(count) - count
    out = np.full((rows, TOP + 2), FLOOR)
    out[:, 0], out[:, -1] = 1.0, np.log1p(count)
    for k in range(TOP):
        have = count > k
        out[have, 1 + k] = np.clip(logits[order[heads[have] + k]], FLOOR, -FLOOR)
    return out


def combine(features: np.ndarray, toxic: np.ndarray, penalty: float = 0.3, rounds: int = 30) -> np.ndarray:
    """Logistic regression by damped Newton steps, drawn towards the greatest logit alone."""
    start = np.zeros(features.shape[1])
    start[1] = 1.0

    def loss(w: np.ndarray) -> float:
        x = features @ w
        return float((np.logaddexp(0, x) - toxic * x).sum() + penalty / 2 * ((w - start) ** 2).sum())

    w = start.copy()
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (chance - toxic) + penalty * (w - start)
        curve = (features * (chance * (1 - chance))[:, None]).T @ features + penalty * np.eye(len(w))
        step, size = np.linalg.solve(curve, slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """A bounded sample of labelled texts: (toxic, text). Ids are chosen among the labels first, and of more ids than
    are wanted those with texts of at most TRAIN_CHARS characters go first, so that no text is moved but the sample's.

    Longer texts fill up a label that has too few short ones, each by TRAIN_CHARS characters from a place that
    its id decides. An id with both labels teaches nothing; equal labels of one id count each time, and so do rows of
    one id. Rows without id, text or label are left out.
    """
    marked = (labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
              .filter(F.col("toxic").isin(0, 1) & F.col("id").isNotNull())
              .groupBy("id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("_most"), F.count("*").alias("times"))
              .filter(F.col("toxic") == F.col("_most")).drop("_most"))
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    chosen = [marked.filter((F.col("toxic") == label) & (order < int(min(1.0, 2.4 * most / sizes.get(label, 1) + 0.01) * (1 << 30))))
              .orderBy(order, "id").limit(2 * most) for label, most in EVIDENCE_DOCS.items()]
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    length = rows.select("_id", (F.length("text") > TRAIN_CHARS).cast("int").alias("long"))
    facts = materialize(length.join(F.broadcast(chosen[0].union(chosen[1])), F.col("_id") == F.col("id"))
                        .groupBy("id", "toxic", "times").agg(F.max("long").alias("long")))
    best = [facts.filter(F.col("toxic") == label).orderBy("long", order, "id").limit(most) for label, most in EVIDENCE_DOCS.items()]
    joined = rows.join(F.broadcast(best[0].union(best[1])), F.col("_id") == F.col("id"))
    start = F.pmod(F.xxhash64("id"), F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    part = F.when(F.length("text") > TRAIN_CHARS, F.substring("text", start, F.lit(TRAIN_CHARS))).otherwise(F.col("text"))
    return joined.select("toxic", part.alias("text"), F.explode(F.sequence(F.lit(1).cast("long"), "times"))).select("toxic", "text")


def fit(sample: DataFrame, seed: int = SEED) -> Model | None:
    """Model from texts with a label of 0 or 1 (``text``, ``toxic``); None without texts of both labels.

    The evidence counts all given texts; the network sees some of them, each text once.
    """
    rows = materialize(sample.select(F.col("toxic").cast("int").alias("toxic"), "text").filter(
        F.col("toxic").isin(0, 1) & F.col("text").isNotNull()))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(sizes) != {0, 1}:
        return None
    order = F.xxhash64("text")
    def near(label: int) -> pd.DataFrame:
        # the last hash first, so that only texts that are wanted come to the driver
        own = rows.filter(F.col("toxic") == label)
        last = own.select(order.alias("order")).distinct().orderBy("order").limit(TRAIN_DOCS[label]).agg(F.max("order")).first()[0]
        return own.filter(order <= last).dropDuplicates(["text"]).orderBy(order, "text").limit(TRAIN_DOCS[label]).toPandas()
    sample = pd.concat([near(1), near(0)], ignore_index=True)

    rate = sizes[1] / (sizes[0] + sizes[1])
    expected = F.col("n") * rate
    counted = (rows.mapInArrow(_evidence, "kind int, hash long, n long, toxic long").groupBy("kind", "hash")
               .agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).filter("n >= 3")
               .withColumn("z", (F.col("toxic") - expected) / F.sqrt(expected + 1)).select("kind", "hash", "z"))
    counted = materialize(counted)
    def most(words: bool, size: int) -> pd.DataFrame:
        picked = counted.filter("kind = 0" if words else "kind > 0")
        return picked.orderBy(F.desc(F.abs("z")), "hash").limit(size).select("hash", "z").toPandas()
    parts = []
    for words, size in ((True, MODEL_WORDS), (False, MODEL_GRAMS)):
        found = most(words, size).drop_duplicates("hash")
        parts.append((found["hash"].to_numpy().view(np.uint64),
                      np.clip(found["z"].to_numpy(float), -EVIDENCE_LIMIT, EVIDENCE_LIMIT) / EVIDENCE_LIMIT))
    (words, word_level), (grams, gram_level) = parts

    rng = np.random.Generator(np.random.PCG64(seed))
    weights = gru.initial(word_level, gram_level, seed)
    toxic = sample["toxic"].to_numpy()
    table, first = Lookup(words, grams).table(sample["text"])
    del sample
    word, gram, owner, scale, which = table
    word[word < 0] = len(words)
    start, end, row = windows(first)
    texts = len(first) - 1
    held = rng.random(texts) < HELD_SHARE               # texts that only fit the last step
    if not (held & (toxic == 1)).any() or not (held & (toxic == 0)).any():
        held[:] = False

    level = np.maximum(np.append(word_level, 0)[word], 0)
    np.maximum.at(level, owner, gram_level[gram])
    level **= 2
    marks = np.zeros(len(which) + 1)
    np.cumsum(level[which], out=marks[1:])
    picked = marks[end] - marks[start]
    del marks
    fitting = ~held[row]
    for epochs in EPOCHS:
        top = _top_windows(picked, row, texts)
        chance = rng.random(len(row)) < 1.5 * texts / max(len(row), 1)
        use = np.zeros(len(row), bool)
        use[top] = True
        use |= chance & (toxic[row] == 0)
        use &= fitting
        at = np.flatnonzero(use)
        _train(weights, table, start[at], end[at], toxic[row[at]].astype(np.float32), epochs, rng)
        vectors = gru.word_vectors(weights, word, gram, owner, scale)
        picked = window_logits(weights, vectors, which, start, end)
    measured = held if held.any() else np.ones(texts, bool)
    facts = text_features(picked, row, texts)
    return Model(words, grams, weights, combine(facts[measured], toxic[measured]))


def _score(model: Model, lookup: Lookup, part: Words) -> np.ndarray:
    if len(part.hash):
        word, gram, owner, scale, which = lookup.rows(part)
        word[word < 0] = len(model.words)
        start, end, row = windows(part.first)
        vectors = gru.word_vectors(model.weights, word, gram, owner, scale)
        facts = text_features(window_logits(model.weights, vectors, which, start, end), row, part.rows)
    else:
        facts = text_features(np.zeros(0), np.zeros(0, np.int64), part.rows)
    return 1 / (1 + np.exp(-np.clip(facts @ model.combine, -30, 30)))


def scorer(spark: SparkSession, model: Model) -> Callable[[Column], Column]:
    """A function from a text column to its scores."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = shared.value
        lookup = Lookup(model.words, model.grams)
        for batch in batches:
            scores = [_score(model, lookup, part) for at in range(0, len(batch), COPIED_ROWS)
                      for part in word_slices(batch.slice(at, COPIED_ROWS), LETTERS)]
            yield pa.array(np.concatenate(scores) if scores else np.zeros(0))

    return judge


def score_toxicity(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from a score of 0.5 on) to each row.

    Every overlapping window of WINDOW words of a text counts; a shorter text is one window. A text
    without words, empty or null, scores as one without toxic windows, and every text has score 0 under no
    model. Rows are scored one by one, so repeated rows score alike and an empty table gives no rows. Columns
    of ``df`` named like the results are replaced.
    """
    score = F.lit(0.0) if model is None else scorer(df.sparkSession, model)(F.col(text_col))
    out = free_name(df, "_toxic_score")
    scored = df.withColumn(out, score)
    return scored.withColumns({"score": F.col(out), "predicted": (F.col(out) >= 0.5).cast("int")}).drop(out)


def drop_toxic(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text scores below 0.5; all rows under no model. Columns are as they were."""
    if model is None:
        return df
    return df.filter(scorer(df.sparkSession, model)(F.col(text_col)) < 0.5)
