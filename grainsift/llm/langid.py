"""Language of a text: known words first, shorter and shorter character n-grams for unseen words.

A word that the model knows adds its log frequency in each language. Another word falls back to its
character n-grams: of the orders 5 to 1, the longest of which some n-gram is known gives the mean log
frequency of its known n-grams. The language with the greatest sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from grainsift.llm.common import free_name
from grainsift.llm.tokens import COPIED_ROWS, LETTERS, HashIndex, Words, sequence_hash, word_slices
from grainsift.operators.materialize import materialize

#: documents per language that the model is fitted on, at most: the smallest by a hash of their text
TRAIN_DOCS = 3_000
#: words kept per language, the most frequent, seen at least twice; and n-grams likewise
MODEL_WORDS = 40_000
MODEL_GRAMS = 15_000
ORDERS = (5, 4, 3, 2, 1)
SMOOTHING = 0.5
#: words that count in full towards the certainty of an answer
CERTAIN_WORDS = 20


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray
    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray


def gram_hashes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character n-grams of each word (blank before and after it included), and their word."""
    points = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = points == 32
    word = np.cumsum(blank) - 1                       # a blank belongs to the word after it
    count = len(points) - order + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = np.zeros(count, np.int64)
    for i in range(1, order - 1):
        inner += blank[i:i + count]
    ends = blank[:count].astype(np.int64) + (blank[order - 1:order - 1 + count] if order > 1 else 0)
    good = (inner == 0) & (ends < order)
    hashes = sequence_hash([np.full(count, order, np.uint64), *(points[i:i + count] for i in range(order))])
    return hashes[good], word[:count][good]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, hash, n) of words (kind 0) and n-grams of distinct words' occurrences (kind 1)."""
    for batch in batches:
        langs = batch.column(0).to_pandas()
        for part in word_slices(batch.column(1), LETTERS):
            owner = langs.iloc[part.row:part.row + part.rows].to_numpy()
            for lang in pd.unique(owner):
                pick = np.isin(part.owner(), np.flatnonzero(owner == lang))
                hashes, first, n = np.unique(part.hash[pick], return_index=True, return_counts=True)
                texts = [part.text(i) for i in np.flatnonzero(pick)[first]]
                if not texts:
                    continue
                found = [(0, hashes, n)]
                for order in ORDERS:
                    grams, word = gram_hashes(texts, order)
                    keys, at = np.unique(grams, return_inverse=True)
                    found.append((order, keys, np.bincount(at, weights=n[word]).astype(np.int64)))
                for kind, keys, counts in found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.int32()),
                         pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "kind", "hash", "n"])


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> Model | None:
    """Model from labelled rows (rows without text or language are left out); None if there are none.

    The sample follows a hash of whole rows, so that copies of a text under ids of their own come in by their share.
    """
    content = [F.col(f.name) for f in labelled.schema.fields if isinstance(f.dataType, AtomicType)]
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"),
                           F.xxhash64(*content).alias("_order")).dropna()
    order = F.col("_order")
    # the bounded sample: a threshold on the hash first, so that only about the sample is ranked
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, 1.5 * train_docs / n + 100 / n))])
    near = rows.filter(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(order, "text"))
    sample = near.withColumn("_rank", rank).filter(F.col("_rank") <= train_docs).select("lang", "text")
    counted = (sample.mapInArrow(_counts, "lang string, kind int, hash long, n long")
               .groupBy("lang", "kind", "hash").agg(F.sum("n").alias("n")))
    counted = materialize(counted)
    languages = sorted(sizes)
    position = {lang: i for i, lang in enumerate(languages)}
    prior = np.log(np.array([sizes[lang] for lang in languages], float) / sum(sizes.values()))
    totals = np.ones((len(ORDERS) + 1, len(languages)))
    for r in counted.groupBy("lang", "kind").agg(F.sum("n").alias("n")).collect():
        totals[r["kind"], position[r["lang"]]] = r["n"]
    best = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "hash"))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in position.items() for x in pair]), F.col("lang"))
    keep = (counted.withColumn("rank", best)
            .filter((F.col("rank") <= F.when(F.col("kind") == 0, MODEL_WORDS).otherwise(MODEL_GRAMS))
                    & ((F.col("n") > 1) | (F.col("kind") > 0)))
            .select(number.alias("lang"), "kind", "hash", F.col("n").cast("int").alias("n")).toPandas())

    def scores(kind: int) -> tuple[np.ndarray, np.ndarray]:
        part = keep[keep["kind"] == kind]
        keys, at = np.unique(part["hash"].to_numpy().view(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(languages)), np.float32)
        table[at, part["lang"].to_numpy()] = part["n"]
        return keys, np.log((table + SMOOTHING) / (totals[kind] + SMOOTHING * max(len(keys), 1))).astype(np.float32)

    words, word_scores = scores(0)
    parts = [scores(order) for order in ORDERS]
    return Model(languages, prior, words, word_scores, np.concatenate([p[0] for p in parts]),
                 np.concatenate([p[1] for p in parts]))


class Scorer:
    """Sums of a model's scores over the words of texts."""

    def __init__(self, model: Model):
        self.model = model
        self.words, self.grams = HashIndex(model.words), HashIndex(model.grams)

    def backoff(self, texts: list[str]) -> np.ndarray:
        """Scores of unseen words; zero in all languages where no n-gram is known."""
        size = len(self.model.languages)
        out, open_ = np.zeros((len(texts), size), np.float32), np.ones(len(texts), bool)
        for order in ORDERS:
            left = np.flatnonzero(open_)
            if not len(left):
                break
            hashes, word = gram_hashes([texts[i] for i in left], order)
            at = self.grams.find(hashes)
            known = at >= 0
            n = np.bincount(word[known], minlength=len(left))
            hit = n > 0
            for lang in range(size):
                total = np.bincount(word[known], weights=self.model.gram_scores[at[known], lang], minlength=len(left))
                out[left[hit], lang] = total[hit] / n[hit]
            open_[left[hit]] = False
        return out

    def sums(self, part: Words) -> tuple[np.ndarray, np.ndarray]:
        """Per row: score sums by language, and words that had a score."""
        at = self.words.find(part.hash)
        unseen = np.flatnonzero(at < 0)
        owner = part.owner()
        known = np.flatnonzero(at >= 0)
        size = len(self.model.languages)
        total = np.zeros((part.rows, size))
        used = np.bincount(owner[known], minlength=part.rows)
        for lang in range(size):
            total[:, lang] = np.bincount(owner[known], weights=self.model.word_scores[at[known], lang],
                                         minlength=part.rows)
        if len(unseen):
            _, first, which = np.unique(part.hash[unseen], return_index=True, return_inverse=True)
            scores = self.backoff([part.text(i) for i in unseen[first]])
            scored = scores.any(axis=1)[which]
            used = used + np.bincount(owner[unseen][scored], minlength=part.rows)
            for lang in range(size):
                total[:, lang] += np.bincount(owner[unseen], weights=scores[which, lang], minlength=part.rows)
        return total, used


def _has_letter(part: Words) -> np.ndarray:
    letters = np.zeros(256, bool)
    letters[97:123] = True
    marks = np.concatenate([[0], np.cumsum(letters[part.data])])
    found = marks[part.offsets[1:]] > marks[part.offsets[:-1]]
    for i in np.flatnonzero(~found):
        text = part.data[part.offsets[i]:part.offsets[i + 1]].tobytes().decode("utf-8", "replace")
        found[i] = any(c.isalpha() for c in text)
    return found


def answers(scorer: Scorer, part: Words) -> tuple[list[str], np.ndarray]:
    total, used = scorer.sums(part)
    weight = np.minimum(1.0, CERTAIN_WORDS / np.maximum(used, 1))
    logits = (total + scorer.model.prior) * weight[:, None]
    logits = np.exp(logits - logits.max(axis=1, keepdims=True))
    share = logits / logits.sum(axis=1, keepdims=True)
    best, letter = (total + scorer.model.prior).argmax(axis=1), _has_letter(part)
    names = [scorer.model.languages[b] if ok else "und" for b, ok in zip(best, letter)]
    return names, np.where(letter, share[np.arange(len(best)), best], 0.0)


def predict_language(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (0 to 1: the language's share when at most CERTAIN_WORDS words count).

    A null or empty text, or one without a letter, is ``und`` with score 0; so is every text under no
    model. A text whose words all lack known n-grams gets the most frequent language. Ties go to the language
    first in code-point order. Every text counts whole, rows are judged one by one, and an empty table
    gives no rows. Columns of ``df`` named like the results are replaced.
    """
    if model is None:
        return df.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        bytes_at_once = max(100_000, 4_000_000 // max(4, len(scorer.model.languages)))
        for batch in batches:
            names, scores = [], []
            for at in range(0, len(batch), COPIED_ROWS):
                texts = pa.array(batch.iloc[at:at + COPIED_ROWS], pa.string(), from_pandas=True)
                for part in word_slices(texts, LETTERS, bytes_at_once):
                    n, s = answers(scorer, part)
                    names += n
                    scores.append(s)
            yield pd.DataFrame({"lang_pred": pd.Series(names, dtype=object),
                                "score": np.concatenate(scores) if scores else np.zeros(0)})

    answer = free_name(df, "_answer")
    judged = df.withColumn(answer, judge(F.col(text_col)))
    return judged.withColumns({"lang_pred": F.col(answer)["lang_pred"], "score": F.col(answer)["score"]}).drop(answer)
