"""Main text of web pages by a linear-chain conditional random field over leaf blocks."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from grainsift.llm.common import free_name
from grainsift.llm.pages import Block, blocks, labelled_blocks, labelled_layout

#: pages that lend their paragraphs to the labelled layouts, at most (the smallest by a hash), and layouts from each
TRAIN_PAGES = 200
LAYOUTS = 4
#: longest page taken for learning, in characters, and its paragraphs
TRAIN_CHARS = 60_000
TRAIN_PARAGRAPHS = 12
ITERATIONS = 250
PENALTY = 2e-6

_BUILT_IN = ["The river rose again last night and the lower road was closed until the morning.",
             "A new library opened in the old station, with rooms for reading and a small hall for talks.",
             "Prices for bread and milk fell a little this month, the office said on Monday.",
             "Der Zug kam spät an, und viele Leute warteten auf dem Platz vor dem Bahnhof.",
             "La fête du village commence samedi avec un marché et un concert sur la place.",
             "El museo abre sus puertas el domingo y la entrada es libre para los niños."]


@dataclass
class Chain:
    """Weights per feature and label, of label pairs, and of the first label."""

    features: dict[str, tuple[float, float]]
    step: np.ndarray
    first: np.ndarray


def _size_class(n: int) -> int:
    return min(8, n.bit_length())


def features(block: Block, place: int, count: int, before: Block | None) -> list[str]:
    text, words = block.text, block.text.count(" ") + 1
    share = block.linked / len(text)
    marks = sum(text.count(c) for c in ".,;!?")
    found = ["bias", f"words{_size_class(words)}", f"tag:{block.tag}", f"linked{int(share * 4)}",
             f"marks{min(4, marks)}", f"end:{text[-1] in '.!?…'}", f"place{int(4 * place / count)}",
             f"words{_size_class(words)}:{block.tag}", f"after:{before.tag if before else 'start'}:{block.tag}",
             f"same:{before is not None and before.path == block.path}"]
    found += [f"in:{t}" for t in set(block.path)]
    found.append(f"box:{block.box}")
    found += [f"name:{n}" for n in block.names]
    if words < 12 and re.search(r"©|\(c\)|copyright|cookie|newsletter|all rights reserved", text, re.I):
        found.append("note")
    return found


def _page_features(found: list[Block]) -> list[list[str]]:
    return [features(b, i, len(found), found[i - 1] if i else None) for i, b in enumerate(found)]


def fit_chain(examples: list[tuple[list[list[str]], list[int]]], iterations: int = ITERATIONS) -> Chain:
    """Weights of greatest penalised likelihood, by full passes with adaptive steps."""
    examples = [e for e in examples if e[1]]
    names = {name: i for i, name in enumerate(sorted({n for rows, _ in examples for row in rows for n in row}))}
    pages, longest = len(examples), max(len(y) for _, y in examples)
    labels, here = np.zeros((pages, longest), int), np.zeros((pages, longest), bool)
    cell, column = [], []
    for p, (rows, y) in enumerate(examples):
        labels[p, :len(y)], here[p, :len(y)] = y, True
        for t, row in enumerate(rows):
            cell += [p * longest + t] * len(row)
            column += [names[n] for n in row]
    cell, column = np.array(cell), np.array(column)
    size = len(names)
    weights = np.zeros(2 * size + 6)
    moment, square = np.zeros_like(weights), np.zeros_like(weights)
    seen = np.zeros(2 * size + 6)
    hit = labels.reshape(-1)[cell]
    np.add.at(seen, hit * size + column, 1.0)
    both = here[:, 1:]
    np.add.at(seen, 2 * size + (labels[:, :-1] * 2 + labels[:, 1:])[both], 1.0)
    np.add.at(seen, 2 * size + 4 + labels[:, 0], 1.0)
    last = here.sum(axis=1) - 1
    for n in range(1, iterations + 1):
        emit = np.stack([np.bincount(cell, weights=weights[l * size + column], minlength=pages * longest) for l in (0, 1)],
                        axis=1).reshape(pages, longest, 2)
        step, first = weights[2 * size:2 * size + 4].reshape(2, 2), weights[2 * size + 4:]
        forward, backward = np.zeros_like(emit), np.zeros_like(emit)
        forward[:, 0] = first + emit[:, 0]
        for t in range(1, longest):
            forward[:, t] = np.logaddexp(forward[:, t - 1, :1] + step[0], forward[:, t - 1, 1:] + step[1]) + emit[:, t]
        for t in range(longest - 2, -1, -1):
            to = step[None] + (emit[:, t + 1] + backward[:, t + 1])[:, None, :]
            backward[:, t] = np.where(here[:, t + 1, None], np.logaddexp(to[:, :, 0], to[:, :, 1]), 0.0)
        total = np.logaddexp(*forward[np.arange(pages), last].T)
        chance = np.exp(forward + backward - total[:, None, None]) * here[:, :, None]
        pair = np.exp(forward[:, :-1, :, None] + step + (emit[:, 1:] + backward[:, 1:])[:, :, None, :]
                      - total[:, None, None, None]) * both[:, :, None, None]
        expected = np.concatenate([
            *[np.bincount(column, weights=chance.reshape(-1, 2)[cell, l], minlength=size) for l in (0, 1)],
            pair.sum(axis=(0, 1)).reshape(-1), chance[:, 0].sum(axis=0)])
        slope = (expected - seen) / here.sum() + PENALTY * weights
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope ** 2
        weights -= 0.1 * (moment / (1 - 0.9 ** n)) / (np.sqrt(square / (1 - 0.99 ** n)) + 1e-8)
    return Chain({name: (float(weights[i]), float(weights[size + i])) for name, i in names.items()},
                 weights[2 * size:2 * size + 4].reshape(2, 2).copy(), weights[2 * size + 4:].copy())


def decode(chain: Chain, rows: list[list[str]]) -> list[int]:
    """Best labels of a page's blocks (Viterbi); of equals, the smaller label."""
    if not rows:
        return []
    known, back = chain.features, []
    (s00, s01), (s10, s11) = chain.step.tolist()
    a, b = chain.first.tolist()
    for t, row in enumerate(rows):
        x = y = 0.0
        for name in row:
            w = known.get(name)
            if w:
                x += w[0]
                y += w[1]
        if t:
            back.append((b + s10 > a + s00, b + s11 > a + s01))
            a, b = max(a + s00, b + s10), max(a + s01, b + s11)
        a, b = a + x, b + y
    label = int(b > a)
    out = [label]
    for choice in reversed(back):
        label = int(choice[label])
        out.append(label)
    return out[::-1]


def main_text(chain: Chain, page: str) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, label in zip(found, decode(chain, _page_features(found))) if label)


def examples_from(pages: list[str], seed: int = 0) -> list[tuple[list[list[str]], list[int]]]:
    """Labelled pages: layouts of known structure around paragraphs of the given pages."""
    rng = random.Random(seed)
    out = []
    for page in pages + [""] * 20:
        texts = [b.text for b in blocks(page) if len(b.text) > 60 and b.linked < len(b.text) / 2]
        texts = [t for t in dict.fromkeys(texts)] or rng.sample(_BUILT_IN, len(_BUILT_IN))
        for _ in range(LAYOUTS):
            at = rng.randrange(len(texts))
            some = (texts[at:] + texts[:at])[:rng.randint(1, TRAIN_PARAGRAPHS)]
            some = [t if len(t) < 600 or rng.random() < 0.5 else t[:rng.randint(40, 600)] for t in some]
            found, labels = labelled_blocks(labelled_layout(some, rng))
            out.append((_page_features(found), labels))
    return out


def fit(pages: DataFrame, html_col: str = "html", train_pages: int = TRAIN_PAGES) -> Chain:
    """Chain fitted on labelled layouts that borrow paragraphs from a bounded sample of pages."""
    # a threshold on the hash first, so that about the sample and not its size from every task is ranked
    share = min(1.0, 3.0 * train_pages / max(pages.count(), 1))
    rows = pages.select(F.col(html_col).alias("html"), F.pmod(F.xxhash64(html_col), F.lit(1 << 30)).alias("key")).filter(
        F.col("html").isNotNull() & (F.length("html") <= TRAIN_CHARS) & (F.col("key") < int(share * (1 << 30))))
    sample = rows.orderBy("key", "html").limit(train_pages).collect()
    return fit_chain(examples_from([r["html"] for r in sample]))


def extract_main_text(df: DataFrame, chain: Chain, html_col: str = "html") -> DataFrame:
    """Adds ``text`` (main blocks in page order, one line each) and ``n_chars`` (its code points).

    A null or empty page, one without text and one without a main block give the empty text. Markup that
    is cut off, wrongly nested or not closed is read as far as it goes. Pages of any length are read whole, one by
    one; repeated rows give repeated results and an empty table none. Columns of ``df`` named like the
    results are replaced.
    """
    shared = df.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("string")
    def judge(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(shared.value, page) if page else "" for page in batch], dtype=object)

    out = free_name(df, "_main")
    judged = df.withColumn(out, judge(F.col(html_col)))
    return judged.withColumns({"text": F.col(out), "n_chars": F.length(out).cast("long")}).drop(out)
