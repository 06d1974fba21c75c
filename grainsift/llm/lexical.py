"""Ranked lexical search of many items at once by shared partial sums.

Items share terms, and sets of terms that several items hold need to be added up once only. For a lot of items a task mines
these sets: terms with the same holders form one node, then the pair of nodes that most items hold together becomes
a node, again and again, until no pair has two holders. What is left is a graph: terms at the bottom, partial sums above them, and per
item a short list of nodes. Documents are read once per lot and reduced to the counts of the items' terms. A task then
fills the bottom accumulators of some documents at a time, adds up the graph level by level, each partial sum once for
all items above it, and keeps a heap of the best documents per item.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from grainsift.llm.tokens import LETTERS, HashIndex, word_slices
from grainsift.operators.materialize import materialize

BEST = 10
#: terms of the items of one lot, on average: the bound of what is broadcast, and of what one task mines
LOT_TERMS = 100_000
#: shared nodes of one item among which pairs are counted; longer lists are cut into pieces of that many
PAIRED = 64
#: accumulators (64 bits each) held at once
ACCUMULATORS = 4_000_000
#: documents whose accumulators are held at once, at most
DOCUMENTS = 512
#: tasks among which the finds of one item are merged first
MERGERS = 16

K_BASE, K_LENGTH = 100, 75


@dataclass
class SharingGraph:
    """Nodes 0 to ``terms`` - 1 are terms; every later node is the sum of two earlier ones. ``steps`` holds the (node, left,
    right) arrays level by level, ``roots`` the nodes of item i at ``starts[i]:starts[i + 1]``."""

    terms: int
    nodes: int
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]]
    roots: np.ndarray
    starts: np.ndarray

    @property
    def additions(self) -> int:
        return self.nodes - self.terms + int(np.maximum(np.diff(self.starts) - 1, 0).sum())

    def item_sums(self, values: np.ndarray) -> np.ndarray:
        """Sums per item from values per term (rows) and document (columns)."""
        sums = np.zeros((self.nodes, values.shape[1]), np.int64)
        sums[:self.terms] = values
        for node, left, right in self.steps:
            sums[node] = sums[left] + sums[right]
        out = np.zeros((len(self.starts) - 1, values.shape[1]), np.int64)
        filled = np.flatnonzero(np.diff(self.starts))
        if len(filled):
            out[filled] = np.add.reduceat(sums[self.roots], self.starts[filled], axis=0)
        return out


def sharing_graph(items: list[list[int]], terms: int) -> SharingGraph:
    """The graph of items given as lists of term numbers, repeats included."""
    holders: dict[tuple[int, int], list[int]] = {}
    for i, item in enumerate(items):
        seen: Counter = Counter()
        for term in item:
            holders.setdefault((term, seen[term]), []).append(i)      # a term's second occurrence is a symbol of its own
            seen[term] += 1
    children: list[tuple[int, int]] = []

    def node(a: int, b: int) -> int:
        children.append((a, b))
        return terms + len(children) - 1

    def folded(nodes: list[int]) -> int:
        while len(nodes) > 1:
            nodes = [node(*nodes[i:i + 2]) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    classes: dict[tuple[int, ...], list[int]] = {}
    for (term, _), held in holders.items():
        classes.setdefault(tuple(held), []).append(term)
    roots: list[list[int]] = [[] for _ in items]
    # a class is a symbol: a term may come in several (its second occurrence), so symbols are not nodes
    symbol_node: list[int] = []
    pieces: list[set[int]] = []
    owner: list[int] = []
    where: dict[int, set[int]] = {}
    open_piece: dict[int, int] = {}
    for held, members in sorted(classes.items(), key=lambda c: (-len(c[0]), c[0])):
        if len(held) == 1:
            roots[held[0]] += members
            continue
        symbol = len(symbol_node)
        symbol_node.append(folded(members))
        where[symbol] = set()
        for i in held:
            piece = open_piece.get(i)
            if piece is None or len(pieces[piece]) >= PAIRED:
                piece = open_piece[i] = len(pieces)
                pieces.append(set())
                owner.append(i)
            pieces[piece].add(symbol)
            where[symbol].add(piece)
    together: Counter = Counter()
    for piece in pieces:
        ordered = sorted(piece)
        together.update((a, b) for x, a in enumerate(ordered) for b in ordered[x + 1:])
    heap = [(-n, pair) for pair, n in together.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        now = together.get((a, b), 0)
        if now < 2:
            continue
        if now != -n:
            heapq.heappush(heap, (-now, (a, b)))
            continue
        made = len(symbol_node)
        symbol_node.append(node(symbol_node[a], symbol_node[b]))
        where[made] = where[a] & where[b]
        gained: Counter = Counter()
        for p in where[made]:
            piece = pieces[p]
            piece -= {a, b}
            for x in piece:
                together[min(a, x), max(a, x)] -= 1
                together[min(b, x), max(b, x)] -= 1
                gained[x] += 1
            piece.add(made)
        del together[a, b]
        for x, count in gained.items():
            together[x, made] = count
            if count > 1:
                heapq.heappush(heap, (-count, (x, made)))
        where[a] -= where[made]
        where[b] -= where[made]
    for piece, i in zip(pieces, owner):
        roots[i] += [symbol_node[s] for s in sorted(piece)]

    level = np.zeros(terms + len(children), np.int32)
    for k, (a, b) in enumerate(children):
        level[terms + k] = 1 + max(level[a], level[b])
    pairs = np.array(children, np.int64).reshape(-1, 2)
    steps = []
    for depth in range(1, int(level.max(initial=0)) + 1):
        at = np.flatnonzero(level[terms:] == depth)
        steps.append((terms + at, pairs[at, 0], pairs[at, 1]))
    starts = np.concatenate([[0], np.cumsum([len(r) for r in roots])]).astype(np.int64)
    return SharingGraph(terms, terms + len(children), steps, np.array([n for r in roots for n in r], np.int64), starts)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in word_slices(batch.column("text"), LETTERS):
            ids = batch.column("item_id").slice(words.row, words.rows)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:])], pa.binary()),
                 pa.array(np.diff(words.first).astype(np.int64))], ["item_id", "terms", "n"])


def _mined(group: pd.DataFrame) -> pd.DataFrame:
    """The vocabulary and the graph of one lot, in pieces of bytes."""
    group = group.sort_values("item_id", na_position="last")
    lists = [np.frombuffer(t, np.uint64) for t in group["terms"]]
    vocabulary, at = np.unique(np.concatenate(lists), return_inverse=True)
    bounds = np.cumsum([0] + [len(x) for x in lists])
    graph = sharing_graph([at[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])], len(vocabulary))
    return pd.DataFrame({"lot": group["lot"].iloc[:1], "items": [group["item_id"].tolist()],
                         "vocabulary": [vocabulary.tobytes()], "roots": [graph.roots.tobytes()], "starts": [graph.starts.tobytes()],
                         "levels": [[len(s[0]) for s in graph.steps]],
                         "steps": [b"".join(np.stack(s).tobytes() for s in graph.steps)]})


def _graph_of(row) -> tuple[np.ndarray, SharingGraph]:
    vocabulary = np.frombuffer(row["vocabulary"], np.uint64)
    steps, at = [], 0
    flat = np.frombuffer(row["steps"], np.int64)
    for count in row["levels"]:
        steps.append(tuple(flat[at:at + 3 * count].reshape(3, count)))
        at += 3 * count
    return vocabulary, SharingGraph(len(vocabulary), len(vocabulary) + at // 3, steps, np.frombuffer(row["roots"], np.int64),
                                    np.frombuffer(row["starts"], np.int64))


def _counted(shared):
    """Length of every document with terms, and the items' terms in it with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, size = HashIndex(shared.value), max(1, len(shared.value))
        for batch in batches:
            for words in word_slices(batch.column("text"), LETTERS):
                term = index.find(words.hash)
                hit = np.flatnonzero(term >= 0)
                owner = np.searchsorted(words.first, hit, "right") - 1
                keys, counts = np.unique(owner * size + term[hit], return_counts=True)
                length = np.diff(words.first)
                kept = np.flatnonzero(length)
                offsets = np.searchsorted(keys, np.append(kept * size, words.rows * size)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(words.row, words.rows).take(pa.array(kept)),
                     pa.array(length[kept].astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array((keys % size).astype(np.int32))),
                     pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.astype(np.int32)))],
                    ["doc_id", "n", "terms", "counts"])
    return run


def _holders(size: int):
    """Documents (term -1), their length (term -2) and documents per term, of one task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, length, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            rows += len(batch)
            length += int(batch.column("n").to_numpy().sum())
            df += np.bincount(batch.column("terms").flatten().to_numpy(), minlength=size)
        held = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append([-1, -2], held).astype(np.int32)),
                                          pa.array(np.append([rows, length], df[held]).astype(np.int64))], ["term", "n"])
    return run


@dataclass
class Search:
    graph: SharingGraph
    weights: np.ndarray
    documents: int
    length: int
    best: int


def term_values(search: Search, n: np.ndarray, owner: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whole-number score of each (document, term)."""
    wide = object if int(n.max(initial=0)) * K_LENGTH * search.documents >= 1 << 63 else np.int64
    m = (K_BASE - K_LENGTH + K_LENGTH * n.astype(wide) * search.documents // search.length).astype(np.int64)
    count = count.astype(np.int64)
    return search.weights[term] * (1_000_000_000 * count // (1000 * count + 8 * m[owner]))


class _Best:
    """A heap of the best documents per item: higher scores first, then smaller ids, null ids last."""

    def __init__(self, items: int, size: int):
        self.size, self.heaps = size, [[] for _ in range(items)]
        self.floor = np.zeros(items, np.int64)

    def add(self, ids: list, sums: np.ndarray) -> None:
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
        sums = sums[:, order]
        first = np.argsort(-sums, axis=1, kind="stable")[:, :self.size]
        top = np.take_along_axis(sums, first, axis=1)
        for item, place in zip(*np.nonzero((top > 0) & (top >= self.floor[:, None]))):
            doc = ids[order[first[item, place]]]
            heap, entry = self.heaps[item], (int(top[item, place]), doc is not None, -(doc or 0))
            if len(heap) < self.size:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.size:
                self.floor[item] = heap[0][0]


def _searched(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search: Search = shared.value
        graph, best = search.graph, _Best(len(search.graph.starts) - 1, search.best)
        step = max(1, min(DOCUMENTS, ACCUMULATORS // max(1, graph.nodes + len(graph.roots))))
        for batch in batches:
            for at in range(0, len(batch), step):
                part = batch.slice(at, step)
                terms, counts = part.column("terms"), part.column("counts")
                owner = np.repeat(np.arange(len(part)), np.diff(terms.offsets.to_numpy()))
                term = terms.flatten().to_numpy()
                values = np.zeros((graph.terms, len(part)), np.int64)
                values[term, owner] = term_values(search, part.column("n").to_numpy(), owner, term, counts.flatten().to_numpy())
                best.add(part.column("doc_id").to_pylist(), graph.item_sums(values))
        rows = [(i, -ident if known else None, score) for i, heap in enumerate(best.heaps) for score, known, ident in heap]
        item, doc, score = map(list, zip(*rows)) if rows else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                         ["item", "doc_id", "score"])
    return run


def rank_documents(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """The ``best`` highest-scoring documents of every item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score``.

    Terms are runs of ASCII letters and digits and of anything beyond ASCII, with A-Z lower-cased; the score of a document
    sums, over an item's terms with repeats, the term's weight floor(1000 ln((2N+2)/(2df+1))) times the damped count
    10^9 tf div (1000 tf + 8 m), m = 25 + 75 n N div L, in 64-bit whole numbers. Terms are compared by a 64-bit hash.

    Documents (``doc_id`` integer, ``text``) without a term, null or empty, count nowhere; equal scores go to the smaller id, null ids last;
    repeated rows are documents of their own. Of items with one ``item_id`` (a null one too) the smallest text asks; items
    without terms, or whose terms no document holds, have no rows. Empty tables give no rows; other columns are not looked at.
    """
    spark = docs.sparkSession
    id_type = items.schema["item_id"].dataType.simpleString()
    schema = f"item_id {id_type}, rank int, doc_id long, score long"
    asked = materialize(items.groupBy("item_id").agg(F.min("text").alias("text")).mapInArrow(
        _item_terms, f"item_id {id_type}, terms binary, n long").filter("n > 0"))
    total = asked.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], schema)
    lots = -(-total // LOT_TERMS)
    mined = materialize(asked.withColumn("lot", F.pmod(F.xxhash64("item_id"), F.lit(lots)).cast("int"))
                        .groupBy("lot").applyInPandas(_mined, f"lot int, items array<{id_type}>, vocabulary binary, "
                                                      "roots binary, starts binary, levels array<int>, steps binary"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(F.length("text") > 0)
    found = None
    for lot in range(lots):                       # one lot for each 100,000 terms of the items
        rows = mined.filter(F.col("lot") == lot).collect()
        if not rows:
            continue
        vocabulary, graph = _graph_of(rows[0])
        counted = materialize(texts.mapInArrow(_counted(spark.sparkContext.broadcast(vocabulary)),
                                               "doc_id long, n long, terms array<int>, counts array<int>"))
        counts = dict(counted.select("n", "terms").mapInArrow(_holders(len(vocabulary)), "term int, n long")
                      .groupBy("term").agg(F.sum("n")).collect())
        documents, length = counts.get(-1, 0), counts.get(-2, 0)
        if not documents:
            break
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1)))
                            for t in range(len(vocabulary))], np.int64)
        shared = spark.sparkContext.broadcast(Search(graph, weights, documents, length, best))
        hits = counted.filter(F.size("terms") > 0).mapInArrow(_searched(shared), "item int, doc_id long, score long")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        merged = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(MERGERS)))
        for place in (["item", "part"], ["item"]):
            merged = merged.withColumn("rank", F.row_number().over(Window.partitionBy(*place).orderBy(*order))).filter(
                F.col("rank") <= best)
        names = mined.filter(F.col("lot") == lot).select(F.posexplode("items").alias("item", "item_id"))
        ranked = merged.join(names, "item").select("item_id", "rank", "doc_id", "score")
        found = ranked if found is None else found.union(ranked)
    return spark.createDataFrame([], schema) if found is None else found
