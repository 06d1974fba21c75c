"""Hierarchical Pitman-Yor language model of words, seated by Gibbs sampling, over all training text.

The word after a context u is drawn from the context's restaurant, whose parent, shared by all contexts,
is a restaurant of words over a uniform base. Every previous word has a restaurant of its own. Seating is held
as tables per (word, context): customers c and tables t. A sweep draws t anew for every pair given all other
seats, using the table totals T of contexts from the sweep before; tables become customers of the parent, whose
tables are drawn likewise.

Words are dealt into buckets by their hash, so a bucket has all contexts of its words and the parent's seats for
them. Contexts are dealt into blocks by theirs: each sweep, buckets send their tables beyond one per pair to
the blocks, which add them up and answer each bucket with T of the contexts it asked for. Pairs seen once
always have one table, so only contexts of the others are sent around. Pairs of held-out texts are in the
buckets with no customers, which brings them the totals of their contexts. Predictions are averaged over the last
samples.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from grainsift.llm.tokens import mix, word_slices
from grainsift.operators.materialize import materialize

#: contexts are known by so many bits of their hash
CONTEXT_BITS = 48
#: bytes of text per bucket, on average; tokens of one part of a task's rows
BUCKET_BYTES = 25_000_000
PART_TOKENS = 1_500_000
#: sweeps before samples are kept, and samples kept
BURN_IN, SAMPLES = 2, 3
#: up to so many customers, tables are drawn from their exact conditional law
EXACT_CUSTOMERS = 40
#: tokens of a bucket that are scored by one task (a bucket with more is split by parts)
SCORE_TOKENS = 12_000_000
#: buckets whose contexts share a block, on average
BLOCK_BUCKETS = 8
SEED = 11

_END, _BEGIN = np.uint64(0x1234567890ABCDEF), np.uint64(0xFEDCBA0987654321)
_HEAD = pa.schema([("bucket", pa.int64()), ("part", pa.string()), ("n", pa.int64()), ("keys", pa.binary()),
                   ("contexts", pa.binary()), ("counts", pa.binary()), ("docs", pa.binary()), ("head", pa.binary())])
_PARTS = "bucket long, part string, n long, keys binary, contexts binary, counts binary, docs binary, head binary"


def pack(values: np.ndarray) -> bytes:
    """Whole numbers as bytes: byte planes of the smallest fitting type, compressed."""
    values = np.ascontiguousarray(values)
    if values.dtype != np.float64:
        top = int(values.max()) if len(values) else 0
        values = values.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))
    planes = values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.copy()
    body = pa.compress(planes.tobytes(), codec="zstd", asbytes=True)
    return values.dtype.str.encode().ljust(4) + len(values).to_bytes(8, "little") + body


def unpack(data: bytes) -> np.ndarray:
    kind, n = np.dtype(data[:4].strip().decode()), int.from_bytes(data[4:12], "little")
    raw = pa.decompress(data[12:], decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True)
    return np.frombuffer(raw, np.uint8).reshape(kind.itemsize, n).T.copy().view(kind).reshape(n)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).astype(np.uint64), dtype=np.uint64)


def pack_repeated(keys: np.ndarray) -> bytes:
    """Keys of which many stand for themselves again: the distinct ones, often used ones first (in classes that double,
    sorted within), and everyone's place among them."""
    own, at, uses = np.unique(keys, return_inverse=True, return_counts=True)
    order = np.lexsort((own, -np.floor(np.log2(uses))))
    place = np.empty(len(own), np.int64)
    place[order] = np.arange(len(own))
    known = pack_sorted(own[order])         # steps down between classes wrap around
    return len(known).to_bytes(8, "little") + known + pack(place[at])


def unpack_repeated(data: bytes) -> np.ndarray:
    end = 8 + int.from_bytes(data[:8], "little")
    return unpack_sorted(data[8:end])[unpack(data[end:])]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def block_of(contexts: np.ndarray, blocks: int) -> np.ndarray:
    return (((contexts >> np.uint64(CONTEXT_BITS - 32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)


def pair_groups(words: np.ndarray, contexts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of pairs by word and context, and where in it each distinct pair starts."""
    order = np.lexsort((contexts, words))
    words, contexts = words[order], contexts[order]
    new = np.ones(len(order), bool)
    new[1:] = (words[1:] != words[:-1]) | (contexts[1:] != contexts[:-1])
    return order, np.flatnonzero(new)


def _tokens(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word, context and row of every token, and tokens per row."""
    sizes = np.diff(part.first) + 1
    ends = np.cumsum(sizes) - 1
    words = np.empty(int(sizes.sum()), np.uint64)
    is_word = np.ones(len(words), bool)
    is_word[ends] = False
    words[is_word] = part.hash
    words[ends] = _END
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[ends - sizes + 1] = _BEGIN
    context = mix(before) >> np.uint64(64 - CONTEXT_BITS)
    return words, context, np.repeat(np.arange(part.rows), sizes), sizes


def _collect(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """(number, words, contexts, rows, tokens per row, slice of the batches' other columns) of parts of bounded size."""
    number, waiting, tokens = 0, [], 0
    def joined():
        rows = np.cumsum([0] + [len(w[3]) for w in waiting])
        return (number, np.concatenate([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]),
                np.concatenate([w[2] + at for w, at in zip(waiting, rows)]), np.concatenate([w[3] for w in waiting]),
                [w[4] for w in waiting])
    for batch in batches:
        for part in word_slices(batch.column(column)):
            waiting.append((*_tokens(part), batch.slice(part.row, part.rows)))
            tokens += len(waiting[-1][0])
            if tokens >= PART_TOKENS:
                yield joined()
                number, waiting, tokens = number + 1, [], 0
    if waiting:
        yield joined()


def _counts(buckets: int):
    """Pairs of a part with their counts in training texts (none for pairs of held-out texts only), by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, words, contexts, rows, _, slices in _collect(batches, 1):
            held = np.concatenate([s.column(0).to_numpy(zero_copy_only=False).astype(bool) for s in slices])
            order, starts = pair_groups(words, contexts)
            counts = np.add.reduceat((~held[rows])[order].astype(np.int64), starts)
            first = order[starts]
            yield from _by_bucket(buckets, f"{task}-{number}", words[first], contexts[first], counts, None, None, None)
    return run


def _by_bucket(buckets: int, part: str, words: np.ndarray, contexts: np.ndarray, counts: np.ndarray,
               places: np.ndarray | None, docs: np.ndarray | None, head: bytes | None) -> Iterator[pa.RecordBatch]:
    bounds = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
    rows = []
    carrier = hash_text(part) % buckets
    for b in range(buckets):
        lo, hi = bounds[b], bounds[b + 1]
        if hi > lo or head is not None and b == carrier:
            rows.append((b, part, int(counts[lo:hi].sum()), pack_sorted(words[lo:hi]), pack_repeated(contexts[lo:hi]),
                         pack(counts[lo:hi]), None if docs is None else pack(docs[places[lo]:places[hi]]),
                         head if b == carrier else None))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t.type) for c, t in zip(zip(*rows), _HEAD)], schema=_HEAD)


def hash_text(text: str) -> int:
    return int(mix(np.frombuffer(text.encode().ljust(8 * (len(text) // 8 + 1)), np.uint64)).sum() >> np.uint64(8))


def _postings(buckets: int):
    """All pairs of a part with the rows they stand in, by bucket; one bucket also takes the rows' own facts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, words, contexts, rows, sizes, slices in _collect(batches, 2):
            table = pa.Table.from_batches([s.select([0, 1]) for s in slices]).append_column(
                "n_tokens", pa.array(sizes, pa.int64())).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_table(table)
            order, starts = pair_groups(words, contexts)
            first, places = order[starts], np.append(starts, len(order))
            yield from _by_bucket(buckets, f"{task}-{number}", words[first], contexts[first], np.diff(places), places,
                                  rows[order], sink.getvalue().to_pybytes())
    return run


def _merge(group: pd.DataFrame) -> pd.DataFrame:
    words = np.concatenate([unpack_sorted(k) for k in group["keys"]])
    contexts = np.concatenate([unpack_repeated(c) for c in group["contexts"]])
    counts = np.concatenate([unpack(c).astype(np.int64) for c in group["counts"]])
    order, starts = pair_groups(words, contexts)
    counts = np.add.reduceat(counts[order], starts)
    words, contexts = words[order[starts]], contexts[order[starts]]
    return pd.DataFrame({"bucket": group["bucket"].iloc[:1], "salt": group["salt"].iloc[:1], "keys": [pack_sorted(words)],
                         "contexts": [pack_repeated(contexts)], "counts": [pack(counts)], "tokens": int(counts.sum()),
                         "words": len(np.unique(words[counts > 0])), "ones": int((counts == 1).sum()),
                         "twos": int((counts == 2).sum()), "pairs": len(counts)})


_MERGED = ("bucket long, salt long, keys binary, contexts binary, counts binary, tokens long, words long, ones long, "
           "twos long, pairs long")


@lru_cache(maxsize=8)
def _log_stirling(discount: float) -> np.ndarray:
    """log S(c, t) of generalised Stirling numbers for c and t up to EXACT_CUSTOMERS."""
    table = np.full((EXACT_CUSTOMERS + 1, EXACT_CUSTOMERS + 1), -np.inf)
    table[0, 0] = 0.0
    for c in range(EXACT_CUSTOMERS):
        for t in range(1, c + 2):
            stay = table[c, t] + math.log(c - t * discount) if t <= c and c > t * discount else -np.inf
            table[c + 1, t] = np.logaddexp(table[c, t - 1], stay)
    return table


def draw_tables(c: np.ndarray, others: np.ndarray, base: np.ndarray, discount: float, strength: float,
                rng: np.random.Generator) -> np.ndarray:
    """Tables that c customers of a dish take, given ``others`` tables of their restaurant and the dish's base
    probability.

    All seatings of the customers taken together, t has weight S(c, t) * prod (strength + d * (others + j)) * base ** t
    with generalised Stirling numbers S. Few customers: drawn from that law. Many: S(c, t) is a coefficient of
    (1 - (1 - x) ** d) ** t; at its saddle point y = 1 - x, in balance with the other factors, the law is locally a
    negative binomial with success base * (1 - y ** d), which is drawn from.
    """
    out = np.ones(len(c), np.int64)
    for n in range(2, EXACT_CUSTOMERS + 1):
        rows = np.flatnonzero(c == n)
        for at in range(0, len(rows), 100_000):
            some = rows[at:at + 100_000]
            level = np.log(np.maximum(strength + discount * (others[some][:, None] + np.arange(n)), 1e-12))
            level = np.cumsum(level, axis=1) + np.log(base[some])[:, None] * np.arange(1, n + 1)
            level += _log_stirling(discount)[n, 1:n + 1]
            level -= np.log(rng.exponential(size=level.shape))
            out[some] = level.argmax(axis=1) + 1
    many = np.flatnonzero(c > EXACT_CUSTOMERS)
    if len(many):
        tau, share, size = strength / discount + others[many], base[many], c[many]
        low, high = np.full(len(many), -700.0), np.zeros(len(many))     # of log y; customers explained fall with y
        for _ in range(60):
            at = (low + high) / 2
            y = np.exp(at)
            explained = tau * share / (1 - share * (1 - y ** discount)) * (1 - y) * discount * y ** (discount - 1)
            low, high = np.where(explained > size, at, low), np.where(explained > size, high, at)
        reach = 1 - np.exp(discount * (low + high) / 2)
        out[many] = np.minimum(1 + rng.negative_binomial(tau + 1, np.clip(1 - share * reach, 1e-9, 1)), size)
    return out


@dataclass
class Totals:
    """What every bucket is told before a sweep: sums over all words, and all tables and the parent's tables."""

    tokens: int
    words: int
    discounts: tuple[float, float]
    tables: int
    parent_tables: int
    strengths: tuple[float, float] = (1.0, 10.0)

    def parent(self, n: np.ndarray, tt: np.ndarray) -> tuple[np.ndarray, float]:
        """Probability of words in the parent by their customers and tables there, and that of a word without."""
        d, strength = self.discounts[1], self.strengths[1]
        rest = (strength + d * self.parent_tables) / (strength + self.tables) / (self.words + 1)
        return (n - d * tt) / (strength + self.tables) + rest, rest


#: kinds of rows that go between buckets and blocks
_MOVING, _STATE, _EXTRA, _ASK, _BASE, _ANSWER, _PAIRS = range(7)
_COLUMNS = ["kind", "bucket", "block", "sweep", "x", "y", "z", "w", "tables", "parent", "ones", "twos"]
_ROWS = ("kind int, bucket long, block long, sweep int, x binary, y binary, z binary, w binary, tables long, parent long, "
         "ones long, twos long")


def _row(kind: int, bucket: int | None, block: int | None, sweep: int, *packed: bytes, sums: tuple = (0, 0, 0, 0)) -> tuple:
    return (kind, bucket, block, sweep, *packed, *[None] * (4 - len(packed)), *sums)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_COLUMNS)


def _by_block(kind: int, bucket: int, sweep: int, blocks: int, contexts: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """A row per block of a bucket's sorted contexts."""
    bounds = np.searchsorted(block_of(contexts, blocks), np.arange(blocks + 1))
    return [_row(kind, bucket, b, sweep, pack_sorted(contexts[lo:hi]), *[pack(v[lo:hi]) for v in values])
            for b, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])) if hi > lo]


def _pairs_of(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return unpack_sorted(row.keys), unpack_repeated(row.contexts), unpack(row.counts).astype(np.int64)


def _start(blocks: int):
    """Pairs seen more than once of each bucket, with customers of the parent by word at one table per pair, and
    the question for their contexts."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                words, contexts, counts = _pairs_of(row)
                own, word = np.unique(words, return_inverse=True)
                n = np.bincount(word[counts > 0], minlength=len(own))
                at = np.flatnonzero(counts > 1)
                asked = np.unique(contexts[at])
                yield _frame([_row(_MOVING, row.bucket, None, 0, pack(word[at]), pack_repeated(contexts[at]), pack(counts[at]), pack(n),
                                   sums=(int(n.sum()), int((n > 0).sum()), int((n == 1).sum()), int((n == 2).sum())))]
                             + _by_block(_EXTRA, row.bucket, 0, blocks, asked, np.zeros(len(asked), np.int64)))
    return run


def _asked(blocks: int):
    """All contexts of each bucket with their customers and pairs there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                _, contexts, counts = _pairs_of(row)
                own, at = np.unique(contexts, return_inverse=True)
                pairs = np.bincount(at[counts > 0], minlength=len(own))
                customers = np.bincount(at, weights=counts, minlength=len(own)).astype(np.int64)
                yield _frame(_by_block(_ASK, row.bucket, 0, blocks, own, pairs, customers))
    return run


def _base(group: pd.DataFrame) -> pd.DataFrame:
    """Pairs and customers of all contexts of a block."""
    contexts, at = np.unique(np.concatenate([unpack_sorted(x) for x in group["x"]]), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([unpack(v) for v in group[c]]), minlength=len(contexts)).astype(np.int64)
            for c in ("y", "z")]
    return _frame([_row(_BASE, None, int(group["block"].iloc[0]), 0, pack_sorted(contexts), *map(pack, sums))])


def _answers(final: bool):
    """T of the contexts that buckets of a block ask for; at the end their customers and T of every sample."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        base = next(group[group["kind"] == _BASE].itertuples())
        contexts, pairs, customers = unpack_sorted(base.x), unpack(base.y).astype(np.int64), unpack(base.z).astype(np.int64)
        extra = group[group["kind"] == _EXTRA]
        tables = {}
        for row in extra.itertuples():
            at = np.searchsorted(contexts, unpack_sorted(row.x))
            tables.setdefault(row.sweep, pairs.copy())[at] += unpack(row.y).astype(np.int64)
        if not final:
            return _frame([_row(_ANSWER, row.bucket, row.block, row.sweep,
                                pack(tables[row.sweep][np.searchsorted(contexts, unpack_sorted(row.x))]))
                           for row in extra.itertuples()])
        samples = [tables.get(sweep, pairs) for sweep in range(BURN_IN + 1, BURN_IN + SAMPLES + 1)]
        out = []
        for row in group[group["kind"] == _ASK].itertuples():
            at = np.searchsorted(contexts, unpack_sorted(row.x))
            out.append(_row(_ANSWER, row.bucket, row.block, 0, pack(customers[at]), pack(np.concatenate([t[at] for t in samples]))))
        return _frame(out)
    return run


def _in_order(group: pd.DataFrame, column: str) -> list[np.ndarray]:
    rows = group[group["kind"] == _ANSWER].sort_values("block")
    return [unpack(v).astype(np.int64) for v in rows[column]]


def _sweep(blocks: int, totals: Totals, sweep: int):
    """Seats of a bucket after a sweep more, and its tables beyond one per pair for the blocks."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        moving = next(group[group["kind"] == _MOVING].itertuples())
        word, counts, n = (unpack(v).astype(np.int64) for v in (moving.x, moving.z, moving.w))
        contexts, context = np.unique(unpack_repeated(moving.y), return_inverse=True)
        states = group[group["kind"] == _STATE]
        if len(states):
            t, tt = (unpack(states[c].iloc[0]).astype(np.int64) for c in ("x", "y"))
        else:
            t, tt = np.ones(len(word), np.int64), (n > 0).astype(np.int64)
        tables = np.concatenate([np.zeros(0, np.int64), *_in_order(group, "x")])
        rng = np.random.Generator(np.random.PCG64([SEED, int(moving.bucket), sweep]))
        seated = n + np.bincount(word, weights=t - 1, minlength=len(n)).astype(np.int64)
        chance, _ = totals.parent(seated, tt)
        # the pair's own tables leave the parent before they are drawn anew
        base = np.maximum(chance[word] - t / (totals.tables + totals.strengths[1]), 1e-12)
        t = draw_tables(counts, tables[context] - t, base, totals.discounts[0], totals.strengths[0], rng)
        more = np.bincount(word, weights=t - 1, minlength=len(n)).astype(np.int64)
        seated = n + more
        known = np.flatnonzero(seated)
        tt[known] = draw_tables(seated[known], np.maximum(totals.parent_tables - tt[known], 0),
                                np.full(len(known), 1 / (totals.words + 1)), totals.discounts[1], totals.strengths[1], rng)
        extra = np.bincount(context, weights=t - 1, minlength=len(contexts)).astype(np.int64)
        return _frame([_row(_STATE, int(moving.bucket), None, sweep, pack(t), pack(tt),
                            sums=(int(seated.sum()), int(tt.sum()), 0, 0))]
                      + _by_block(_EXTRA, int(moving.bucket), sweep, blocks, contexts, extra))
    return run


def _discount(ones: float, twos: float) -> float:
    return float(np.clip(ones / max(ones + 2 * twos, 1), 0.1, 0.95))


def _scores(samples: list[Totals]):
    """Per part and row of a bucket's parts: known tokens, base and model log10 probability of its tokens here."""
    def run(key, parts: pd.DataFrame, facts: pd.DataFrame) -> pd.DataFrame:
        if not len(parts):
            return pd.DataFrame({"part": [], "head": [], "docs": [], "known": [], "base": [], "score": []})
        pairs = facts[facts["kind"] == _PAIRS]
        if not len(pairs):                          # a part's head alone
            empty = pack(np.zeros(0, np.int64)), pack(np.zeros(0, np.int64)), pack(np.zeros(0)), pack(np.zeros(0))
            return pd.DataFrame([(r.part, r.head, *empty) for r in parts.itertuples()],
                                columns=["part", "head", "docs", "known", "base", "score"])
        words, word = np.unique(unpack_sorted(pairs["x"].iloc[0]), return_inverse=True)
        contexts, context = np.unique(unpack_repeated(pairs["y"].iloc[0]), return_inverse=True)
        counts = unpack(pairs["z"].iloc[0]).astype(np.int64)
        customers = np.concatenate(_in_order(facts, "x"))
        tables = np.concatenate([v.reshape(SAMPLES, -1) for v in _in_order(facts, "y")], axis=1)
        word_counts = np.bincount(word, weights=counts, minlength=len(words)).astype(np.int64)
        first = samples[0]
        d, strength = first.discounts[0], first.strengths[0]
        chance = np.zeros(len(counts))
        for i, (totals, row) in enumerate(zip(samples, facts[facts["kind"] == _STATE].sort_values("sweep").itertuples())):
            t = (counts > 0).astype(np.int64)
            t[counts > 1] = unpack(row.x)
            n = np.bincount(word, weights=t, minlength=len(words))
            up = totals.parent(n, unpack(row.y).astype(np.int64))[0][word]
            chance += (counts - d * t + (strength + d * tables[i][context]) * up) / (strength + customers[context])
        pair_score = np.log10(chance / SAMPLES)
        places = word * len(contexts) + context
        out = []
        for row in parts.itertuples():
            n, docs = unpack(row.counts).astype(np.int64), unpack(row.docs)
            at_word = np.searchsorted(words, unpack_sorted(row.keys))
            at_pair = np.searchsorted(places, at_word * len(contexts) + np.searchsorted(
                contexts, unpack_repeated(row.contexts)))
            seen = word_counts[at_word]
            base = np.log10((seen + 1) / (first.tokens + first.words + 1))
            at, local = np.unique(docs, return_inverse=True)
            def per_row(values):
                return np.bincount(local, weights=np.repeat(values, n), minlength=len(at))
            out.append((row.part, row.head, pack(at), pack(per_row((seen > 0) * 1.0).astype(np.int64)),
                        pack(per_row(base)), pack(per_row(pair_score[at_pair]))))
        return pd.DataFrame(out, columns=["part", "head", "docs", "known", "base", "score"])
    return run


def _rows(train_tokens: int):
    """Rows of a part from the sums of all its buckets."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        head = next(h for h in group["head"] if h is not None)
        out = pa.ipc.open_stream(head).read_pandas()
        known, base, score = np.zeros(len(out), np.int64), np.zeros(len(out)), np.zeros(len(out))
        for row in group.sort_values("bucket").itertuples():
            at = unpack(row.docs).astype(np.int64)
            known[at] += unpack(row.known).astype(np.int64)
            base[at] += unpack(row.base)
            score[at] += unpack(row.score)
        out.columns = ["doc_id", "held_out", "n_tokens"]
        return out.assign(n_known=known, train_tokens=train_tokens, base_score=base, score=score)
    return run


def fit_and_score(df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens are the words between ASCII white space, A-Z lower-cased, and one end per text; null and empty
    texts are an end alone. The model learns from all tokens of all rows that are not held out; with none,
    probabilities are uniform over one unknown word. ``score`` is the log10 probability that the model, averaged
    over samples, gives to the text's tokens, and ``base_score`` that of smoothed counts. Repeated rows count
    each time, in learning and in results; ids are only passed through; an empty table gives no rows. Other
    columns are not looked at.
    """
    spark, id_type = df.sparkSession, df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), held_out.alias("held"), F.col(text_col).alias("text"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    # parts of a bucket meet in two steps, so that no task gets all parts of a hot word
    salts = max(1, buckets // 32)
    counts = (rows.select(F.coalesce("held", F.lit(True)).alias("held"), "text").mapInArrow(_counts(buckets), _PARTS)
              .withColumn("salt", F.pmod(F.xxhash64("part"), F.lit(salts))).select("bucket", "salt", "keys", "contexts", "counts")
              .groupBy("bucket", "salt").applyInPandas(_merge, _MERGED))
    if salts > 1:
        counts = counts.select("bucket", F.lit(0).cast("long").alias("salt"), "keys", "contexts", "counts").groupBy(
            "bucket").applyInPandas(_merge, _MERGED)
    counts = materialize(counts)
    known = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "words", "ones", "twos")]).first()
    blocks = max(1, buckets // BLOCK_BUCKETS)
    packed = counts.select("bucket", "keys", "contexts", "counts")
    asked = packed.mapInPandas(_asked(blocks), _ROWS)
    base = materialize(asked.groupBy("block").applyInPandas(_base, _ROWS))
    last = materialize(packed.mapInPandas(_start(blocks), _ROWS))
    moving = last.filter(F.col("kind") == _MOVING)

    def sums(table: DataFrame):
        return table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tables", "parent", "ones", "twos")]).first()
    now = sums(last)
    totals = Totals(known["tokens"], known["words"], (_discount(known["ones"], known["twos"]), _discount(now["ones"], now["twos"])),
                    now["tables"], now["parent"])
    samples, kept = [], []
    for sweep in range(1, BURN_IN + SAMPLES + 1):
        answers = base.union(last.filter(F.col("kind") == _EXTRA)).groupBy("block").applyInPandas(_answers(False), _ROWS)
        last = materialize(answers.union(last.filter(F.col("kind") == _STATE)).union(moving)
                           .groupBy("bucket").applyInPandas(_sweep(blocks, totals, sweep), _ROWS))
        now = sums(last)
        totals = replace(totals, tables=now["tables"], parent_tables=now["parent"])
        if sweep > BURN_IN:
            samples.append(totals)
            kept.append(last)
    kept = reduce(DataFrame.union, kept)
    answers = (base.union(asked).union(kept.filter(F.col("kind") == _EXTRA))
               .groupBy("block").applyInPandas(_answers(True), _ROWS))
    none = [F.lit(None).cast("binary").alias("w"), *[F.lit(0).cast("long").alias(c) for c in ("tables", "parent", "ones", "twos")]]
    pairs = packed.select(F.lit(_PAIRS).alias("kind"), "bucket", F.lit(None).cast("long").alias("block"), F.lit(0).alias("sweep"),
                          F.col("keys").alias("x"), F.col("contexts").alias("y"), F.col("counts").alias("z"), *none)
    facts = pairs.union(kept.filter(F.col("kind") == _STATE)).union(answers)

    split = counts.select(F.col("bucket").alias("_b"), F.ceil(F.greatest("tokens", "pairs") / SCORE_TOKENS).alias("_splits"))
    postings = (rows.mapInArrow(_postings(buckets), _PARTS).join(F.broadcast(split) if buckets <= 100_000 else split,
                                                                 F.col("bucket") == F.col("_b"), "left")
                .withColumn("salt", F.pmod(F.xxhash64("part"), F.coalesce("_splits", F.lit(1)))).drop("_b", "_splits"))
    copies = (facts.join(F.broadcast(split) if buckets <= 100_000 else split, facts["bucket"] == split["_b"])
              .select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("_splits") - 1)).alias("salt"), *_COLUMNS))
    scored = postings.groupBy("bucket", "salt").cogroup(copies.groupBy("bucket", "salt")).applyInPandas(
        _scores(samples), "part string, head binary, docs binary, known binary, base binary, score binary")
    scored = scored.withColumn("bucket", F.xxhash64("docs", "score"))       # an order to add up in
    return scored.groupBy("part").applyInPandas(
        _rows(int(known["tokens"])), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, "
                                     "train_tokens long, base_score double, score double")
