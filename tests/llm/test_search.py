"""Nearest neighbours, whitening and ranked search against brute force."""

import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainsift.llm import lexical, neighbours, whitening

NAN, INF = float("nan"), float("inf")
CLASHES = ["id", "node", "rank", "score", "size", "at", "q", "bound", "ids", "n", "item", "packed", "component", "terms", "lot"]


def _clashing(df):
    return df.withColumns({c: F.lit("mine") for c in CLASHES})


# nearest neighbours

def _brute_neighbours(rows, k):
    usable = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            usable[i] = v
    out = []
    for i, v in usable.items():
        if i % 100 == 0:
            near = []
            for j, w in usable.items():
                if j != i and len(v) == len(w):
                    total = 0.0
                    for a, b in zip(v, w):
                        total += (a - b) * (a - b)
                    near.append((math.sqrt(total), j))
            out += [(i, r, j, s) for r, (s, j) in enumerate(sorted(near)[:k], 1)]
    return sorted(out)


def _searched(spark, rows, k=10, kind="float"):
    df = _clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    return sorted(tuple(r) for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, k).collect())


@pytest.mark.parametrize("least,block", [(1024, 16 << 20), (16, 16 << 20), (16, 8 * 12 * 9)])
def test_neighbours_are_those_of_all_pairs(spark, monkeypatch, least, block):
    monkeypatch.setattr(neighbours, "LEAST_ROWS", least)     # many blocks on both sides, as in large tables
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", block)
    rng = np.random.default_rng(least)
    centres = rng.normal(size=(5, 12))
    x = (centres[rng.integers(0, 5, 900)] + 0.05 * rng.normal(size=(900, 12))).astype(np.float32)
    x[200:260] = x[200]                                # a group of copies with two queries in it
    x[300:400] = x[300] + 1e-4 * rng.normal(size=(100, 12)).astype(np.float32)   # closer than the codes can tell
    rows = [(i * 20, [float(c) for c in v]) for i, v in enumerate(x)]
    assert _searched(spark, rows) == _brute_neighbours(rows, 10)


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (100, [1.0, 0.0]), (100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, -1.0]), (3, [2.0, 1.0]),
            (200, None), (300, []), (400, [0.0, 0.0]), (500, [NAN, 1.0]), (600, [INF, 1.0]), (700, [None, 1.0]),
            (None, [1.0, 0.0]), (800, [1.0, 2.0, 3.0]), (900, [1e200, 1e200]), (1000, [1e-320, -1e-320]), (4, [-0.0, 1.0])]
    assert _searched(spark, rows, kind="double") == _brute_neighbours(rows, 10)
    assert _searched(spark, rows, k=2, kind="double") == _brute_neighbours(rows, 2)
    assert _searched(spark, []) == []
    assert _searched(spark, [(1, [1.0]), (2, [2.0])]) == []


def test_one_id_with_two_vectors_asks_once(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [3.0, 0.0])]
    got = _searched(spark, rows)
    assert [r[1:3] for r in got] == [(1, 1), (2, 2)]


def test_bounds_hold_the_distance():
    rng = np.random.default_rng(1)
    for scale, dims in ((1, 8), (1e-3, 64), (1e5, 1500)):
        q, c = rng.normal(size=(30, dims)) * scale, rng.normal(size=(40, dims)) * rng.choice([1, 100], (40, 1))
        lower, upper = neighbours.tile_bounds(neighbours.quantised(q), neighbours.quantised(c))
        true = np.sqrt(((q[:, None] - c[None]) ** 2).sum(axis=2))
        assert (lower <= true).all() and (true <= upper).all()
        assert (upper - lower <= 0.1 * true + 1e-9).mean() > 0.9


# whitening

def _brute_whitening(rows):
    kept = [(i, [math.floor(64 * np.float64(c)) + 1_000_000 for c in v]) for i, v in rows
            if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted(set(tuple(x) for _, x in kept))
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return kept, n, sums, values[::-1], vectors[:, ::-1]


def _whitened(spark, rows, kind="float"):
    df = _clashing(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>"))
    return whitening.whiten(df).collect()


@pytest.mark.parametrize("dims,spread", [(5, 1.0), (24, 1.0), (24, 300.0)])
def test_whitening_agrees_with_eigenvectors(spark, dims, spread):
    rng = np.random.default_rng(dims)
    x = (rng.normal(size=(400, dims)) * np.linspace(1, spread, dims) @ rng.normal(size=(dims, dims))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(None, rows[9][1]), (5, rows[5][1])]
    rows += [(2000, None), (2001, []), (2002, [NAN] * dims), (2003, [None] + [1.0] * (dims - 1)), (2004, [INF] * dims)]
    kept, n, sums, values, vectors = _brute_whitening(rows)
    got = _whitened(spark, rows)
    assert len(got) == len(kept) * min(16, dims)
    expected = {}
    for i, v in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        expected.setdefault((i, deviation), []).append(np.array([float(Fraction(n * c - s, n)) for c, s in zip(v, sums)]))
    signs = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        k = r["component"] - 1
        assert r["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        want = expected[r["vec_id"], r["deviation"]][0] @ vectors[:, k] / math.sqrt(values[k])
        sign = signs.setdefault(k, 1 if want * r["whitened"] > 0 else -1) if abs(want) > 1e-3 else signs.get(k)
        if sign:
            assert sign * r["whitened"] == pytest.approx(want, abs=1e-7)


def test_whitening_of_dependent_and_constant_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(-500, 500, (200, 3)) / 64
    x = np.column_stack([x, x[:, 0] + x[:, 1], np.full(200, 7.0)])
    got = _whitened(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)], "double")
    assert sorted({r["component"] for r in got}) == [1, 2, 3] and len(got) == 600
    assert max(r["identity_error"] for r in got) < 1e-9
    assert sum({r["component"]: r["explained"] for r in got}.values()) == pytest.approx(1)


def test_whitening_of_ill_conditioned_columns(spark):
    """Columns that agree in all but one unit of 10^10: the covariance itself would lose the small component."""
    rng = np.random.default_rng(5)
    a = rng.integers(-10**10, 10**10, 300)
    x = np.column_stack([a, a + rng.integers(0, 2, 300)]) / 64
    got = _whitened(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double")
    assert {r["component"] for r in got} == {1, 2} and max(r["identity_error"] for r in got) < 1e-4
    small = np.array([r["whitened"] for r in sorted(got, key=lambda r: r["vec_id"]) if r["component"] == 2])
    assert abs(np.corrcoef(small, x[:, 1] - x[:, 0])[0, 1]) > 0.99      # the rest is chance between the two columns


def test_whitening_of_few_rows_and_lengths(spark):
    assert _whitened(spark, []) == []
    assert _whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    got = _whitened(spark, [(1, [1.0, 2.0]), (2, [1.0, 4.0]), (3, [1.0, 2.0, 3.0]), (4, [1e300, 0.0])], "double")
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"]) for r in sorted(got)] == [(1, 1, 2, 128**2), (2, 1, 2, 128**2)]
    far = _whitened(spark, [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 1.0])], "double")
    assert {r["deviation"] for r in far if r["vec_id"] == 1} == {None} and len(far) == 6


# ranked search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return _TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute_ranks(docs, items, k=10):
    texts = [(d, _terms(t)) for d, t in docs]
    total, count = sum(len(t) for _, t in texts), sum(1 for _, t in texts if t)
    held = {}
    for _, t in texts:
        for term in set(t):
            held[term] = held.get(term, 0) + 1
    asked = {}
    for i, t in items:
        if t is not None:
            asked[i] = min(t, asked.get(i, t))
    out = []
    for i, text in asked.items():
        scores = []
        for d, t in texts:
            score = 0
            for term in _terms(text):
                tf = t.count(term)
                if tf:
                    w = math.floor(1000 * math.log((2 * count + 2) / (2 * held[term] + 1)))
                    score += w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + 75 * len(t) * count // total)))
            if score > 0:
                scores.append((-score, d is None, d))
        out += [(i, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=repr)


def _ranked(spark, docs, items):
    got = lexical.rank_documents(_clashing(spark.createDataFrame(docs, "doc_id long, text string")),
                                 _clashing(spark.createDataFrame(items, "item_id long, text string")))
    return sorted((tuple(r) for r in got.collect()), key=repr)


@pytest.mark.parametrize("lot,step,paired", [(100_000, 512, 64), (60, 3, 4)])
def test_ranks_are_those_of_all_documents(spark, monkeypatch, lot, step, paired):
    monkeypatch.setattr(lexical, "LOT_TERMS", lot)
    monkeypatch.setattr(lexical, "DOCUMENTS", step)
    monkeypatch.setattr(lexical, "PAIRED", paired)
    rng = random.Random(step)
    words = [f"w{i}" for i in range(60)] + ["Über", "ÇA", "x2", "日本"]
    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", ", ", "-", "\n", ". "]) for _ in range(rng.randrange(n)))
    docs = [(i, text(80)) for i in range(150)] + [(900 - i, "w1 w2 w3 W1") for i in range(40)]
    shared = text(20)
    items = [(i, text(25) + (shared if i % 3 else "")) for i in range(25)]
    rng.shuffle(docs)
    assert _ranked(spark, docs, items) == _brute_ranks(docs, items)


def test_ranks_of_odd_rows(spark):
    docs = [(1, "a b c"), (1, "a b c"), (2, None), (3, ""), (4, " .,;!\n"), (None, "a b"), (None, "a b"), (5, "A-a_a é"),
            (6, "word " * 50_000 + "a"), (7, "zz"), (-8, "a b c")]
    items = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (4, "?!"), (None, "c"), (5, "nowhere to be found"), (6, "a a a É é"),
             (7, "b"), (7, "a")]
    assert _ranked(spark, docs, items) == _brute_ranks(docs, items)
    assert _ranked(spark, [], items) == [] and _ranked(spark, docs, []) == []
    assert _ranked(spark, [(1, None), (2, "..")], items) == []


def test_sharing_graph_sums_and_saves():
    rng = random.Random(4)
    common = [rng.sample(range(300), 12) for _ in range(4)]
    items = [sum((c for c in common if rng.random() < 0.5), []) + [rng.randrange(400) for _ in range(10)] for _ in range(60)]
    items += [[], [7], [7, 7, 7], list(range(150))]
    graph = lexical.sharing_graph(items, 400)
    values = np.random.default_rng(2).integers(-5, 1 << 40, (400, 3))
    want = np.array([values[item].sum(axis=0) for item in items])
    assert (graph.item_sums(values) == want).all()
    assert graph.additions < 0.7 * sum(max(0, len(i) - 1) for i in items)
