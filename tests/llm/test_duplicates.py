"""Near-duplicate texts and vectors, and benchmark passages, against brute force."""

import math
import random
import re

import numpy as np
import pytest

from grainsift.llm import decontaminate, embeddings, minhash


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _shingles(text, width):
    w = _words(text)
    return {tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def _components(ids, linked):
    label = {i: i for i in ids}
    for _ in ids:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


def _family(rng, size, length, edits):
    base = [f"w{rng.randrange(500)}" for _ in range(length)]
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(length)] = f"w{rng.randrange(500)}"
        yield " ".join(copy)


@pytest.mark.parametrize("percent,width", [(85, 3), (80, 5)])
def test_near_duplicates_are_those_of_all_pairs(spark, percent, width):
    rng = random.Random(percent)
    texts = [t for edits in (0, 1, 2, 4, 6) for t in _family(rng, 14, 80, edits)]
    texts += [t for t in _family(rng, 40, 120, 5)] + ["a", "a", "A", "a b", "a  b", "b a", "", " ", None]
    rng.shuffle(texts)
    sets = [_shingles(t, width) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j]
              and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    label = _components(range(len(texts)), linked)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), percent, width)
    for r in got.collect():
        i = r["doc_id"]
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[i]), label[i], label[i] == i)


def test_large_family_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(9)
    texts = list(_family(rng, 150, 100, 6))
    sets = [_shingles(t, 3) for t in texts]
    linked = [(i, j) for i in range(150) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    label = _components(range(150), linked)
    got = minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == label


def test_sequential_test_keeps_likely_pairs():
    rng = np.random.default_rng(3)
    same = rng.random((2000, minhash.HASHES))
    a = rng.integers(0, 1 << 32, (2000, minhash.HASHES), dtype=np.uint64).astype(np.uint32)
    for similarity, low, high in ((0.9, 0.999, 1), (0.85, 0.999, 1), (0.3, 0, 0.001)):
        b = np.where(same < similarity, a, a + np.uint32(1))
        alive, equal = minhash.sequential_survivors(a, b, 0.85, 1e-6)
        assert low <= len(alive) / 2000 <= high
        assert (equal == (a[alive] == b[alive]).sum(axis=1)).all()


def test_one_row_of_each_group_stays(spark, edge_docs):
    got = minhash.drop_near_duplicates(edge_docs)
    assert got.columns == edge_docs.columns
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got.collect()) == sorted(
        (r["doc_id"] or -1, r["text"] or "") for r in edge_docs.collect() if not (r["doc_id"] == 6))
    rows = {(r["doc_id"], r["text_key"]): r for r in minhash.near_duplicates(edge_docs).collect()}
    assert len(rows) == 11
    assert minhash.drop_near_duplicates(edge_docs.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x y z"), (None, "x y z"), (4, "x y z"), (4, "p q")], "doc_id long, text string")
    assert sorted(tuple(r) for r in minhash.drop_near_duplicates(nulls).collect()) == [(4, "p q"), (4, "x y z")]


def _vectors(rng):
    rows = []
    for label in (0, 1, 2):
        for _ in range(25):
            center = rng.normal(size=16)
            for _ in range(rng.integers(1, 8)):
                rows.append(((center + rng.normal(size=16) * rng.choice([0, 0.05, 0.15])).astype(np.float32).tolist(), label))
    return rows


@pytest.mark.parametrize("cell_rows,block", [(10_000, 1024), (20, 8)])
def test_vectors_are_linked_as_by_all_pairs(spark, monkeypatch, cell_rows, block):
    monkeypatch.setattr(embeddings, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(embeddings, "BLOCK", block)
    rows = _vectors(np.random.default_rng(4))
    bad = [(None, 0), ([0.0] * 16, 0), ([1.0] * 16, None), ([float("nan")] * 16, 0), ([], 1), ([1.0, None], 1), ([1.0, 2.0], 1)]
    rows = [(i, v, l) for i, (v, l) in enumerate(rows + bad)]
    good = len(rows) - len(bad)
    x = np.array([v for _, v, _ in rows[:good]], dtype=float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    labels = np.array([l for _, _, l in rows[:good]])
    near = (x @ x.T >= 0.98) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    want = _components(range(len(rows)), list(zip(*np.nonzero(near))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for r in embeddings.near_vectors(df).collect():
        i = r["vec_id"]
        links = int(near[i].sum()) if i < good else 0
        assert (r["n_links"], r["component_id"], r["kept"]) == (links, want[i], want[i] == i)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_repeated_vectors_are_copies(spark):
    df = spark.createDataFrame([(3, [1.0, 0.0], "a"), (3, [1.0, 0.0], "a"), (None, [2.0, 0.0], "a"), (1, [0.0, 1.0], "a")],
                               "vec_id long, embedding array<double>, label string")
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in embeddings.near_vectors(df).collect())
    assert got == [(-1, 2, 3, False), (1, 0, 1, True), (3, 2, 3, True), (3, 2, 3, True)]


def _letters(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _nearest(item, text):
    """Least edit distance of the item to any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def _edited(rng, words, count):
    words = list(words)
    for _ in range(count):
        kind, at = rng.random(), rng.randrange(len(words))
        if kind < 0.4:
            words[at] = f"v{rng.randrange(300)}"
        elif kind < 0.7 and len(words) > 1:
            del words[at]
        else:
            words.insert(at, f"v{rng.randrange(300)}")
    return words


def test_leaks_are_found_and_exact(spark):
    rng = random.Random(6)
    items = [[f"v{rng.randrange(300)}" for _ in range(n)] for n in (1, 2, 4, 9, 13, 20, 21, 33, 50, 64) for _ in range(6)]
    docs, planted = [], {}
    for i, item in enumerate(items):
        for share in (0.0, 0.1, 0.2):
            around = [[f"u{rng.randrange(900)}" for _ in range(rng.randrange(60))] for _ in range(2)]
            body = _edited(rng, item, int(len(item) * share))
            planted[len(docs)] = i
            docs.append(around[0] + body + around[1])
    docs += [[f"u{rng.randrange(900)}" for _ in range(200)] for _ in range(50)]
    texts = [(i, ", ".join(d).title() if i % 2 else " ".join(d)) for i, d in enumerate(docs)]
    got = decontaminate.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"),
                                   spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]): r for r in got.collect()}
    want = {(d, i) for d in range(len(docs)) for i, item in enumerate(items)
            if _nearest(item, docs[d]) <= decontaminate.edits(len(item), 0.8)}
    assert set(found) <= want
    assert len(found) >= 0.99 * len(want)
    assert {(d, i) for d, i in planted.items()} <= want
    exact = 0
    for (d, i), r in found.items():
        near = _nearest(items[i], docs[d])
        assert near <= r["distance"] <= decontaminate.edits(len(items[i]), 0.8)
        assert _from(items[i], docs[d][r["start_word"]:]) == r["distance"]
        exact += near == r["distance"]
        assert near < r["distance"] or all(_from(items[i], docs[d][s:]) > near for s in range(r["start_word"]))
        assert r["similarity"] == pytest.approx(1 - r["distance"] / len(items[i])) and r["n_item_words"] == len(items[i])


    assert exact >= 0.99 * len(found)


def _from(item, text):
    """Least edit distance of the item to any beginning of the text."""
    row = list(range(len(text) + 1))
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_long_leaks_at_the_full_share_of_edits(spark):
    rng = random.Random(17)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (50, 90, 150, 300) for _ in range(25)]
    docs = [[f"u{rng.randrange(900)}" for _ in range(rng.randrange(40))] + _edited(rng, item, len(item) // 5)
            + [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(40))] for item in items]
    got = decontaminate.find_leaks(spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string"),
                                   spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in got.collect()}
    assert len(found & {(i, i) for i in range(len(items))}) >= 0.99 * len(items)


def test_a_verbatim_long_leak_is_few_rows(spark):
    rng = random.Random(1)
    item = [f"v{rng.randrange(5000)}" for _ in range(800)]
    text = " ".join(["before"] * 50 + item + ["after"] * 50)
    runs = []
    original = decontaminate.materialize
    decontaminate.materialize = lambda df: runs.append(original(df)) or runs[-1]
    try:
        got = decontaminate.find_leaks(spark.createDataFrame([(1, text)], "doc_id long, text string"),
                                       spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    finally:
        decontaminate.materialize = original
    assert [(r["start_word"], r["distance"]) for r in got] == [(50, 0)]
    size = [r for r in runs if "region" in r.columns][0].selectExpr("sum(octet_length(region) + 8 * size(keys))").first()[0]
    assert size < 1_000_000


def test_distance_to_prefixes():
    rng = random.Random(8)
    pairs = [([rng.randrange(1, 5) for _ in range(rng.randrange(1, 9))], [rng.randrange(1, 5) for _ in range(rng.randrange(0, 9))])
             for _ in range(200)]
    got = decontaminate.prefix_distances(*[[np.array(x, np.uint64) for x in side] for side in zip(*pairs)])
    for (a, b), d in zip(pairs, got):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
            row = new
        assert d == min(row)


def test_leaks_of_odd_rows(spark, edge_docs):
    items = spark.createDataFrame([(1, "same words for a copy of this text"), (1, ""), (None, None), (2, "456 123 789 999 111"), (2, "word word word word the end")],
                                  "item_id long, text string")
    found = sorted((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.find_leaks(edge_docs, items).collect())
    assert found == [(4, 2, 0), (5, 1, 0), (6, 1, 0)]
    left = decontaminate.drop_leaks(edge_docs, items)
    assert left.columns == edge_docs.columns and left.count() == 8
    assert decontaminate.find_leaks(edge_docs.limit(0), items).count() == 0
    assert decontaminate.find_leaks(edge_docs, items.limit(0)).count() == 0
    assert math.isclose(decontaminate.SIMILARITY, 0.8)


@pytest.mark.parametrize("n", [80, 120, 200, 400, 800])
def test_long_items_are_found_at_the_full_share_of_edits(n):
    rng, trials = random.Random(n), 100
    size = decontaminate.SizeClass(decontaminate.class_of(n), [n], 0.8)
    items = [[rng.getrandbits(63) for _ in range(n)] for _ in range(trials)]
    # only the window at the passage's own start, as others are further from the item
    texts = [[w if isinstance(w, int) else int(w[1:]) + 1 for w in _edited(rng, item, n // 5)]
             + [rng.getrandbits(63) for _ in range(n)] for item in items]
    windows = np.array([t[:size.length] for t in texts], np.uint64)
    found = (size.keys(windows) == size.keys(np.array(items, np.uint64))).any(axis=1).sum()
    assert found >= 0.98 * trials
