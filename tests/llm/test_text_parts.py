"""Words from bytes, hash tables, permutations, links."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from grainsift.llm.links import component_labels
from grainsift.llm.sharding import permute, unpermute
from grainsift.llm.tokens import LETTERS, SPACED, HashIndex, joined, word_slices

_PATTERNS = {"spaced": (SPACED, r"[^\x20\x09-\x0D]+"), "letters": (LETTERS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")}


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("kind", list(_PATTERNS))
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aBz 9\t\n.éÄ漢😀-\x1c", max_size=30)), max_size=12), st.integers(1, 40))
def test_words_are_those_of_the_pattern(kind, texts, slice_bytes):
    table, pattern = _PATTERNS[kind]
    got, hashes = [], {}
    for part in word_slices(pa.array(texts, pa.string()), table, slice_bytes):
        assert part.row == len(got)
        for i in range(part.rows):
            places = range(part.first[i], part.first[i + 1])
            got.append([part.text(k) for k in places])
            for k in places:
                assert hashes.setdefault(part.text(k), part.hash[k]) == part.hash[k]
    assert got == [re.findall(pattern, lower(t)) for t in texts]
    assert len(set(hashes.values())) == len(hashes)


def test_joined_slices_are_one_slice():
    texts = pa.array(["a b", "", None, "ccc", "d\té x", " "], pa.string())
    whole, parts = next(word_slices(texts, SPACED)), list(word_slices(texts, SPACED, 1))
    one = joined(parts)
    assert len(parts) > 2
    for name in ("data", "offsets", "start", "end", "hash", "first"):
        assert (getattr(one, name) == getattr(whole, name)).all()


def test_hash_index_finds_exactly_its_keys():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64))
    index = HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all()
    assert (index.find(np.setdiff1d(rng.integers(0, 1 << 63, 5000, dtype=np.uint64), keys)) == -1).all()
    assert (HashIndex(keys[:0]).find(keys) == -1).all()


@pytest.mark.parametrize("size", [1, 2, 3, 5, 16, 17, 1000, 65536, 70001])
def test_feistel_is_a_bijection_with_an_inverse(size):
    numbers = np.arange(size)
    places = permute(numbers, size, 4)
    assert sorted(places) == list(range(size))
    assert (unpermute(places, size, 4) == numbers).all()
    if size > 500:
        assert abs(np.corrcoef(numbers, places)[0, 1]) < 0.15
        assert (permute(numbers, size, 5) != places).any()


def test_components_of_random_graphs(spark):
    rng = random.Random(2)
    for nodes, edges in ((1, 1), (60, 40), (300, 280)):
        pairs = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(edges)] + [(i, i + 1) for i in range(400, 440)]
        label = {x: x for p in pairs for x in p}
        for _ in label:
            for a, b in pairs:
                label[a] = label[b] = min(label[a], label[b])
        got = {r["id"]: r["label"] for r in component_labels(spark.createDataFrame(pairs, "a long, b long")).collect()}
        alone = {a for a, b in pairs if a == b} - {x for p in pairs if p[0] != p[1] for x in p}
        assert got == {k: v for k, v in label.items() if k not in alone}
