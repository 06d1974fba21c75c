import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from grainsift.functions import similarity
from grainsift.operators import graph, nearpairs, stringpairs
from grainsift.operators.graph import components, greedy_drop
from grainsift.operators.stringpairs import indel_pairs, levenshtein_pairs
from grainsift.plans.cleaning import deduplicate, fuzzy_dedup, near_removals


def _texts(seed=4, n=160):
    """Random texts of which a third are copies and near copies of one text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    hot = rng.sample(words, 25)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            text = list(hot)
            if i % 2:
                text[rng.randrange(25)] = f"x{i}"
        else:
            text = rng.sample(words, rng.randint(1, 20))
        rows.append((i, " ".join(text)))
    return rows


def _jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("threshold", [0.5, 0.85, 0.9])
@pytest.mark.parametrize("block_rows", [3, 2_000])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, threshold, block_rows):
    monkeypatch.setattr(nearpairs.block_self_join, "__defaults__", (block_rows,))
    rows = _texts()
    df = spark.createDataFrame(rows, "id long, text string")
    got = nearpairs.near_duplicates(df, "id", threshold).collect()
    sets = {i: set(t.split()) for i, t in rows}
    total = sum(1 for a, b in itertools.combinations(sets, 2) if _jaccard(sets[a], sets[b]) >= threshold - 1e-9)
    assert sum(r["row_pairs"] for r in got) == total
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    reps = sorted(first.values())
    expected = {(a, b) for a, b in itertools.combinations(reps, 2) if _jaccard(sets[a], sets[b]) >= threshold - 1e-9}
    assert {(r["id_a"], r["id_b"]) for r in got if r["id_a"] != r["id_b"]} == expected


@pytest.mark.parametrize("threshold", [0.5, 0.8, 0.9, 1.0])
def test_similar_sets_in_small_blocks_and_cells(spark, monkeypatch, threshold):
    monkeypatch.setattr(nearpairs, "BLOCK_ROWS", 3)
    monkeypatch.setattr(nearpairs, "CELL_PAIRS", 4)
    monkeypatch.setattr(nearpairs, "BROADCAST_PAIRS", 5)
    rows = _texts(seed=12) + [(500, None), (501, " ")]
    found = nearpairs.token_sets(spark.createDataFrame(rows, "id long, text string"), "id")
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in nearpairs.similar_sets(found, threshold).collect()}
    first = {}
    for i, t in sorted(rows):
        first.setdefault(frozenset((t or "").split()), i)
    scores = {tuple(sorted((first[a], first[b]))): _jaccard(a, b) for a, b in itertools.combinations(first, 2)}
    assert got == pytest.approx({p: s for p, s in scores.items() if s >= threshold - 1e-9})


def test_sets_with_the_same_id_are_compared_each(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d e"), (2, "a b c d f"), (None, "a b c d g")], "id long, text string")
    got = sorted(tuple(r) for r in nearpairs.near_duplicates(df, "id", 0.6).select("id_a", "id_b", F.round("jaccard", 4)).collect())
    assert got == [(1, 2, 0.6667), (1, 2, 0.8)]


def test_few_candidates_where_common_tokens_are_in_every_prefix(spark):
    rows = [(i, f"number{i} " + " ".join(f"common{k}" for k in range(11))) for i in range(300)]
    rows += [(1000 + i, f"number{i} mail{i} " + " ".join(f"common{k}" for k in range(11))) for i in range(0, 300, 100)]
    found = nearpairs.token_sets(spark.createDataFrame(rows, "id long, text string"), "id")
    assert nearpairs.candidate_pairs(found.sets, 0.9).count() <= 20


def test_members_lists_every_row_once(spark):
    rows = _texts()
    found = nearpairs.token_sets(spark.createDataFrame(rows, "id long, text string"), "id")
    members = found.members.collect()
    assert sorted(r["row_id"] for r in members) == [i for i, _ in rows]
    assert found.sets.agg(F.sum("copies")).first()[0] == len(rows)


def test_minhash_finds_near_copies(spark):
    found = nearpairs.token_sets(spark.createDataFrame(_texts(), "id long, text string"), "id")
    exact = {(r["id_a"], r["id_b"]) for r in nearpairs.similar_sets(found, 0.9).collect()}
    loose = {(r["id_a"], r["id_b"]) for r in nearpairs.similar_sets(found, 0.6).collect()}
    signed = {(r["id_a"], r["id_b"]) for r in nearpairs.minhash_pairs(found, 0.9).collect()}
    assert signed <= loose
    assert len(signed & exact) >= 0.5 * len(exact)


@pytest.mark.parametrize("threshold", [0.6, 0.9])
def test_fuzzy_dedup_is_greedy_in_row_order(spark, threshold):
    rows = _texts(seed=9) + [(1000, ""), (1001, " ")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = sorted(r["id"] for r in fuzzy_dedup(df, "id", threshold).collect())
    kept, dropped = [], set()
    sets = {i: set(t.lower().split()) or {"__empty__"} for i, t in rows}
    for i, _ in rows:
        if i in dropped:
            continue
        kept.append(i)
        dropped |= {j for j, _ in rows if j > i and _jaccard(sets[i], sets[j]) >= threshold - 1e-9}
    assert got == kept
    again = fuzzy_dedup(df.filter(F.col("id").isin(got)), "id", threshold)
    assert again.count() == len(got)


def test_greedy_choice_in_batches(spark, monkeypatch):
    """Small batches, one of them taken again in smaller ones, and a family whose pairs are not all looked at."""
    monkeypatch.setattr(nearpairs, "SEED_SETS", 15)
    monkeypatch.setattr(nearpairs, "BATCH_GROWTH", 4)
    monkeypatch.setattr(nearpairs, "BATCH_MEETINGS", 0)
    monkeypatch.setattr(nearpairs, "BATCH_PAIRS", 60)
    looked_at = []

    def counted(pairs):
        looked_at.append(pairs.count())
        return greedy_drop(pairs)
    monkeypatch.setattr(nearpairs, "greedy_drop", counted)
    rows = [(i, "one two three four five six seven eight nine " + f"x{i}") for i in range(0, 300, 2)] + [
        (i, t + " more") for i, t in _texts(seed=3, n=300) if i % 2]
    got = {r["id"]: r["kept_id"] for r in near_removals(spark.createDataFrame(rows, "id long, text string"), "id", 0.8).collect()}
    kept, expected = [], {}
    for i, t in sorted(rows):
        by = next((k for k, u in kept if _jaccard(set(t.split()), u) >= 0.8 - 1e-9), None)
        if by is None:
            kept.append((i, set(t.split())))
        else:
            expected[i] = by
    assert got == expected
    assert len(looked_at) > 1 and sum(looked_at) < 150 * 149 / 2 / 4


def test_components_of_chain_star_and_ring(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, i) for i in range(101, 130)]
    ring = [(200 + i, 200 + (i + 1) % 9) for i in range(9)]
    got = {r["id"]: r["cluster_id"] for r in components(
        spark.createDataFrame(chain + star + ring, "id_a long, id_b long")).collect()}
    assert all(got[i] == 0 for i in range(41))
    assert all(got[i] == 100 for i in range(100, 130))
    assert all(got[i] == 200 for i in range(200, 209))


def test_greedy_drop_on_random_graph(spark):
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(60), 2))) for _ in range(110)})
    got = {r["id"] for r in greedy_drop(spark.createDataFrame(pairs, "id_a long, id_b long")).collect()}
    dropped = set()
    for i in range(60):
        if i not in dropped:
            dropped |= {b for a, b in pairs if a == i}
    assert got == dropped


@pytest.mark.parametrize("most", [200_000, 3])
def test_greedy_choice_in_one_pass_and_in_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "GROUP_EDGES", most)
    rng = random.Random(most)
    pairs = sorted({tuple(sorted(rng.sample(range(k * 40, k * 40 + 30), 2))) for k in range(4) for _ in range(5 + 12 * k)})
    dropped = set()
    for a, b in pairs:
        if a not in dropped:
            dropped.add(b)
    got = greedy_drop(spark.createDataFrame([(b, a) for a, b in pairs], "id_a long, id_b long")).collect()
    assert sorted(r["id"] for r in got) == sorted(dropped)


def test_removed_rows_name_the_row_they_repeat(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j"), (3, "j i h g f e d c b a"), (4, "a b c d e f g h i j k"),
            (5, "a b c d e f g h i j k l"), (6, "other words"), (7, None), (8, ""), (9, None)]
    found = deduplicate(spark.createDataFrame(rows, "id long, t string"), "id", 0.9)
    got = {r["id"]: (r["stage"], r["kept_id"], round(r["similarity"], 4)) for r in found.removed.collect()}
    # 5 is alike to 4 only, and 4 is dropped
    assert got == {2: ("exact_duplicate", 1, 1.0), 9: ("exact_duplicate", 7, 1.0), 3: ("near_duplicate", 1, 1.0),
                   4: ("near_duplicate", 1, 0.9091), 8: ("near_duplicate", 7, 1.0)}
    assert sorted(r["id"] for r in found.table.collect()) == [1, 5, 6, 7]
    assert tuple(found.report.first()) == (2, 3, 5, 9, 4, 0.9)


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        previous, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def _common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(previous[j - 1] + 1 if x == y else max(previous[j], row[-1]))
    return row[-1]


@pytest.fixture(scope="module")
def spellings():
    rng = random.Random(6)
    out = {"a", "ab", "usa", "u.s.a", "canada", "canadas", "café", "cafe"}
    for _ in range(25):
        base = "".join(rng.choice("abcd") for _ in range(rng.randint(3, 16)))
        out.add(base)
        at = rng.randrange(len(base))
        out |= {base[:at] + base[at + 1:], base[:at] + "x" + base[at:], base[:at] + "y" + base[at + 1:], base + "zz"}
    return sorted(s for s in out if s)


def test_levenshtein_pairs_equal_brute_force(spark, spellings):
    df = spark.createDataFrame([("c", s) for s in spellings], "column_name string, value string")
    got = {(r["value_a"], r["value_b"]) for r in levenshtein_pairs(df).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(spellings, 2)
                   if 1 - _edit(a, b) / max(len(a), len(b)) >= 0.85}


def test_common_subsequences_of_many_pairs_at_once():
    rng = random.Random(5)
    texts = ["", "a", "\0", "a\0", "\U0001f600a\u00e9", "x" * 64, "x" * 65, "ab" * 32, "ba" * 40, None] + [
        "".join(rng.choice("ab\u00e9\U0001f600\0") for _ in range(rng.choice([3, 20, 63, 64, 70]))) for _ in range(40)]
    a, b = (pd.Series(list(x), dtype=object) for x in zip(*itertools.product(texts, texts)))
    got = similarity.common_subsequence.func(a, b)
    assert [None if pd.isna(n) else n for n in got] == [None if x is None or y is None else _common(x, y) for x, y in zip(a, b)]
    short = [x for x in texts if x and len(x) <= 64] * 40
    assert len(similarity._common_lengths(short, short[::-1])) == len(short)


def test_indel_pairs_equal_brute_force(spark, spellings):
    df = spark.createDataFrame([("c", s) for s in spellings], "column_name string, value string")
    got = {(r["value_a"], r["value_b"]): r["score"] for r in indel_pairs(df).collect()}
    expected = {(a, b): 200 * _common(a, b) / (len(a) + len(b)) for a, b in itertools.combinations(spellings, 2)}
    assert got == pytest.approx({p: s for p, s in expected.items() if s >= 85})


@pytest.mark.parametrize("at_least", [0.3, 0.6, 0.75, 0.9, 1.0])
def test_levenshtein_pairs_at_other_thresholds(spark, spellings, at_least):
    df = spark.createDataFrame([(c, s) for c in "cd" for s in spellings[::2]] + [("c", ""), ("c", None)], "column_name string, value string")
    got = {(r["column_name"], r["value_a"], r["value_b"]) for r in levenshtein_pairs(df, at_least).collect()}
    assert got == {(c, a, b) for a, b in itertools.combinations(spellings[::2], 2) for c in "cd"
                   if 1 - _edit(a, b) / max(len(a), len(b)) >= at_least}


@pytest.mark.parametrize("at_least", [40, 70, 95])
def test_indel_pairs_at_other_thresholds(spark, spellings, at_least):
    df = spark.createDataFrame([("c", s) for s in spellings[::2]], "column_name string, value string")
    got = {(r["value_a"], r["value_b"]) for r in indel_pairs(df, at_least).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(spellings[::2], 2)
                   if 200 * _common(a, b) / (len(a) + len(b)) >= at_least}


def test_long_strings_and_hot_grams(spark, monkeypatch):
    """Edits up to the full share in strings of every gram size, among strings that share most q-grams."""
    monkeypatch.setattr(nearpairs, "BLOCK_ROWS", 7)
    rng = random.Random(11)
    values = set()
    for length in (30, 47, 55, 90, 110, 150, 170, 260):
        base = [rng.choice("abcdefgh ") for _ in range(length)]
        for edits in (0, 1, int(length * 0.1), int(length * 0.145), int(length * 0.15), int(length * 0.16)):
            for _ in range(3):
                text = list(base)
                for _ in range(edits):
                    at = rng.randrange(len(text))
                    text[at:at + rng.randrange(2)] = rng.choice(["", "x", "y", "\u00e9"])
                values.add("same beginning " + "".join(text))
    values = sorted(values)
    df = spark.createDataFrame([("c", s) for s in values], "column_name string, value string")
    got = {(r["value_a"], r["value_b"]) for r in levenshtein_pairs(df).collect()}
    assert got == {(a, b) for a, b in itertools.combinations(values, 2) if 1 - _edit(a, b) / max(len(a), len(b)) >= 0.85}


def test_few_candidates_among_texts_of_few_words(spark):
    rng = random.Random(2)
    words = [["large", "small", "old", "new", "red", "blue", "green", "heavy"],
             ["plate", "bolt", "ring", "gear", "screw", "widget", "bracket", "spring"],
             ["PROMO", "MEDIUM", "ECONOMY", "SMALL", "STANDARD", "LARGE"]]
    values = sorted({" ".join([*[rng.choice(w) for w in words], f"Brand#{rng.randrange(25)}"]) for _ in range(700)})
    df = spark.createDataFrame([(i, "c", v, len(v)) for i, v in enumerate(values)], "rep long, column_name string, value string, len int")
    n = stringpairs.candidate_pairs(df, stringpairs.levenshtein_rule(0.85)).count()
    assert n < 0.05 * len(values) * (len(values) - 1) / 2
