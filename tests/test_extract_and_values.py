"""Extractors of names, frequent values and samples against plain Python."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from grainsift.operators import extractors, textscan, values


def _texts(spark):
    rows = [(1, "From New York to Rome, and back to new york!", None), (2, "romeo in ROME; (york)", "Rome"), (3, "", "york-rome"),
            (4, None, "new  york"), (5, "x" * 1000 + " rome", "New Yorkers")]
    return spark.createDataFrame(rows, "id long, a string, b string")


def test_names_by_automaton_and_by_join(spark):
    names = spark.createDataFrame([("New York", "GPE"), ("york", "GPE"), ("Rome", "GPE"), ("rome", "ORG"), (None, "GPE"), ("u.s.", "GPE")],
                                  "term string, entity_type string")
    df = _texts(spark)
    found = [{tuple(r) for r in f.collect()} for f in (
        extractors.listed_names(df, names, ["a", "b"]), textscan.joined_names(df, names.filter("term IS NOT NULL"), ["a", "b"]))]
    assert found[0] == found[1] == {
        ("a", "GPE", "new york", 1), ("a", "GPE", "york", 2), ("a", "GPE", "rome", 3), ("a", "ORG", "rome", 3),
        ("b", "GPE", "new york", 1), ("b", "GPE", "york", 2), ("b", "GPE", "rome", 2), ("b", "ORG", "rome", 2)}


def test_long_lists_are_joined(spark, monkeypatch):
    monkeypatch.setattr(extractors, "BROADCAST_NAMES", 1)
    names = spark.createDataFrame([("rome", "GPE"), ("york", "GPE")], "term string, entity_type string")
    assert extractors.listed_names(_texts(spark), names, ["a"]) is None
    assert textscan.entity_leakage(_texts(spark), names, ["a"]).count() == 2


def test_own_extractor_gets_batches(spark):
    def codes(texts):
        return [[("CODE", c) for c in re.findall(r"[A-Z]{2}\d", t)] for t in texts]
    df = spark.createDataFrame([("AB1 AB1 CD2",), ("AB1",), (None,), ("",)], "t string")
    assert {tuple(r) for r in textscan.entity_leakage(df, codes, ["t"]).collect()} == {("t", "CODE", "AB1", 2), ("t", "CODE", "CD2", 1)}
    report = textscan.nlp_report(df, ["t"], codes).first()
    assert (report["n_texts"], report["n_terms"], report["n_entity_types"], report["entity_leakage"]) == (3, 2, 1, True)
    assert textscan.entity_leakage(df.limit(0), codes, ["t"]).count() == 0


def test_top_values_of_frequent_and_unique_columns(spark, monkeypatch):
    monkeypatch.setattr(values, "TRACKED", 64)
    rng = random.Random(3)
    rows = [(rng.choice("aaaaabbbbccd") if i % 3 else f"r{i}", f"u{i:05d}", None if i % 2 else i % 7, None) for i in range(3000)]
    df = spark.createDataFrame(rows, "mixed string, single string, number int, empty string")
    got = {}
    for r in values.top_values(df, df.columns, 4).collect():
        got.setdefault(r["column_name"], []).append((r["rank"], r["value"], r["n"]))
    for c, place in (("mixed", 0), ("single", 1), ("number", 2)):
        counts = Counter(str(r[place]) for r in rows if r[place] is not None)
        want = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:4]
        assert sorted(got[c]) == [(i, v, n) for i, (v, n) in enumerate(want, 1)]
    assert "empty" not in got
    assert values.top_values(df.limit(0), ["mixed"], 3).count() == 0


def test_samples_are_the_same_however_the_table_is_dealt(spark):
    df = spark.range(500).select("id", F.concat(F.lit("text "), "id").alias("t"), F.when(F.col("id") % 50 == 0, F.lit("rare")).alias("s"))
    first = {tuple(r) for r in values.sample_cells(df, "id", ["t", "s"], 20).collect()}
    assert first == {tuple(r) for r in values.sample_cells(df.repartition(13), "id", ["t", "s"], 20).collect()}
    assert Counter(c for c, _, _ in first) == {"t": 20, "s": 10}
    # a sample of samples is the sample
    halves = [values.sample_cells(df.filter(f"id % 2 = {k}"), "id", ["t"], 20) for k in (0, 1)]
    again = halves[0].union(halves[1]).withColumnRenamed("value", "t").drop("column_name")
    assert {tuple(r) for r in values.sample_cells(again, "id", ["t"], 20).collect()} == {r for r in first if r[0] == "t"}
    picked = textscan.sample_texts(df, "id", 20, ["t", "s"])
    assert picked.agg(F.count("t"), F.count("s")).first()[:] == (20, 10)
    assert textscan.encoding_issues(picked, ["t"]).first()["n_rows"] == 0
    assert values.sample_rows(df, "id", 7).count() == 7
