"""Small hand-made cases for rules that are easy to get wrong."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainsift import AnalysisConfig, CleaningConfig
from grainsift.functions.similarity import indel_ratio
from grainsift.functions.text import language, reading_ease, syllable_count
from grainsift.operators import (
    balance, bias, dates, duplicates, forest, noise, outliers, profile, semantic, textscan, typeinfer)
from grainsift.operators.impute import impute
from grainsift.plans.cleaning import clean
from grainsift.plans.scoring import score_measures
from grainsift.sources import readers, writers


def test_settings_are_checked():
    with pytest.raises(ValueError):
        AnalysisConfig(bias_threshold=1.2)
    with pytest.raises(ValueError):
        CleaningConfig(imputation_strategy="guess")
    with pytest.raises(ValueError):
        CleaningConfig(column_strategies={"a": "guess"})
    assert AnalysisConfig.threshold_from_tolerance(30) == pytest.approx(0.7)


def test_indel_is_not_levenshtein(spark):
    rows = [("us", "usa", 80.0), ("u.s.a", "usa", 75.0), ("", "usa", 0.0), ("abc", "abc", 100.0)]
    got = spark.createDataFrame(rows, "a string, b string, r double").select(indel_ratio(F.col("a"), F.col("b")), "r").collect()
    assert all(x == pytest.approx(y) for x, y in got)


@pytest.mark.parametrize("text, n", [("the", 1), ("rate", 1), ("see", 1), ("table", 1), ("banana", 3), ("rhythm", 1),
                                     ("bcd", 1), ("eye", 1), ("the Rate, bcd.", 3), ("élève", 1), ("", 0)])
def test_syllables(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(syllable_count(F.col("t"))).first()[0] == n


def test_reading_ease_and_language(spark):
    rows = [("The cat sat. The dog ran!", "en"), ("el perro y la casa", "es"), ("le chat est une bete", "fr"),
            ("zzz qqq", "other"), ("la de", "es"), ("...", "other"), (None, None)]
    df = spark.createDataFrame(rows, "t string, l string")
    assert [r[0] for r in df.select(language(F.col("t"))).collect()] == [r[1] for r in rows]
    scores = [r[0] for r in df.select(reading_ease(F.col("t"))).collect()]
    assert scores[0] == 100.0 and scores[5] is None and scores[6] is None


def test_encoding_issues_count_line_breaks(spark):
    df = spark.createDataFrame([("a\nb",), ("ok",), ("bad �",), ("\x85",)], "t string")
    assert textscan.encoding_issues(df, ["t"]).first()["n_rows"] == 3
    assert textscan.encoding_issues(df, ["t"], ignore_ws=True).first()["n_rows"] == 2


def test_sensitive_names_follow_word_bounds():
    names = ["age", "age_group", "Zip Code", "user_gender", "Marital Status", "income"]
    assert bias.sensitive_column_names(names) == ["age", "Zip Code", "Marital Status", "income"]


def test_bias_score_bounds(spark):
    df = spark.createDataFrame([(0.7,), (0.796,), (1.0,)], "f double")
    assert [r[0] for r in df.select(bias.bias_score(F.col("f"), 0.70)).collect()] == [0.0, 32.0, 100.0]


def test_fairness_without_privileged_rows(spark):
    df = spark.createDataFrame([("female", 1), ("female", 0), (None, 1)], "gender string, y int")
    row = bias.fairness_rates(df, ["gender"], "y").first()
    assert row["disparate_impact"] is None and row["parity_difference"] is None


def test_numeric_proxy_keeps_missing_group(spark):
    rows = [("a", 1.0), ("b", 2.0), (None, 5.0), ("c", 4.0), ("b", None), (None, 0.5)]
    df = spark.createDataFrame(rows, "s string, x double")
    code = {"a": 0, "b": 1, "c": 2, None: -1}
    kept = [(code[s], x) for s, x in rows if x is not None]
    expected = abs(np.corrcoef(*zip(*kept))[0, 1])
    assert bias.numeric_proxies(df, ["s"], ["x"]).first()["correlation"] == pytest.approx(expected)


def test_correlation_uses_rows_where_both_are_present(spark):
    rng = np.random.default_rng(0)
    a, b, c = rng.normal(1e6, 1, 300), rng.normal(size=300), np.ones(300)
    b += a - 1e6
    rows = [(float(x), None if i % 7 == 0 else float(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, c))]
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in bias.correlation_matrix(
        spark.createDataFrame(rows, "a double, b double, c double").repartition(6)).collect()}
    keep = [i for i in range(300) if i % 7]
    assert got[("a", "b")] == pytest.approx(abs(np.corrcoef(a[keep], b[keep])[0, 1]), abs=1e-9)
    assert got[("a", "c")] == 0.0 and got[("b", "c")] == 0.0


def test_one_class_has_two_ratios(spark):
    df = spark.createDataFrame([("x",), ("x",)], "y string")
    assert tuple(balance.imbalance_ratio(df, "y").first()) == (0.0, 1.0)
    assert balance.imbalance_report(df, None).first()["recommended_strategy"] == "No target column provided."


def test_constant_and_low_variance(spark):
    rows = [(None, "k", "a" if i else "b", i) for i in range(100)]
    df = spark.createDataFrame(rows, "n string, k string, m string, i int")
    assert {r[0] for r in noise.constant_columns(df).collect()} == {"n", "k"}
    assert [tuple(r) for r in noise.low_variance_columns(df).collect()] == [("m", 0.99)]


def test_exact_dedup_keeps_smallest_id_and_equal_nulls(spark):
    df = spark.createDataFrame([(3, None, "a"), (1, None, "a"), (2, 1, "a"), (4, 1, "a")], "id long, x int, y string")
    assert sorted(r["id"] for r in duplicates.exact_dedup(df, "id").collect()) == [1, 2]
    assert sorted(map(tuple, duplicates.duplicate_groups(df, "id").collect())) == [(1, 1), (1, 3), (2, 2), (2, 4)]


def test_duplicate_columns_need_equal_types(spark):
    df = spark.createDataFrame([(1, 1, 1.0, None), (2, 2, 2.0, None)], "a int, b int, c double, d int")
    assert [tuple(r) for r in duplicates.duplicate_columns(df).collect()] == [("b", "a")]


def test_capping_keeps_nulls_and_flat_columns(spark):
    df = spark.createDataFrame([(float(i % 10), 5.0) for i in range(50)] + [(900.0, 5.0), (None, 9.0)], "x double, y double")
    capped, report = outliers.cap_outliers(df)
    assert capped.agg(F.max("x")).first()[0] < 900 and capped.filter("x IS NULL").count() == 1
    assert capped.agg(F.max("y")).first()[0] == 9.0
    assert [r["column_name"] for r in report.collect()] == ["x"]


def test_forest_flags_the_tails(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(v)) for i, v in enumerate(rng.normal(size=2000))] + [(5000, 40.0), (5001, -40.0), (5002, None)]
    df = spark.createDataFrame(rows, "id long, x double").repartition(4)
    flagged = {r["id"] for r in forest.outliers_isolation_forest(df, "x", "id").collect()}
    assert {5000, 5001} <= flagged and 5002 not in flagged
    assert 0.02 * 2002 <= len(flagged) <= 0.06 * 2002
    assert flagged == {r["id"] for r in forest.outliers_isolation_forest(df.repartition(7), "x", "id").collect()}


def test_type_rules_and_failed_conversion(spark):
    rows = [("1" if i % 2 else "0", str(i), f"{i}.5" if i == 3 else str(i), f"{i % 2}e1x", "2024-02-30" if i == 1 else "2024-02-03",
             " ") for i in range(100)]
    df = spark.createDataFrame(rows, "flag string, n string, mixed string, cat string, day string, blank string")
    kinds = {r[0]: r[1] for r in typeinfer.infer_types(df).collect()}
    assert kinds == {"flag": "boolean", "n": "integer", "mixed": "integer", "cat": "categorical", "day": "datetime",
                     "blank": "categorical"}
    converted, report = typeinfer.convert_types(df, kinds)
    failed = {r["column_name"]: r["failure"] for r in report.collect() if r["failure"]}
    assert list(failed) == ["mixed"]
    assert dict(converted.dtypes) == {"flag": "boolean", "n": "bigint", "mixed": "string", "cat": "string",
                                      "day": "timestamp", "blank": "string"}
    assert converted.filter("day IS NULL").count() == 1


def test_impute_drop_changes_later_statistics(spark):
    df = spark.createDataFrame([(1, None, 100.0), (2, 1.0, 10.0), (3, 2.0, None), (4, 3.0, 20.0)], "id long, a double, b double")
    filled, report = impute(df, "mean", {"a": "drop"})
    assert filled.filter("id = 3").first()["b"] == 15.0 and filled.count() == 3
    assert {r["column_name"]: r["cells_filled"] for r in report.collect()} == {"a": 1, "b": 1}
    with pytest.raises(ValueError):
        impute(df, "forward_fill")
    with pytest.raises(ValueError):
        impute(df, "guess")


def test_score_bounds(spark):
    schema = ("missing_fraction double, max_outlier_fraction double, duplicate_fraction double, bias_score double, "
              "imbalance_ratio double, is_imbalanced boolean, format_error_columns long")
    worst, best = score_measures(spark.createDataFrame(
        [(1.0, 1.0, 1.0, 100.0, 50.0, True, 30), (0.0, 0.0, 0.0, 0.0, 2.0, False, 0)], schema)).collect()
    assert (worst["overall"], worst["grade"], best["overall"], best["grade"]) == (0.0, "F", 100.0, "A")


def test_cleaning_is_repeatable_and_reports(spark):
    rows = [(i, float(i % 9) if i % 5 else None, "n/a" if i % 4 else str(i), f"text number {i % 30}") for i in range(60)]
    df = spark.createDataFrame(rows + [(100, *rows[1][1:])], "id long, x double, t string, s string")
    result = clean(df, CleaningConfig(), "id")
    shape = result.reports["shape"].first()
    assert shape["original_rows"] == 61 and shape["final_rows"] == result.table.count()
    assert result.table.filter("x IS NULL").count() == 0
    shuffled = clean(df.repartition(5), CleaningConfig(), "id")
    assert sorted(map(str, shuffled.table.collect())) == sorted(map(str, result.table.collect()))


def test_reports_do_not_depend_on_row_order(spark):
    df = spark.createDataFrame([(float(i * 7 % 23), str(i % 5)) for i in range(200)], "x double, s string")
    for report in (profile.describe_numeric, noise.noise_report, noise.value_noise):
        assert sorted(map(str, report(df).collect())) == sorted(map(str, report(df.repartition(6, "s")).collect()))


def test_readers(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}], indent=1))
    (tmp_path / "l.json").write_text('{"x": 1, "y": "a"}\n{"x": 2, "y": "b"}\n')
    for name in ("a.json", "l.json"):
        assert sorted(map(tuple, readers.read_table(spark, str(tmp_path / name)).collect())) == [(1, "a"), (2, "b")]
    (tmp_path / "t.csv").write_bytes("﻿id,n,name\n1,NA,none\n2,3.5,null\n".encode("utf-8"))
    csv = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert csv.dtypes == [("id", "bigint"), ("n", "double"), ("name", "string")]
    assert sorted(map(tuple, csv.collect())) == [(1, None, "none"), (2, 3.5, None)]
    (tmp_path / "w.csv").write_bytes("name\ncafé\n".encode("latin-1"))
    assert readers.detect_encoding(spark, str(tmp_path / "w.csv")) == "ISO-8859-1"
    assert readers.detect_encoding(spark, str(tmp_path / "t.csv")) == "UTF-8"
    assert readers.read_csv(spark, str(tmp_path / "w.csv"), encoding="ISO-8859-1").first()[0] == "café"
    with pytest.raises(ValueError):
        readers.read_table(spark, "table.xlsx")
    assert writers.cleaned_name("my data (1).csv") == "my_data__1__cleaned.csv"


def test_types_follow_plain_numbers_and_readable_dates(spark):
    rows = [(f"{i % 9 + 1}D", f"2024-01-{i % 28 + 1:02d}T10:00:00{z}", "9999-99-99", None if i % 4 == 0 else "yes", "inf" if i % 20 == 0 else ".5")
            for i, z in zip(range(100), ["Z", "", ".250", "+02:00"] * 25)]
    df = spark.createDataFrame(rows, "seat string, at string, never string, gaps string, number string")
    table, report = typeinfer.convert_types(df)
    kinds = {r["column_name"]: (r["original_type"], r["inferred_type"], r["converted_to"], r["failure"]) for r in report.collect()}
    assert kinds["seat"][1] == "categorical" and table.schema["seat"].dataType.simpleString() == "string"
    assert kinds["at"] == ("string", "datetime", "timestamp", None)
    assert table.filter("at IS NULL").count() == 0
    assert kinds["never"][2:] == ("category", "looks like dates that cannot be read in one order")
    assert kinds["number"][1:3] == ("float", "double") and kinds["gaps"][1:3] == ("boolean", "boolean")
    filled, filling = impute(table, "median")
    used = {r["column_name"]: (r["strategy_used"], r["fill_value"]) for r in filling.collect()}
    assert used == {"gaps": ("mode (fallback)", "True")}
    assert filled.schema["gaps"].dataType.simpleString() == "boolean"


@pytest.mark.parametrize("text,want", [
    ("2024-01-31T10:00:00Z", "2024-01-31 10:00:00"), ("2024-01-31T10:00:00", "2024-01-31 10:00:00"),
    ("2024-01-31 10:00:00.123", "2024-01-31 10:00:00.123"), ("2024-01-31 10:00", "2024-01-31 10:00:00"),
    ("2024/01/31 10:00:05", "2024-01-31 10:00:05"), ("31/12/2024", "2024-12-31 00:00:00"), ("01/02/2024", "2024-01-02 00:00:00"),
    ("31-12-2024 23:59", "2024-12-31 23:59:00"), ("20240131", "2024-01-31 00:00:00"), ("2024-13-41", None), ("12D", None)])
def test_date_forms(spark, text, want):
    order = dates.DAY_FIRST if text.startswith("31") else dates.MONTH_FIRST
    got = spark.createDataFrame([(text,)], "t string").select(dates.read_date("t", order).cast("string")).first()[0]
    assert (got and got.ljust(19, "0")) == want


def test_one_day_order_per_column(spark):
    """Days beyond 12 in a few values decide for the values that read both ways."""
    rows = [(f"{i % 28 + 1:02d}/02/2024", f"02-{i % 28 + 1:02d}-2024 10:00", f"{i % 9 + 1:02d}/{i % 8 + 1:02d}/2024",
             "05/02/2024" if i % 2 else "2024-02-05") for i in range(60)]
    table, report = typeinfer.convert_types(spark.createDataFrame(rows, "d string, m string, open string, mixed string"))
    got = {r["column_name"]: (r["converted_to"], r["values_lost"], r["date_order"]) for r in report.collect()}
    assert got == {"d": ("timestamp", 0, "day first"), "m": ("timestamp", 0, "month first"),
                   "open": ("timestamp", 0, "month first"), "mixed": ("timestamp", 0, "month first")}
    for r, (d, m, open_, _) in zip(table.collect(), rows):
        assert r["d"].strftime("%d/%m/%Y") == d and r["m"].strftime("%m-%d-%Y %H:%M") == m
        assert r["open"].strftime("%m/%d/%Y") == open_


def test_lost_values_are_counted_and_too_many_keep_the_text(spark):
    rows = [("2024-02-15" if i == 0 else "2024-02-15 at noon", "2024-02-30" if i < 6 else "2024-02-03",
             "13/01/2024" if i % 2 else "01/13/2024", "x" if i < 4 else str(i), "n.a." if i < 5 else f"{i}.5", None) for i in range(60)]
    df = spark.createDataFrame(rows, "half string, some string, both string, whole string, part string, none string")
    table, report = typeinfer.convert_types(df)
    got = {r["column_name"]: (r["inferred_type"], r["converted_to"], r["values_lost"], r["failure"] is not None)
           for r in report.collect()}
    assert got == {"half": ("categorical", "category", 0, True), "some": ("datetime", "timestamp", 6, False),
                   "both": ("categorical", "category", 0, True), "whole": ("integer", "bigint", 4, False),
                   "part": ("float", "double", 5, False), "none": ("unknown", None, 0, False)}
    assert table.filter("half = '2024-02-15 at noon'").count() == 59 and table.filter("some IS NULL").count() == 6
    # the same where a caller names the type
    table, report = typeinfer.convert_types(df, {"half": "datetime", "both": "datetime"})
    assert {(r["column_name"], r["converted_to"], r["values_lost"]) for r in report.collect() if r["failure"]} == {
        ("half", None, 59), ("both", None, 30)}
    assert table.filter("half IS NULL OR both IS NULL").count() == 0


def test_forms_of_dates_are_counted(spark):
    values = ["05/02/2024", "13/02/2024", "02-13-2024", "2024-02-13", "2024/02/13", "2024-02-13T10:00:00Z", "20240213", "20241399", "x",
              " 2024-02-13 ", "", None]
    df = spark.createDataFrame([(v, None) for v in values], "d string, e string")
    got = {(r["column_name"], r["date_format"]): r["n"] for r in dates.date_formats(df, ["d", "e"]).collect()}
    assert got == {("d", "MM/dd/yyyy"): 1, ("d", "dd/MM/yyyy"): 2, ("d", "MM-dd-yyyy"): 1, ("d", "yyyy-MM-dd"): 3,
                   ("d", "yyyy-MM-dd HH:mm"): 1, ("d", "yyyyMMdd"): 1, ("d", "none"): 3}


def test_columns_without_a_stand_in_are_reported_as_failed(spark):
    df = spark.createDataFrame([(1, None, None), (2, None, None)], "id long, at timestamp, text string")
    filled, report = impute(df, "median")
    assert [tuple(r) for r in report.orderBy("column_name").collect()] == [("at", "failed", 0, None), ("text", "mode (fallback)", 2, "Unknown")]
    assert {r["at"] for r in filled.collect()} == {None}


def test_csv_keeps_line_breaks_and_codes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb", "12D", "7"), (2, "c, \"d\"", "7F", "8")], "id long, text string, seat string, n string")
    writers.write_csv(df, f"{tmp_path}/x.csv")
    back = readers.read_csv(spark, f"{tmp_path}/x.csv")
    assert dict(back.dtypes) == {"id": "bigint", "text": "string", "seat": "string", "n": "bigint"}
    assert sorted((r["id"], r["text"], r["seat"]) for r in back.collect()) == [(1, "a\nb", "12D"), (2, 'c, "d"', "7F")]


def test_columns_with_many_spellings_are_compared(spark):
    import random
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14)) for _ in range(1100)]
    near = {tuple(sorted((w, w[:5] + "0" + w[6:]))) for w in words[:40]}
    df = spark.createDataFrame([(w,) for w in {*words, *(w for pair in near for w in pair)}], "c string")
    assert {(r["value_a"], r["value_b"]) for r in semantic.semantic_pairs(df, ["c"]).collect()} == near
    assert semantic.semantic_pairs(df, ["c"], max_distinct=1000).count() == 0


def test_long_spellings_end_in_time(spark):
    import random
    rng = random.Random(1)
    rows = []
    for _ in range(150):
        text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(60))
        rows += [(text,), (text[:30] + "x" + text[33:],)]
    found = noise.fuzzy_categories(spark.createDataFrame(rows, "c string"))
    assert found.count() == 300


def test_change_log_names_every_change(spark):
    rows = [(i, f"{i % 7 + 10}" if i else "ten", None if i == 3 else "x" if i % 3 else "y", 500.0 if i == 5 else float(i % 4)) for i in range(40)]
    rows += [(100, *rows[5][1:])]
    df = spark.createDataFrame(rows, "id long, n string, c string, v double")
    result = clean(df, CleaningConfig(remove_fuzzy_duplicates=False, imputation_strategy="median"), "id")
    log = {(r["id"], r["stage"], r["column_name"]): (r["old_value"], r["new_value"], r["kept_id"]) for r in result.changes.collect()}
    assert log[0, "types", "n"] == ("ten", None, None) and log[3, "missing", "c"][:2] == (None, "x")
    assert log[100, "exact_duplicate", None] == (None, None, "5")
    assert log[5, "outliers", "v"][0] == "500.0" and float(log[5, "outliers", "v"][1]) < 500
    assert log[0, "missing", "n"][0] is None and float(log[0, "missing", "n"][1]) > 0
    # every row beyond the first of its values repeats it
    seen, repeats = {}, 0
    for i, *values in rows:
        repeats += tuple(values) in seen
        seen.setdefault(tuple(values), i)
    assert sum(stage == "exact_duplicate" for _, stage, _ in log) == repeats
    dropped = clean(df, CleaningConfig(infer_types=False, imputation_strategy="drop", handle_outliers=False,
                                       remove_exact_duplicates=False), "id").changes.collect()
    assert [(r["id"], r["stage"]) for r in dropped] == [(3, "dropped")]
