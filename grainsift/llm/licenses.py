"""Licence mentions by ordered signature rules, with DataFrame operations only.

Of the rules, a text meets only those whose keyword it has as a word, which every match of them holds.
Matches are intervals of words; an interval inside a longer one is
suppressed, and of equal intervals the rule of higher priority, then the earlier one, stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from grainsift.llm import license_rules
from grainsift.llm.common import LETTER_WORD, free_name, lower_ascii

_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]++"
_NO_MATCHES = "array<struct<start:int,end:int,priority:int,rule:int,label:string,weight:double>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _blanks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" ")))


def _rule_table() -> Column:
    return F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(r["label"]).alias("label"),
                              F.lit(r["keyword"]).alias("keyword"), F.lit(r["needed"]).alias("needed"),
                              F.lit(f"(?<= ){r['pattern']}(?= )").alias("pattern"),
                              F.lit(r["priority"]).alias("priority"), F.lit(r["weight"]).alias("weight"))
                     for i, r in enumerate(license_rules.rules())])


def _places(words: Column, pattern: Column) -> Column:
    """(start, end) in words of each match in blank-joined words, from the pieces between matches."""
    hits = F.regexp_extract_all(words, pattern, F.lit(0))
    gaps = F.split(words, pattern, -1)
    def step(done: Column, pair: Column) -> Column:
        begin = done["at"] + _blanks(pair["gap"])
        stop = begin + _blanks(pair["hit"])
        return F.struct(stop.alias("at"), F.concat(done["found"], F.array(
            F.struct(begin.alias("start"), stop.alias("end")))).alias("found"))
    pairs = F.filter(F.arrays_zip(hits.alias("hit"), gaps.alias("gap")), lambda p: p["hit"].isNotNull())
    empty = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("found"))
    return F.aggregate(pairs, empty, step, lambda done: done["found"])


def _matches(words: Column, rules: Column) -> Column:
    own = F.array_intersect(F.split(words, " "), F.array(*[F.lit(a) for a in license_rules.ANCHORS]))
    fitting = _let(own, lambda have: F.filter(rules, lambda r: F.array_contains(have, r["keyword"])
                                              & F.contains(words, r["needed"])))
    return F.flatten(F.transform(fitting, lambda r: F.transform(
        _places(words, r["pattern"]), lambda p: F.struct(
            p["start"].alias("start"), p["end"].alias("end"), r["priority"].alias("priority"),
            r["rule"].alias("rule"), r["label"].alias("label"), r["weight"].alias("weight")))))


def _unsuppressed(found: Column) -> Column:
    """Matches in no longer match, and of matches on the same words the first by priority and rule.

    In order of start, then of longer and better matches first, a match is suppressed exactly when one
    before it reaches as far.
    """
    ordered = F.transform(F.array_sort(F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), (-m["end"]).alias("back"), m["priority"].alias("priority"),
        m["rule"].alias("rule"), m["label"].alias("label"), m["weight"].alias("weight")))),
        lambda m: F.struct(m["start"].alias("start"), (-m["back"]).alias("end"), m["priority"].alias("priority"),
                           m["rule"].alias("rule"), m["label"].alias("label"), m["weight"].alias("weight")))
    empty = F.struct(F.lit(-1).alias("reach"), F.array().cast(_NO_MATCHES).alias("kept"))
    return F.aggregate(
        ordered, empty,
        lambda done, m: F.when(m["end"] <= done["reach"], done).otherwise(
            F.struct(m["end"].alias("reach"), F.concat(done["kept"], F.array(m)).alias("kept"))),
        lambda done: done["kept"])


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and
    ``detections`` (start, end, priority, rule, label, weight of every match that stays) to each row.

    ``n_base`` counts all places of the base phrases, suppressed or not, and their labels always stay.
    ``score`` is the greatest weight among matches that stay, at least 0.6 with a base place, 0 with none.
    A null or empty text has no words and no match. Texts of any length are scanned whole, and rows are
    handled one by one, so ties, repeated rows and an empty table need no rule. Columns of ``df`` with the
    names of results are replaced.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    df = df.drop(*[c for c in added if c in df.columns and c != text_col])
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower_ascii(text), _BREAKS, " ")), F.lit(" "))
    rules = _rule_table()
    base = F.array(*[F.struct(F.lit(f"(?<= ){phrase}(?= )").alias("pattern"), F.lit(f" {phrase} ").alias("phrase"),
                              F.lit(label).alias("label"))
                     for phrase, label in license_rules.BASE])

    def look(w: Column) -> Column:
        places = F.flatten(F.transform(F.filter(base, lambda b: F.contains(w, b["phrase"])), lambda b: F.transform(
            _places(w, b["pattern"]), lambda p: F.struct(p["start"].alias("start"), b["label"].alias("label")))))
        return F.struct(places.alias("base"), _let(_matches(w, rules), _unsuppressed).alias("kept"))

    seen_col, place_col = free_name(df, "_seen"), free_name(df, "_places")
    seen = _let(words, look)
    none = F.array().cast("array<struct<start:int,label:string>>")
    df = df.withColumns({"n_words": F.coalesce(F.regexp_count(text, F.lit(LETTER_WORD)), F.lit(0)).cast("long"),
                         seen_col: seen})
    places = F.coalesce(F.col(seen_col)["base"], none)
    kept = F.coalesce(F.col(seen_col)["kept"], F.array().cast(_NO_MATCHES))
    df = df.withColumns({place_col: places, "detections": kept})
    starts = F.transform(place_col, lambda p: p["start"])
    own = F.array_distinct(F.transform(place_col, lambda p: p["label"]))
    return df.withColumns({
        "n_base": F.size(place_col).cast("long"),
        "first_word": F.array_min(starts).cast("long"), "last_word": F.array_max(starts).cast("long"),
        "base_labels": F.array_join(F.array_sort(own), ","),
        "labels": F.array_join(F.array_sort(F.array_distinct(F.concat(
            own, F.transform("detections", lambda m: m["label"])))), ","),
        "score": F.greatest(F.coalesce(F.array_max(F.transform("detections", lambda m: m["weight"])), F.lit(0.0)),
                            F.when(F.size(place_col) > 0, F.lit(0.6)).otherwise(F.lit(0.0))),
    }).drop(seen_col, place_col)
