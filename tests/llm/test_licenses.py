"""Licence rules against plain Python over the same rules."""

import re

from grainsift.llm import license_rules
from grainsift.llm.licenses import scan_licenses

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _plain(text):
    words = _WORD.findall(_lower(text))
    starts, labels = [], set()
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        starts += found
        labels |= {label} if found else set()
    line, matches = f" {' '.join(words)} ", []
    if any(a in line for a in license_rules.ANCHORS):
        for i, rule in enumerate(license_rules.rules()):
            if rule["keyword"] in words:
                for m in re.finditer(f"(?<= ){rule['pattern']}(?= )", line):
                    at = line[:m.start()].count(" ") - 1
                    matches.append((at, at + m[0].count(" ") + 1, rule["priority"], i, rule["label"], rule["weight"]))
    kept = [m for m in matches if not any(
        o[0] <= m[0] and m[1] <= o[1] and ((o[1] - o[0]) > (m[1] - m[0]) or o[2:4] < m[2:4]) for o in matches)]
    score = max([m[5] for m in kept] + ([0.6] if starts else [0.0]))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
            ",".join(sorted(labels | {m[4] for m in kept})), score)


TEXTS = [
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "mit-license MIT  LICENSE mit license! mit. license, notmit license mit licenses",
    "SPDX-License-Identifier: GPL-2.0-only and under the terms of the GNU Lesser General Public License v2.1 or later",
    "the GNU General Public License version 3 or the general public license", "no licence here, mit dem Zug", "", None,
    "BSD 3-Clause License. Redistribution and use in source and binary forms, with or without modification, are permitted",
    "Creative Commons Attribution-ShareAlike 4.0 International License", "KK mit licenſe İ mit license",
    "filler " * 3000 + "released under the Mozilla Public License 2.0 " + "filler " * 3000 + "apache license",
    "Dual licensed under the MIT license and the Apache License 2.0. Copyright (c) 2020 someone, all rights reserved",
]


def test_against_plain_python(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id int, text string")
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = {r["doc_id"]: tuple(r[n] for n in names) for r in scan_licenses(df).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == _plain(text), text


def test_rules_are_many_and_fit_their_gates():
    rules = license_rules.rules()
    assert len(rules) > 300
    for r in rules:
        re.compile(r["pattern"])


def test_odd_rows(spark, edge_docs):
    got = scan_licenses(edge_docs).collect()
    assert len(got) == 12
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"], r["score"]) == _plain(r["text"])
    assert scan_licenses(edge_docs.limit(0)).count() == 0


BARE = ["Some page. All rights reserved.", "released under the GPLv2", "a GNU LGPL library", "CDDL and AGPL", "CC0 1.0",
        "do WTFPL", "read the EULA", "this is shareware", "proprietary software", "the book is in the public domain",
        "Apache 2.0", "Free and unencumbered software released into the public domain", "MIT X11",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
        "The origin of this software must not be misrepresented", "end user license agreement", "Q Public License",
        "see the license for details", "nothing of the kind", "mit dem Zug um 10 Uhr"]


def _ungated(text):
    """Labels and score of all rules without keywords and other conditions."""
    line = f" {' '.join(_WORD.findall(_lower(text)))} "
    found = [(m.start(), m.end(), r["priority"], i, r["label"], r["weight"]) for i, r in enumerate(license_rules.rules())
             for m in re.finditer(f"(?<= ){r['pattern']}(?= )", line)]
    kept = [m for m in found if not any(o[0] <= m[0] and m[1] <= o[1] and (
        o[1] - o[0] > m[1] - m[0] or o[2:4] < m[2:4]) for o in found)]
    return ",".join(sorted({m[4] for m in kept})), max([m[5] for m in kept], default=0.0)


def test_no_condition_keeps_a_rule_from_its_text(spark):
    df = spark.createDataFrame(list(enumerate(BARE)), "doc_id int, text string")
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in scan_licenses(df).collect()}
    for i, text in enumerate(BARE):
        assert got[i] == _ungated(text), text
    assert got[0] == ("proprietary", 0.95) and got[1][0] == "gpl-2.0"


def _shortest(parsed):
    """Shortest texts of a parsed pattern, one for each choice of alternatives."""
    texts = [""]
    for kind, value in parsed:
        kind = str(kind)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "SUBPATTERN":
            more = _shortest(value[-1])
        elif kind == "BRANCH":
            more = [t for branch in value[1] for t in _shortest(branch)]
        elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
            more = [t * value[0] for t in _shortest(value[2])] if value[0] else [""]
        else:
            more = ["s" if kind == "IN" and any(chr(v) == "s" for k, v in value if str(k) == "LITERAL") else "1"]
        texts = [a + b for a in texts for b in dict.fromkeys(more)]
    return texts


def test_every_match_holds_the_keyword():
    for rule in license_rules.rules():
        for text in _shortest(re._parser.parse(rule["pattern"])):
            assert rule["keyword"] in text.split() and rule["needed"] in text, (rule, text)
